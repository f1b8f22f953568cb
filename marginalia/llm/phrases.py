"""Document fingerprints by locally consistent parsing.

A text is a row of names, at first its code points. Each level merges runs of one
name, reduces the names to a few labels by deterministic coin tossing (where a name
first differs from the one before it, and its bit there; three rounds leave fewer
than 8 labels), cuts a phrase at each local maximum of the labels, and names the
phrase by a hash of what it holds. A cut depends on a few neighbours only, so equal
substrings are cut alike inside, wherever they stand; a phrase of the next level
holds some three of this one.

A fingerprint holds, for each of LEVELS, BINS minima of the hashes of the distinct
phrase names (one permutation, 16 bits each; empty bins are marked). The likeness of
two is the mean over the levels of the estimated Dice coefficient of their name sets;
a level that is empty on both sides doesn't count, and two empty texts are alike (1).

Null and empty texts have the fingerprint of the empty text; texts are parsed whole,
with memory in proportion to the longest one; repeated rows each give a row; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map, slices

#: Levels of phrases that a fingerprint holds (some 11 and 36 characters), and its bins for each.
LEVELS, BINS = (2, 3), 64
EMPTY = np.uint16(0xFFFF)
#: Buckets that neighbours are found in, at most; more rows make larger ones, which are streamed.
MAX_BUCKETS = 20_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each name the lowest bit where it differs from the one before it, and its value there."""
    one = x.dtype.type(1)
    diff = x.copy()
    diff[1:] ^= x[:-1]
    diff[first] = one
    low = np.bitwise_count((diff & (~diff + one)) - one)
    return (low << np.uint8(1)) | ((x >> low.astype(x.dtype)) & one).astype(np.uint8)


def phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: names of phrases, and where texts begin among them. first: indices, one for each text, none empty."""
    starts = np.zeros(len(names), bool)
    starts[first] = True
    keep = starts.copy()
    keep[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(keep)
    runs = np.diff(at, append=len(names))
    names, starts = names[at], starts[at]
    first = np.flatnonzero(starts)
    labels = tossed(names, first)
    for _ in range(2):
        labels = tossed(labels, first)
    cut = starts.copy()
    peak = labels[1:] > labels[:-1]
    # a text's last name is no peak: what follows it is another text
    cut[1:-1] |= peak[:-1] & (labels[2:] < labels[1:-1]) & ~starts[2:]
    begin = np.flatnonzero(cut)
    sizes = np.diff(begin, append=len(names))
    place = (np.arange(len(names)) - np.repeat(begin, sizes) + 1).astype(np.uint64)
    terms = mixed(mixed(names.astype(np.uint64)) + place * np.uint64(0xA24BAED4963EE407) + (runs.astype(np.uint64) << np.uint64(40)))
    return mixed(np.add.reduceat(terms, begin)), np.flatnonzero(starts[begin])


def sketches(texts: list[str]) -> np.ndarray:
    """A row of len(LEVELS) * BINS 16-bit minima for each text."""
    out = np.full((len(texts), len(LEVELS), BINS), EMPTY, np.uint16)
    filled = [i for i, t in enumerate(texts) if t]
    if not filled:
        return out.reshape(len(texts), -1)
    rows = np.array(filled)
    names = np.frombuffer("".join(texts[i] for i in filled).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in filled])[:-1]])
    for level in range(1, max(LEVELS) + 1):
        names, first = phrases(names, first)
        if level in LEVELS:
            sizes = np.diff(first, append=len(names))
            owner = np.repeat(rows, sizes)
            h = mixed(names + np.uint64(level))
            cell = owner * BINS + (h >> np.uint64(58)).astype(np.int64)
            value = ((h >> np.uint64(20)) & np.uint64(0xFFFFFFFF)) % np.uint64(0xFFFF)
            packed = np.sort((cell.astype(np.uint64) << np.uint64(16)) | value)
            head = np.concatenate([[True], (packed[1:] >> np.uint64(16)) != (packed[:-1] >> np.uint64(16))])
            cells, least = (packed[head] >> np.uint64(16)).astype(np.int64), (packed[head] & np.uint64(0xFFFF)).astype(np.uint16)
            out[cells // BINS, LEVELS.index(level), cells % BINS] = least
    return out.reshape(len(texts), -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from 0 to 1."""
    a, b = a.reshape(len(a), len(LEVELS), BINS), b.reshape(len(b), len(LEVELS), BINS)
    some = ((a != EMPTY) | (b != EMPTY)).sum(2)
    same = ((a == b) & (a != EMPTY)).sum(2)
    share = same / np.maximum(some, 1)
    dice = 2 * share / (1 + share)
    levels = (some > 0).sum(1)
    return np.where(levels > 0, dice.sum(1) / np.maximum(levels, 1), 1.0)


def spelled(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2").astype(np.uint16)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and fingerprint for each row of df; likeness() compares what read() makes of two."""
    own = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [spelled(s) for a, b in slices(texts, 250_000) for s in sketches(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[id_col, "fingerprint"])

    return arrow_map(own, run, f"`{id_col}` {own.schema[0].dataType.simpleString()}, fingerprint string")


def bucket_of(key: Column, splits: list[int]) -> Column:
    """How many of splits (sorted) are at most key, in two steps of about the root of their number."""
    step = max(1, int(len(splits) ** 0.5))
    if not splits:
        return F.lit(0)
    # each list is one literal, folded when the plan is made
    listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    every, coarse = listed(splits), F.size(F.filter(listed(splits[::step]), lambda s: s <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + F.size(F.filter(F.slice(every, (coarse - 1) * step + 1, F.lit(step)), lambda s: s <= key))).cast("int")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows dealt to buckets of neighbouring ids and sorted there: doc_id, text, tail.

    The first row of each bucket goes to the bucket before it as well, marked as tail,
    and the first row of all to the last one; so each row's next one follows it in its
    own partition, and no task holds more than its bucket. A null id counts as least;
    rows with one id are in order of their texts. Ids are whole numbers. One row for each bucket, its least
    id, comes to the driver.
    """
    key = F.coalesce(F.col("__id").cast("long"), F.lit(-(2**63)))
    own = df.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    keys = own.select(key.alias("__key"))
    n = min(MAX_BUCKETS, max(1, own.rdd.getNumPartitions()))
    found = keys.approxQuantile("__key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    splits = sorted({int(x) for x in found})
    dealt = own.withColumn("__key", key).withColumn("__bucket", bucket_of(F.col("__key"), splits))
    heads = sorted((r[0], r[1]) for r in keys.withColumn("__bucket", bucket_of(F.col("__key"), splits)).groupBy("__bucket").agg(F.min("__key")).collect())
    if not heads:
        return own.select(F.col("__id"), F.col("__text"), F.lit(False).alias("__tail"))
    before = [(least, heads[i - 1][0]) for i, (_, least) in enumerate(heads)]
    heads_df = df.sparkSession.createDataFrame(before, "__key long, __before int")
    # heads has at most MAX_BUCKETS rows
    marked = dealt.join(F.broadcast(heads_df), "__key", "left")
    places = F.when(F.col("__before").isNull(), F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("t")))).otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("t")), F.struct(F.col("__before").alias("b"), F.lit(True).alias("t"))))
    spread = marked.select("__id", "__text", "__key", F.explode(places).alias("__p")).select("__id", "__text", "__key", F.col("__p.b").alias("__bucket"), F.col("__p.t").alias("__tail"))
    return _dealt(spread, heads[-1][0] + 1).sortWithinPartitions("__bucket", "__tail", "__key", "__text").select("__id", "__text", "__tail")


def _dealt(spread: DataFrame, buckets: int) -> DataFrame:
    """A partition for each bucket, by its number, so that none holds two."""
    return spread.repartitionById(buckets, F.col("__bucket"))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of df its fingerprint, its edited text's, and how alike they and the next row's are."""
    own = with_next(df, id_col, text_col)
    kind = own.schema["__id"].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(ids: list, texts: list[str], tails: list[bool]) -> list[tuple]:
        own_prints = np.concatenate([sketches(texts[a:b]) for a, b in slices(texts, 250_000)])
        wanted = [i for i in range(len(ids) - 1) if not tails[i]]
        out = []
        changed = [edited(texts[i], texts[i + 1]) for i in wanted]
        for a, b in slices(changed, 250_000):
            prints = sketches(changed[a:b])
            at = np.array(wanted[a:b])
            for i, text, p, x, y in zip(at, changed[a:b], prints, likeness(own_prints[at], prints), likeness(own_prints[at], own_prints[at + 1]), strict=True):
                out.append((ids[i], len(texts[i]), hashlib.sha256(text.encode()).hexdigest(), spelled(own_prints[i]), spelled(p), float(x), float(y)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        tails: list[bool] = []
        for whole in batches:
            # a long text's row may be alone in its part
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                id_type = batch.schema.field(0).type
                ids += batch.column(0).to_pylist()
                texts += batch.column(1).to_pylist()
                tails += batch.column(2).to_pylist()
                if len(ids) > 1:
                    made = list(zip(*rows_of(ids, texts, tails), strict=True)) or [()] * 7
                    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(made, kinds, strict=True)], names=names)
                ids, texts, tails = ids[-1:], texts[-1:], tails[-1:]

    return arrow_map(own, run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
