"""SimHash near-duplicates by ball hashing that meets in the middle.

Each text gets a 64-bit SimHash of its word shingles. Fingerprints link at
RADIUS or fewer differing bits. Every distinct fingerprint emits all variants
within half the radius (itself and its 64 single-bit flips); two fingerprints
within the radius share a variant, so one shuffle on variants brings every
linked pair together. Fingerprints that share a variant are within the radius
of each other (each is at most half of it away), and a variant has at most 65
neighbours, so no group under a variant is larger than 65 distinct fingerprints
whatever the number of copies. Each is tied to the smallest one of its group,
the pair is verified, and repeated pairs go: this keeps every component whole
with linearly many pairs. Components then come from alternating large-star and
small-star rounds, each written to the shared folder.

Equal fingerprints are one node from the start: copies cost one row each.
Null and empty texts, and texts without words, have fingerprint zero, and are
linked like any other. A row with a null id gets its component's smallest id;
if no id of the component is known, null. Repeated rows each give a row. Rows
that share an id but not a text are rows of their own, in components of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import arrow_map, small_enough, written

WORDS, RADIUS, HASH_SEED = 3, 2, 42


def fingerprint(text: str | None, words: int = WORDS, chunk: int = 100_000) -> int:
    """The SimHash of text's shingles as an unsigned 64-bit integer."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and white space only
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), HASH_SEED)
    n = len(w) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        part = w[at : at + chunk + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64, min(chunk, n - at))
        ones += bit_counts(h)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > n)))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of h have each of the 64 bits; eight rows' worth of counts are added at a time."""
    planes = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    whole = len(h) // 255 * 255
    ones = planes[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ones + planes[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The id, print (a hash of the whole text) and fingerprint (a signed long) for each row of df."""
    text = F.col(f"`{text_col}`").cast("string")
    own = df.select(F.col(f"`{id_col}`"), F.xxhash64(text).alias("print"), text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=[id_col, "print", "fingerprint"])

    return arrow_map(own, run, f"`{id_col}` {own.schema[0].dataType.simpleString()}, print long, fingerprint long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified pairs (a, b), a < b, that join all of nodes' (distinct column fingerprint) within radius.

    Only radius 2 has the bounded groups that this relies on.
    """
    if radius != 2:
        raise ValueError("the ball's half radius is one bit")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fingerprint").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    ball = F.concat(F.array(F.col("fingerprint")), flips)
    # each node becomes 65 rows: nodes are few bytes, and would else be packed into few tasks
    variants = spread(nodes.select("fingerprint")).select("fingerprint", F.explode(ball).alias("variant"))
    least = F.min("fingerprint").over(Window.partitionBy("variant"))
    pairs = variants.select(least.alias("a"), F.col("fingerprint").alias("b")).filter("a < b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def spread(nodes: DataFrame) -> DataFrame:
    """nodes in as many partitions as a shuffle has, whatever their size."""
    spark = nodes.sparkSession
    return nodes.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *nodes.columns)


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of pairs (a, b); root is the component's least node.

    Large-star ties each node's larger neighbours to its least neighbour, small-star
    its smaller ones; they alternate until the pairs no longer change. Sums for a
    node are partial before the shuffle, and its neighbours aren't collected.
    """
    now, before = written(pairs.select("a", "b"), "pairs"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, larger=True)
        small = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger=False)
        now = written(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("count_if(a is null)")).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    tied = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b): ties b, of each a, to the least of a and its neighbours."""
    # a written table, so that the join reads plain shuffles, whose hot keys Spark can split
    least = written(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")), "least")
    joined = edges.join(least, "a")
    moved = joined.filter("b > a" if larger else "b <> m").select(F.col("b").alias("x"), "m")
    if not larger:
        moved = moved.unionByName(least.select(F.col("a").alias("x"), "m"))
    return moved.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The id, print, fingerprint (a signed long), root (the component's node) and component_id for each row of df."""
    prints = written(fingerprints(df, id_col, text_col, words), "prints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min(f"`{id_col}`").alias("least_id")), "nodes")
    roots = components(links(nodes))
    of = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    of = written(of, "roots")
    least = written(of.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = of.join(least, "root").select("fingerprint", "root", "component_id")
    return prints.join(named, "fingerprint").select(id_col, "print", "fingerprint", "root", "component_id")


def one_of_each(docs: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """documents with one row of each component: the one with the smallest doc_id, then the smallest print.

    The components are of's (doc_id, print, root), or those of near_duplicates(). Null
    ids come last, so a row without an id goes only if its component has another row.
    Rows are told apart by id and text: a row that shares its id with one that goes stays.
    Of rows that are the same in both one stays. What goes is broadcast up to a counted
    size, else shuffled.
    """
    found = written((near_duplicates(docs) if of is None else of).select("doc_id", "print", "root"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("print").alias("print"))
    groups = written(found.groupBy("root").agg(F.min(rank).alias("kept"), F.max(rank).alias("last"), F.count("*").alias("n")).filter("n > 1"), "groups")
    several = groups.filter(F.col("kept") != F.col("last")).select("root", "kept")
    goes = ~(F.col("doc_id").eqNullSafe(F.col("kept.id")) & (F.col("print") == F.col("kept.print")))
    gone = written(found.join(several, "root").filter(goes).select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).distinct(), "gone")
    text = F.xxhash64(F.col("text").cast("string"))
    side = F.broadcast(gone) if small_enough(gone) else gone
    kept = docs.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (text == F.col("__print")), "left_anti")
    if found.groupBy("doc_id", "print").count().filter("count > 1").limit(1).count():
        kept = kept.withColumn("__print", text).dropDuplicates(["doc_id", "__print"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
