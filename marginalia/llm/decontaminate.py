"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts and items become lower-case words (runs of letters and digits), and words 64-bit
hashes. At each position each of MASKS takes the words under its ones and ignores the
others, so a substituted word spoils only the seeds that look at it. The seeds of all
texts are joined to the items' seeds; a hit gives an item and a diagonal (where the
item would begin in the text). Where enough hits meet on a diagonal the overlap is
verified: on it some WINDOW consecutive words of the item (all, if it has fewer) must
agree in SHARE of their places. That finds whole and partial copies with substitutions.

No overlap that would be accepted is lost before that: least_hits() tries all placements
of the other words in a window, and a diagonal is dropped only if it has fewer hits than
the least of them leaves. MASKS leave at least one for every width but 5, where a word
inside needs MASKS_OF_5 too; those are used if an item is that short.

The items' seeds are broadcast up to a counted size (SEED_ROWS), else joined by
shuffle; likewise the texts that were hit. Only their words are looked at again, so
verifying doesn't shuffle all texts. A passage that a third of all texts share makes
hits in proportion to its copies; nothing is paired with other copies.

Items of fewer than SHORTEST words allow no substitution (SHARE of so few is all of them):
all their words must stand one after another, and their one seed is all of them.

Null and empty texts and items are never contaminated. Texts are read whole; repeated rows
each give a row for each item; items that share an id but not a text are items of their own,
and repeated ones count once; extra columns are ignored; a null id is kept.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import small_enough, written

#: Without substitutions at the ends: what a mask ignores there needn't be in the text.
MASKS, MASKS_OF_5 = ("1111", "11011"), ("10111", "11101")
WINDOW, SHARE, SHORTEST, SEED_ROWS = 13, 0.8, 5, 1_000_000


def words(text: Column) -> Column:
    """Hashes of the lower-case words; the empty one may stand at the ends."""
    return F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: F.xxhash64(w))


def seeds(w: Column, masks: list[str]) -> Column:
    """The seeds of all masks, one mask after the other, by position."""


    def of(mask: str) -> Column:
        taken = [i for i, c in enumerate(mask) if c == "1"]
        places = F.when(F.size(w) >= len(mask), F.sequence(F.lit(0), F.size(w) - len(mask)))
        found = F.transform(places, lambda i: F.xxhash64(F.lit(mask), *[F.get(w, i + k) for k in taken]))
        return F.coalesce(found, F.array().cast("array<bigint>"))

    return F.concat(*map(of, masks))


def place_of(pos: Column, n: Column, masks: list[str]) -> Column:
    """The position in the text of the pos-th of seeds(), for a text of n words."""
    out, left = F.lit(None).cast("int"), pos
    tests = []
    for mask in masks:
        size = F.greatest(n - len(mask) + 1, F.lit(0))
        tests.append((left < size, left))
        left = left - size
    for test, value in reversed(tests):
        out = F.when(test, value).otherwise(out)
    return out


def least_hits(width: int, masks: list[str]) -> int:
    """How many seeds any window of so many words keeps, if as many agree as verifying asks for."""
    def hits(others: tuple[int, ...]) -> int:
        return sum(all(c == "0" or at + k not in others for k, c in enumerate(mask)) for mask in masks for at in range(width - len(mask) + 1))

    return min(map(hits, combinations(range(width), width - math.ceil(SHARE * width))))


def seeded(rows: DataFrame, masks: list[str], *keys: str) -> DataFrame:
    """(keys, place, seed) for each seed of rows (keys, w)."""
    shaped = rows.select(*keys, F.size("w").alias("n"), F.posexplode(seeds(F.col("w"), masks)).alias("pos", "seed"))
    return shaped.select(*keys, place_of(F.col("pos"), F.col("n"), masks).alias("place"), "seed")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text and item that overlap: id, print (of the text), item_id, matched, item_words, in_window, share.

    matched: agreeing places on the best diagonal; in_window: the best window's; share: matched of the item's words.
    """
    trimmed = F.filter(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    items = benchmark.select("item_id", F.transform(trimmed, lambda w: F.xxhash64(w)).alias("w")).filter(F.size("w") > 0).distinct()
    items = written(items.withColumn("item", F.xxhash64("item_id", "w")), "items")
    n = F.size("w")
    sizes = {r[0] for r in items.filter(n <= SHORTEST).select(n).distinct().collect()}
    long = [*MASKS, *(MASKS_OF_5 if SHORTEST in sizes else ())]
    exact = {k: "1" * k for k in sorted(sizes - {SHORTEST})}
    least = F.array(*[F.lit(least_hits(k, long)) for k in range(SHORTEST, WINDOW + 1)])
    needs = items.withColumn("needed", F.get(least, F.least(n, F.lit(WINDOW)) - SHORTEST))
    found = seeded(needs.filter(n >= SHORTEST), long, "item", "needed")
    for k, mask in exact.items():
        found = found.unionByName(seeded(items.filter(n == k).withColumn("needed", F.lit(1)), [mask], "item", "needed"))
    masks = [*long, *[m for m in exact.values() if m not in long]]
    wanted = written(found.select("item", "needed", F.col("place").alias("item_place"), "seed"), "seeds")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null and text <> ''").withColumn("print", F.xxhash64("text"))
    every = seeded(rows.select("id", "print", words(F.col("text")).alias("w")), masks, "id", "print")
    side = F.broadcast(wanted) if small_enough(wanted, SEED_ROWS) else wanted
    met = every.join(side, "seed").groupBy("id", "print", "item", (F.col("place") - F.col("item_place")).alias("diagonal")).agg(F.count("*").alias("n"), F.min("needed").alias("needed"))
    hits = written(met.filter("n >= needed").select("id", "print", "item", "diagonal"), "hits")
    hit_rows = hits.groupBy("id", "print").agg(F.collect_list(F.struct("item", "diagonal")).alias("hits"))
    hit_rows = written(hit_rows.withColumnRenamed("id", "id_").withColumnRenamed("print", "print_"), "hit-rows")
    near = F.broadcast(hit_rows) if small_enough(hit_rows) else hit_rows
    again = rows.join(near, F.col("id").eqNullSafe(F.col("id_")) & (F.col("print") == F.col("print_"))).select("id", "print", words(F.col("text")).alias("w"), "hits")
    # only the words that an item would cover go on with a hit
    longest = items.agg(F.max(F.size("w"))).first()[0] or 0
    cut = F.transform("hits", lambda h: F.struct(h["item"].alias("item"), h["diagonal"].alias("diagonal"), F.slice("w", F.greatest(h["diagonal"], F.lit(0)) + 1, F.lit(longest)).alias("piece")))
    pieces = again.select("id", "print", F.explode(cut).alias("h")).select("id", "print", "h.*")
    side = F.broadcast(items) if small_enough(items, SEED_ROWS // 20) else items
    both = pieces.join(side, "item")
    skipped = F.greatest(-F.col("diagonal"), F.lit(0))
    agree = F.transform("w", lambda x, j: F.when((j >= skipped) & (F.get("piece", j - skipped) == x), 1).otherwise(0))
    flagged = both.select("id", "print", "item", "item_id", "diagonal", agree.alias("agree"))
    n = F.size("agree")
    width = F.least(n, F.lit(WINDOW))
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    windows = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: add(F.slice("agree", i, width)))
    scored = flagged.select("id", "print", "item", "item_id", "diagonal", add(F.col("agree")).alias("matched"), n.alias("item_words"), F.array_max(windows).alias("in_window"), width.alias("width"))
    good = scored.filter(F.col("in_window") >= F.ceil(F.lit(SHARE) * F.col("width")))
    # repeated rows meet on each diagonal once for each of them
    most = [F.max(c).alias(c) for c in ("item_id", "matched", "item_words", "in_window")]
    rows = good.groupBy("id", "print", "item", "diagonal").agg(*most, F.count("*").alias("rows"))
    best = rows.groupBy("id", "print", "item").agg(*most, F.max("rows").alias("rows")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    long_ = [F.col(c).cast("long").alias(c) for c in ("matched", "item_words", "in_window")]
    return best.select("id", "print", "item_id", *long_, F.round(F.col("matched") / F.col("item_words"), 6).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that overlap an item; columns stay as they are."""
    bad = written(contaminated(docs, benchmark).select(F.col("id").alias("__id"), F.col("print").alias("__print")).distinct(), "contaminated")
    side = F.broadcast(bad) if small_enough(bad) else bad
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__print"))
    return docs.join(side, on, "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "matched", "item_words", "in_window", "share")


#: The rule over all diagonals where a word agrees, without seeds.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
dw AS (SELECT doc_id, r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
iw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM i),
a AS (SELECT doc_id, r, item_id, n, dw.p - iw.p AS diagonal, iw.p FROM dw JOIN iw USING (w)),
g AS (SELECT r, item_id, n, diagonal FROM a GROUP BY ALL HAVING count(*) >= ceil(0.8 * least(n, 13))),
f AS (SELECT a.*, count(*) OVER (PARTITION BY r, item_id, n, diagonal ORDER BY p RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS inside FROM a SEMI JOIN g USING (r, item_id, n, diagonal)),
m AS (SELECT doc_id, r, item_id, n, diagonal, count(*) AS matched, max(inside) AS in_window FROM f GROUP BY ALL HAVING max(inside) >= ceil(0.8 * least(n, 13)))
SELECT doc_id, item_id, max(matched) AS matched, n AS item_words, max(in_window) AS in_window, round(max(matched) / n::DOUBLE, 6) AS share FROM m GROUP BY doc_id, r, item_id, n
"""
