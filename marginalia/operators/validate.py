"""Agreement between raters, deterministic samples, ranks and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.operators.retrieval import broadcast_if_small
from marginalia.provenance import require


def confusion(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, n): how often each two ratings meet. One row for each pair of categories goes on."""
    return pairs.groupBy(*(by or []), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None, rounded: bool = True) -> DataFrame:
    """(by, n, agreement, kappa): Cohen's kappa.

    Where chance alone makes all agree, kappa is 1, or null if not rounded: the two
    edge rules in use. An empty table gives no row with by, and a row of nulls without.
    """
    keys = by or []
    cells = confusion(pairs, a, b, keys)
    total = cells.groupBy(*keys).agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    side = lambda c: cells.groupBy(*keys, F.col(c).alias("category")).agg(F.sum("n").alias(f"n_{c}"))
    on = [*keys, "category"]
    chance = side("a").join(side("b"), on).groupBy(*keys).agg(F.sum(F.col("n_a").cast("double") * F.col("n_b")).alias("meet"))
    joined = total.join(chance, keys, "left") if keys else total.join(chance)
    po, pe = F.col("same") / F.col("n"), F.coalesce("meet", F.lit(0.0)) / (F.col("n") * F.col("n"))
    value = F.when(pe == 1, F.lit(1.0) if rounded else F.lit(None).cast("double")).otherwise((po - pe) / (1 - pe))
    return joined.select(*keys, F.col("n").cast("long").alias("n"), F.round(po, 4).alias("agreement"), (F.round(value, 4) if rounded else value).alias("kappa"))


FIELDS = ("correct", "hallucinated", "abstained")


def validation_report(pairs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """By field: agreement, kappa, confusion and where human and scorer differ. Refuses fewer than two pairs, or gaps."""
    n = pairs.limit(2).count()
    require(n >= 2, "validation_report: needs at least 2 labelled pairs")
    gaps = pairs.filter(" or ".join(f"human_{f} is null or auto_{f} is null" for f in fields)).limit(5)
    missing = [r[0] for r in gaps.select("question_id").collect()]
    require(not missing, f"validation_report: labels are missing: {missing}")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"human_{f}").cast("boolean").alias("human"), F.col(f"auto_{f}").cast("boolean").alias("auto")) for f in fields])).alias("x")
    flat = pairs.select("question_id", rows).select("question_id", "x.*")
    h, a = F.col("human"), F.col("auto")
    counts = flat.groupBy("field").agg(F.count_if(h & a).alias("both_yes"), F.count_if(h & ~a).alias("human_yes_auto_no"), F.count_if(~h & a).alias("human_no_auto_yes"), F.count_if(~h & ~a).alias("both_no"), F.array_sort(F.collect_list(F.when(h != a, F.col("question_id")))).alias("disagreements"))
    return kappa(flat, "human", "auto", ["field"]).join(counts, "field")


def scorer_analysis(pairs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """By field: the scorer's precision and recall against the human."""
    r = validation_report(pairs, fields)
    return r.select("field", "n", "agreement", "kappa", F.round(F.try_divide("both_yes", F.col("both_yes") + F.col("human_no_auto_yes")), 4).alias("precision"), F.round(F.try_divide("both_yes", F.col("both_yes") + F.col("human_yes_auto_no")), 4).alias("recall"))


def stratum(is_answerable: Column, abstained: Column, hallucinated: Column) -> Column:
    """The four cells that labels are drawn from."""
    return F.when(~is_answerable, "probe").when(abstained, "false_abstention").when(hallucinated, "ans_hallucinated").otherwise("ans_clean")


def draw_order(key: Column, seed: int) -> Column:
    """An order that depends on the key and seed alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def quota_sample(rows: DataFrame, quotas: DataFrame, strata: list[str], key: str, seed: int = 20260913) -> DataFrame:
    """As many rows of each stratum as quotas (strata, quota) say, or all; drawn by draw_order, the same on any cluster."""
    order = Window.partitionBy(*strata).orderBy(draw_order(F.col(key), seed), key)
    return rows.join(broadcast_if_small(quotas), strata).withColumn("n", F.row_number().over(order)).filter("n <= quota").drop("n", "quota")


def round_robin(rows: DataFrame, group: str, key: str, parts: int = 2, seed: int = 1) -> DataFrame:
    """rows with part: each group's rows dealt in turn, in draw_order."""
    return rows.withColumn("part", F.pmod(F.row_number().over(Window.partitionBy(group).orderBy(draw_order(F.col(key), seed), key)) - 1, F.lit(parts)))


def first_author(author: Column, default: str) -> Column:
    """The name before a semicolon."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(F.coalesce(author, F.lit("")), ";", 1)), F.lit("")), F.lit(default))


def blind_pack(rows: DataFrame, ours: DataFrame, key: str, size: int = 48, seed: int = 7) -> DataFrame:
    """(blind_id, key, is_ours): size rows and ours, in an order that tells nothing."""
    ranked = rows.join(ours.select(key), key, "left_anti").select(key, draw_order(F.col(key), seed).alias("d")).orderBy("d", key).limit(size).select(key, F.lit(False).alias("is_ours"))
    both = ranked.unionByName(ours.select(key, F.lit(True).alias("is_ours")))
    # as small as the pack: one task is enough
    n = F.row_number().over(Window.orderBy(draw_order(F.col(key), seed + 1), key))
    return both.select(F.concat(F.lit("P"), F.lpad(n.cast("string"), 2, "0")).alias("blind_id"), key, "is_ours")


def percentile_of(scores: DataFrame, key: str, ours, metric: str) -> DataFrame:
    """One row: our rank and percentiles, strict and by midpoints, with the corpus's spread; the median is the upper one.

    The value is looked up first; then one aggregation over all rows. For the median, rows
    below two quantiles around it are counted, and only values between them are ranked.
    """
    mine = scores.filter(F.col(key) == ours).select(F.col(metric).alias("mine"))
    every = scores.join(F.broadcast(mine))
    v, m = F.col(metric), F.col("mine")
    counts = every.agg(F.first("mine").alias("ours"), F.count("*").alias("n"), F.count_if(v < m).alias("below"), F.count_if(v == m).alias("ties"), F.count_if(v > m).alias("better"), F.min(v).alias("least"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("most"))
    median = upper_median(scores, metric)
    pct = lambda x: F.when(F.col("n") > 1, F.round(x * 100.0 / (F.col("n") - 1), 6)).otherwise(100.0)
    return counts.select("ours", (F.col("better") + 1).alias("rank"), "n", "below", "ties", "better", pct(F.col("below")).alias("strict_pct"), pct(F.col("below") + 0.5 * (F.col("ties") - 1)).alias("midpoint_pct"), "least", F.lit(median).cast("double").alias("upper_median"), "mean", "most")


def upper_median(rows: DataFrame, metric: str) -> float | None:
    """The value with half of the others, or one more, below it; null without any.

    Two quantiles (off by half a percent at most) lie around it, so two in a hundred rows or
    ties with them are left; these are counted by value, and the values walked through in order.
    """
    v = rows.select(F.col(metric).cast("double").alias("v")).filter("v is not null")
    around = v.approxQuantile("v", [0.49, 0.51], 0.005)
    if not around:
        return None
    low, high = around
    n, below = v.agg(F.count("*"), F.count_if(F.col("v") < low)).first()
    inside = v.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return inside.withColumn("upto", upto + below).filter(F.col("upto") > n // 2).agg(F.min("v")).first()[0]


def arms_report(scores: DataFrame, key: str, ours, metrics: list[str], arm: str = "arm") -> DataFrame:
    """By metric: our median over the arms, their spread, and the share of others below; arms without our row are left out."""
    flat = scores.select(arm, key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(arm, key, "x.*").filter("v is not null")
    mine = flat.filter(F.col(key) == ours).select(arm, "metric", F.col("v").alias("mine"))
    per = flat.filter(F.col(key) != ours).join(F.broadcast(mine), [arm, "metric"]).groupBy(arm, "metric").agg(F.first("mine").alias("mine"), (F.count_if(F.col("v") < F.col("mine")) * 100.0 / F.count("*")).alias("pct"))
    return per.groupBy("metric").agg(F.count("*").alias("arms"), F.round(F.median("mine"), 6).alias("median_score"), F.round(F.median("pct"), 6).alias("median_pct"), F.round(F.max("pct") - F.min("pct"), 6).alias("spread"))
