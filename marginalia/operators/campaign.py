"""A campaign's rows: what precision a model loaded at, which models and modes may run, and records of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.legal import citations, refusal_lists
from marginalia.operators.prompts import pack, rag_prompt
from marginalia.provenance import DEGRADED, is_degraded, require

#: The share of linear modules that a verified 4-bit load has, the modes, and a peer's role.
QUANTIZED_FLOOR, MODES, PEER = 0.95, ("closed_book", "rag_bm25", "rag_dense"), "peer"


def quantization(requested: Column, configured: Column, dtype: Column, census: Column, kind: str = "nf4", compute: str = "float16") -> Column:
    """(quant_config, verified, degraded) of a load: what was asked for is no evidence of what happened.

    census maps names of linear modules to how many there are; without one only the first
    parameter's type is left to judge by.
    """
    t = F.replace(F.coalesce(dtype, F.lit("unknown")), F.lit("torch."), F.lit(""))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    total = add(F.map_values(census))
    packed = add(F.map_values(F.map_filter(census, lambda name, n: F.contains(F.lower(name), F.lit("4bit")))))
    out = lambda config, verified, bad: F.struct(config.alias("quant_config"), F.lit(verified).alias("verified"), F.lit(bad).alias("degraded"))
    bad = lambda *why: out(F.concat(F.lit(f"{DEGRADED}:"), *why), False, True)
    good = out(F.lit(f"bnb-4bit-{kind}+{compute}"), True, False)
    return (
        F.when(~requested, out(F.concat(F.lit("full-"), t), False, False))
        .when(census.isNotNull() & (total == 0), bad(F.lit("quantization-unverifiable-no-linear-modules")))
        .when(~configured, bad(F.lit("quantization-not-applied-loaded-"), t))
        .when(census.isNull() & (t == "uint8"), good)
        .when(census.isNull(), bad(F.lit("quantization-fell-back-to-"), t))
        .when(packed / total >= QUANTIZED_FLOOR, good)
        .when(packed == 0, bad(F.lit("quantization-fell-back-to-"), t))
        .otherwise(bad(F.lit("partial-4bit-"), packed.cast("string"), F.lit("of"), total.cast("string"), F.lit("-linear-modules")))
    )


def select_models(registry: DataFrame, aliases: list[str]) -> DataFrame:
    """The registry's rows (alias, hf_id, role) of aliases, with needs_label for those that aren't peers; an unknown alias is an error."""
    wanted = registry.sparkSession.createDataFrame([(a,) for a in aliases], "alias string")
    unknown = sorted(r[0] for r in wanted.join(registry, "alias", "left_anti").collect())
    if unknown:
        raise KeyError(f"unknown model aliases: {unknown}")
    return registry.join(F.broadcast(wanted), "alias", "left_semi").withColumn("needs_label", F.col("role") != PEER)


def expected_cells(models: int, modes: list[str], questions: int) -> int:
    """How many cells a grid has; an unknown mode is an error."""
    unknown = [m for m in modes if m not in MODES]
    if unknown:
        raise ValueError(f"unknown retrieval modes: {unknown}")
    return models * len(modes) * questions


def with_prompts(cells: DataFrame) -> DataFrame:
    """cells (question, passages in rank order) with context_chars, truncated_ranks, dropped_ranks and prompt."""
    t = cells.withColumn("packed", pack(F.col("passages")))
    return t.select(*cells.columns, "packed.context_chars", "packed.truncated_ranks", "packed.dropped_ranks", rag_prompt(F.col("question"), F.col("packed.context")).alias("prompt"))


def answer_records(rows: DataFrame) -> DataFrame:
    """rows (raw_response, generation_backend, retrieved_scores and others) as records: the answer, its citations and refusal; scores to six places.

    Raises if a row's backend is degraded: such a row would look clean.
    """
    bad = [r[0] for r in rows.filter(is_degraded(F.col("generation_backend"))).select("generation_backend").distinct().limit(5).collect()]
    require(not bad, f"rows of degraded backends: {bad}")
    answer = F.trim(F.regexp_replace(F.coalesce("raw_response", F.lit("")), r"(?U)^\s+|\s+$", ""))
    t = rows.withColumn("answer_text", answer).withColumn("verdict", refusal_lists(F.col("answer_text")))
    return t.select(*[c for c in t.columns if c not in ("verdict", "retrieved_scores")], F.transform("retrieved_scores", lambda s: F.round(s, 6)).alias("retrieved_scores"), citations(F.col("answer_text")).alias("extracted_citations"), F.col("verdict.abstained").alias("abstained"), F.col("verdict.matched").alias("abstention_matched_exact"), F.col("verdict.soft").alias("abstention_soft_patterns"))


def deliveries(files: DataFrame, plan: DataFrame, cited: DataFrame) -> DataFrame:
    """files (file) with the plan's document for their name, the first that names it, and how many questions cite it.

    plan: (priority, doc_id, basename); cited: (basename), a row for each citation.
    """
    first = plan.filter("basename <> ''").groupBy("basename").agg(F.min_by("doc_id", "priority").alias("plan_doc_id"))
    counts = cited.filter("basename <> ''").groupBy("basename").agg(F.count("*").alias("n"))
    return files.join(first, files["file"] == first["basename"], "left").drop("basename").join(counts, files["file"] == counts["basename"], "left").select(*files.columns, "plan_doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("cited_by_questions"))


def blind_report(scores: DataFrame, key: str, ours, metrics: list[str], arm: str = "arm") -> DataFrame:
    """By metric, a line of a report as text: our median over the arms, and the median percentile."""
    from marginalia.operators.validate import arms_report

    r = arms_report(scores, key, ours, metrics, arm)
    return r.select("metric", F.format_string("| %s | %.2f | %.1f | %d |", "metric", "median_score", "median_pct", "arms").alias("line"))
