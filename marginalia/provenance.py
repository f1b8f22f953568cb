"""Guards: rows whose origin or scorer isn't established are refused, never averaged in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIER1, TIER2, UNSET, DEGRADED = "tier1_passages", "tier2_full", "UNSET", "DEGRADED"


class ProvenanceError(RuntimeError):
    """Rows that may not be reported reached a report."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ProvenanceError(message)


def degraded(reason: str) -> str:
    return f"{DEGRADED}:{reason}"


def is_degraded(backend: Column) -> Column:
    return F.coalesce((backend == "") | (backend == UNSET) | F.startswith(backend, F.lit(DEGRADED)), F.lit(True))


def is_publishable_corpus(corpus: Column) -> Column:
    return F.coalesce(corpus == TIER2, F.lit(False))


def publishable(backend: str = "retriever_backend", corpus: str = "corpus_source") -> Column:
    return ~is_degraded(F.col(backend)) & is_publishable_corpus(F.col(corpus))


def _refuse(bad: DataFrame, key: Column, what: str) -> None:
    """Raises with the first 20 of bad, and how many there are."""
    shown = [r[0] for r in bad.select(key.alias("k")).orderBy("k").limit(20).collect()]
    if shown:
        raise ProvenanceError(f"{bad.count()} row(s) {what}:\n  " + "\n  ".join(shown))


def _key(*more: Column) -> Column:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return F.concat(F.concat_ws("/", name("question_id"), name("model_name"), name("retrieval_mode")), F.lit(": "), F.concat_ws(" ", *more))


def assert_publishable(records: DataFrame, backend: str = "retriever_backend", corpus: str = "corpus_source") -> DataFrame:
    """records, if every backend is whole and every corpus the full one; else raises."""
    _refuse(records.filter(~publishable(backend, corpus)), _key(F.concat(F.lit("backend="), F.coalesce(backend, F.lit(""))), F.concat(F.lit("corpus="), F.coalesce(corpus, F.lit("")))), "carry unpublishable provenance")
    return records


def assert_final(records: DataFrame) -> DataFrame:
    """records, if publishable and of a validated scorer; else raises."""
    assert_publishable(records)
    _refuse(records.filter(~F.coalesce(F.col("metric_status") == "final", F.lit(False))), _key(F.concat(F.lit("metric_status="), F.coalesce("metric_status", F.lit("unset")))), "were scored by an unvalidated scorer")
    return records


def split_publishable(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and refused rows; together they are records."""
    return records.filter(publishable()), records.filter(~publishable())


def one_backend_per_model(records: DataFrame) -> DataFrame:
    """records, if no model's rows come from two backends; else raises."""
    mixed = records.groupBy("model_name").agg(F.array_sort(F.collect_set("generation_backend")).alias("b")).filter(F.size("b") > 1)
    _refuse(mixed, F.concat(F.col("model_name"), F.lit(": "), F.concat_ws(",", "b")), "of one model come from several backends")
    return records


def single_tier(chunks: DataFrame, expected: str | None = None) -> str:
    """The corpus tag of all chunks; raises if there are several, none, or another than expected."""
    tags = [r[0] for r in chunks.select("corpus_source").distinct().limit(3).collect()]
    require(len(tags) == 1 and bool(tags[0]), f"expected one corpus tag, found {sorted(map(str, tags))}")
    require(expected is None or tags[0] == expected, f"the corpus is {tags[0]}, not {expected}")
    return tags[0]


def unique(df: DataFrame, key: str) -> DataFrame:
    """df, if no value of key comes twice; else raises with the values and their places."""
    twice = df.groupBy(key).count().filter("count > 1")
    _refuse(twice, F.concat(F.col(key).cast("string"), F.lit(" x "), F.col("count").cast("string")), f"share a {key}")
    return df
