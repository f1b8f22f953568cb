"""Reading what the engine works on. Readers take any path that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.legal import ARTICLE, SENTINEL
from marginalia.functions.text import fold, urls, vietnamese_ratio
from marginalia.operators.gold import questions_from_rows, row_id
from marginalia.provenance import require, single_tier, unique
from marginalia.sources.scratch import written

REQUIRED = ("question", "answer", "text_contains_answer_in_the_doc", "doc_link")
CITATION = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "article_id", "clause_id", "confidence")])
QUESTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("is_answerable", T.BooleanType()), T.StructField("gold_doc_ids", T.ArrayType(T.StringType())),
    T.StructField("gold_citations", T.ArrayType(CITATION)), T.StructField("reference_answer", T.StringType()), T.StructField("category", T.StringType()), T.StructField("gold_passage", T.StringType()),
    T.StructField("source_urls", T.ArrayType(T.StringType())), T.StructField("doc_id_confidence", T.StringType()), T.StructField("author", T.StringType()),
])
CHUNK = T.StructType([*[T.StructField(c, T.StringType()) for c in ("chunk_id", "doc_id", "doc_title", "chapter", "article_id", "article_title", "clause_id", "text")], T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("corpus_source", T.StringType())])


def csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV with quoted line breaks, and without a byte order mark in its first name; ordinal is the row's number from 1.

    One such file can't be split, so its rows are in one partition, and numbered there.
    """
    df = spark.read.option("header", header).option("multiLine", True).option("escape", '"').option("quote", '"').option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.withColumn("ordinal", F.monotonically_increasing_id() + 1)


def gold_questions(spark: SparkSession, path: str, manifest: dict[str, str] | None = None) -> DataFrame:
    """Gold questions of a CSV; raises on missing columns and on ids that come twice."""
    rows = csv(spark, path)
    missing = [c for c in REQUIRED if c not in rows.columns]
    require(not missing, f"the CSV lacks columns: {missing}")
    for c in ("ID", "author"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    return unique(questions_from_rows(rows, manifest), "id")


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """The addresses and instruments of a manifest, in the file's order; a file that isn't there has none. Kept by hand, so small."""
    import json

    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return {}
    found = json.loads(text[0]) if text else {}
    return {k: v or "" for k, v in (found.get("urls") or found).items()}


def chunks(spark: SparkSession, path: str, tier: str | None = None) -> DataFrame:
    """Chunks of a JSON array; raises on rows without id or text, ids that come twice, mixed tiers, or none at all."""
    df = spark.read.schema(CHUNK).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("ordinal", F.monotonically_increasing_id())
    blank = df.filter("chunk_id is null or doc_id is null or article_id is null or trim(coalesce(text, '')) = '' or coalesce(corpus_source, '') = ''").limit(5)
    bad = [r[0] for r in blank.select(F.coalesce("chunk_id", F.lit("?"))).collect()]
    require(not bad, f"chunks lack fields: {bad}")
    single_tier(df, tier)
    return unique(df, "chunk_id")


def evaluation_corpus(spark: SparkSession, path: str, top_k: int = 3) -> DataFrame:
    """Chunks of the full corpus only, at least top_k of them."""
    df = chunks(spark, path, "tier2_full")
    require(df.limit(top_k).count() >= top_k, f"the corpus has fewer than {top_k} chunks")
    return df


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Canonical questions of a JSON array; fields that aren't known are left out."""
    return spark.read.schema(QUESTION).option("multiLine", True).json(path)


def answerable_and_probes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("is_answerable"), F.lit(False)) & (F.size("gold_doc_ids") > 0)
    return df.filter(ok), df.filter(~ok)


def checkpoint_lines(lines: DataFrame, schema: str, ordinal: str = "ordinal", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, problems) of JSON lines: the last record of each cache_key, at its first place; lines that aren't records, counted by kind."""
    parsed = lines.select(ordinal, F.col(value).alias("value"), F.from_json(value, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.startswith(F.trim("value"), F.lit("{"))
    keyless = F.coalesce(F.col("r.cache_key"), F.lit("")) == ""
    good = parsed.filter(~broken & ~keyless).groupBy(F.col("r.cache_key").alias("cache_key")).agg(F.min(ordinal).alias("first_ordinal"), F.max_by("r", ordinal).alias("r"))
    names = [n.split()[0].strip("`") for n in _fields(schema)]
    records = good.select("first_ordinal", "cache_key", *[F.col(f"r.`{n}`").alias(n) for n in names if n != "cache_key"])
    problems = parsed.filter(F.trim("value") != "").select(F.when(broken, "not_a_record").when(keyless, "no_cache_key").alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count("*").alias("lines"))
    return records, problems


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return out


def checkpoint(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """checkpoint_lines() of a file; lines are numbered by their place in it."""
    return checkpoint_lines(spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()), schema)


def with_meta(generations: DataFrame, meta: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """generations with what the last meta record of their key says."""
    last = meta.groupBy("cache_key").agg(F.max_by(F.struct(*[c for c in meta.columns if c not in ("cache_key", ordinal)]), ordinal).alias("m"))
    own = [c for c in meta.columns if c not in ("cache_key", ordinal) and c not in generations.columns]
    return generations.join(last, "cache_key", "left").select(*generations.columns, *[F.col(f"m.`{c}`").alias(c) for c in own])


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files; bytes that aren't UTF-8 become replacement characters."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def choose_layer(layers: Column) -> Column:
    """(text, tag) of the first trusted one of layers (text, tag): it names an article, and is Vietnamese."""
    good = F.filter(layers, lambda x: x["text"].rlike(ARTICLE) & (vietnamese_ratio(x["text"]) >= 0.05))
    return F.coalesce(F.get(good, F.lit(0)), F.raise_error(F.lit("no layer of this document can be trusted")).cast("struct<text:string,tag:string>"))


def without_header(text: Column) -> Column:
    """A sidecar's text without the comment at its beginning."""
    return F.regexp_replace(text, r"(?s)^<!--.*?-->\s*", "")


def html_body(html: Column) -> Column:
    """A page's text by lines, without scripts, styles, navigation, headers, footers, forms and asides."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|nav|header|footer|noscript|form|aside)\b.*?</\1\s*>|<head\b.*?</head\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def extracted(format: Column, text: Column) -> Column:
    """A text by its format: plain or html; another is an error."""
    f = F.lower(F.coalesce(format, F.lit("")))
    return F.when(f.isin("txt", "text"), text).when(f.isin("htm", "html"), html_body(text)).otherwise(F.raise_error(F.concat(F.lit("no extractor for "), f)).cast("string"))


def ingest_plan(spark: SparkSession, path: str) -> DataFrame:
    """What is to be read, by priority; skipped, blocked and quarantined documents are left out."""
    raw = spark.read.option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")
    return plan_order(raw)


def plan_order(plan: DataFrame) -> DataFrame:
    return plan.filter(~F.coalesce("status", F.lit("")).isin("skipped", "blocked", "quarantined")).withColumn("priority", F.coalesce("priority", F.lit(999)))


def scores(spark: SparkSession, path: str, metrics: list[str], key: str = "id") -> DataFrame:
    """A score file: metrics as numbers where they are, the verdict in lower case, a note from either column; the last of equal ids."""
    df = csv(spark, path)
    note = F.coalesce(*[F.col(c) for c in ("note", "fatal_flaw") if c in df.columns], F.lit(None).cast("string"))
    verdict = F.lower(F.trim(F.col("verdict"))) if "verdict" in df.columns else F.lit(None).cast("string")
    t = df.select(key, "ordinal", *[F.col(m).try_cast("double").alias(m) for m in metrics], verdict.alias("verdict"), note.alias("note"))
    return t.groupBy(key).agg(F.max_by(F.struct(*[c for c in t.columns if c not in (key, "ordinal")]), "ordinal").alias("r")).select(key, "r.*")


def abstract(positions: Column) -> Column:
    """Text from a map of words to their places."""
    entries = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(entries), lambda x: x["w"]), " ")


def batches(ids: DataFrame, key: str, size: int = 25) -> DataFrame:
    """ids with batch: in order of the key, size to a batch.

    Rows are numbered in ranges of the key; a range's rows go on from those of the ranges
    before it, of which one count each comes to the driver.
    """
    from pyspark.sql.window import Window

    dealt = written(ids.repartitionByRange(F.col(key)).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("__range").count().collect())
    before, starts = 0, []
    for number, n in counts:
        starts.append((number, before))
        before += n
    offsets = ids.sparkSession.createDataFrame(starts, "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key)) + F.col("__before")
    # a row for each range: as few as partitions
    return dealt.join(F.broadcast(offsets), "__range").withColumn("batch", F.ceil(place / size).cast("long")).drop("__range", "__before")


def audit_rows(spark: SparkSession, path: str) -> DataFrame:
    """The gold CSV as audits read it: id, question, passage, urls, is_probe, unanswerable_no_passage.

    A probe has no address, no passage, and the sentinel as its answer, with or without diacritics
    and case, but to the last character: here a full stop makes another answer.
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = csv(spark, path)
    rows = rows if "ID" in rows.columns else rows.withColumn("ID", F.lit(None).cast("string"))
    t = rows.filter(clean(F.col("question")) != "").select(row_id(F.col("ID"), F.col("ordinal")).alias("id"), clean(F.col("question")).alias("question"), clean(F.col("text_contains_answer_in_the_doc")).alias("passage"), urls(F.col("doc_link")).alias("urls"), F.lower(fold(clean(F.col("answer")))).alias("said"))
    is_probe = (F.size("urls") == 0) & (F.col("passage") == "") & (F.col("said") == F.lower(fold(F.lit(SENTINEL))))
    return t.select("id", "question", "passage", "urls", is_probe.alias("is_probe"), ((F.col("passage") == "") & ~is_probe).alias("unanswerable_no_passage"))


def audit_text(path: Column, text: Column) -> Column:
    """(text, pages, has_text_layer) of a delivered file: plain text and pages as they are, nothing of other kinds."""
    known = F.lower(F.coalesce(path, F.lit(""))).rlike(r"\.(?:txt|html|htm)$")
    own = F.when(known, F.coalesce(text, F.lit(""))).otherwise("")
    return F.struct(own.alias("text"), F.lit(0).alias("pages"), (F.trim(own) != "").alias("has_text_layer"))


def positional(spark: SparkSession, path: str, needed: tuple[str, ...] = ()) -> tuple[list[str], DataFrame]:
    """(names, rows (ordinal, cells)) of a CSV read by position; raises if a needed name is missing."""
    df = csv(spark, path, header=False)
    cells = [c for c in df.columns if c != "ordinal"]
    first = df.orderBy("ordinal").select(*cells).first()
    names = [(x or "").lstrip("\ufeff") for x in first] if first else []
    missing = [c for c in needed if c not in names]
    require(not missing, f"the CSV lacks columns: {missing}")
    return names, df.filter("ordinal > 1").select((F.col("ordinal") - 1).alias("ordinal"), F.array(*cells).alias("cells"))
