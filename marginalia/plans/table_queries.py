"""Tables over scored answers, guards, prompts and grids, stores, agreement, samples, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as t
from marginalia.operators import gold, matching, prompts, scoring, segment, tables, validate
from marginalia.plans.fixtures import ANSWERS_SQL, MODELS, MODES, answers, gold_rows, legal_documents, scored_rows, table
from marginalia.plans.legal_queries import _GOLD, _SCORE, _TYPES
from marginalia.sources import files, store
from marginalia.sources.scratch import new_folder

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Scored answers as columns follow from their kind.
_RECORDS = f"""
{ANSWERS_SQL}, records AS (SELECT question_id, model_name, retrieval_mode, l_orderkey, kind, asked AS is_answerable, kind = 5 AS abstained, kind = 6 AS hedged,
  CASE WHEN asked THEN CASE WHEN kind IN (0, 3, 6) THEN 1.0 ELSE 0.0 END END AS p, {_SCORE} AS score, list_distinct({_TYPES}) AS types, len({_TYPES}) > 0 AS hallucinated,
  CASE WHEN retrieval_mode = 'closed_book' OR kind = 5 THEN NULL WHEN kind IN (0, 4, 6) THEN 1.0 WHEN kind IN (1, 2) THEN 0.5 ELSE 0.0 END AS grounded,
  l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AS publishable FROM sentences)
"""


def records(spark, sf):
    return scoring.score_responses(scored_rows(spark, sf))


def _cheap(spark, sf):
    """Records with the columns that tables need, by kind and not by scoring: what tables are tested on."""
    k = F.col("kind")
    asked = F.col("asked")
    types = F.array_compact(F.array(F.when(~asked & (k != 5), "ANSWERED_UNANSWERABLE"), F.when(asked & (k == 2), "WRONG_INSTRUMENT"), F.when(asked & (k == 1), "NON_COVERING_PROVISION"), F.when(asked & (k == 3), "NUMERIC_THRESHOLD_MISMATCH")))
    right = F.when(asked, F.when(k.isin(0, 3, 6), 1.0).otherwise(0.0))
    score = F.when(~asked, F.when(k == 5, 2.0).otherwise(0.0)).when(k.isin(3, 5), 0.0).when(k.isin(1, 2), 1.0).otherwise(2.0)
    ground = F.when((F.col("retrieval_mode") == "closed_book") | (k == 5), None).when(k.isin(0, 4, 6), 1.0).when(k.isin(1, 2), 0.5).otherwise(0.0)
    cite = F.struct(F.col("doc").alias("doc_id"), F.col("article").cast("string").alias("article_id"), F.col("clause").cast("string").alias("clause_id"))
    said = F.struct(F.col("doc").alias("doc_id"), F.when(k == 1, F.col("article") + 100).otherwise(F.col("article")).cast("string").alias("article_id"), F.col("clause").cast("string").alias("clause_id"))
    return scored_rows(spark, sf).withColumns({
        "types": types, "hallucinated": F.size(types) > 0, "abstained": k == 5, "hedged": k == 6, "citation_precision": right, "citation_recall": right, "citation_scorable": asked, "correctness_score": score, "groundedness": ground,
        "gold_doc_unresolved": F.lit(False), "anomaly": F.lit(""), "passage_shape": F.when(asked, "short").otherwise("empty"), "overlap_class": F.when(ground.isNull(), "unmeasured").otherwise("high"),
        "first_gold": F.when(asked, cite), "cited": F.when(k.isin(4, 5), F.array().cast("array<struct<doc_id:string,article_id:string,clause_id:string>>")).otherwise(F.array(said)), "metric_status": F.lit("final"),
    })


_CHEAP = f"""
{ANSWERS_SQL}, records AS (SELECT question_id, model_name, retrieval_mode, l_orderkey, l_linenumber, kind, asked, kind = 5 AS abstained, kind = 6 AS hedged, CASE WHEN asked THEN CASE WHEN kind IN (0, 3, 6) THEN 1.0 ELSE 0.0 END END AS p, {_SCORE} AS score,
  (NOT asked AND kind <> 5) OR (asked AND kind IN (1, 2, 3)) AS hallucinated, asked AND kind IN (1, 2, 3) AS unfaithful,
  CASE WHEN retrieval_mode = 'closed_book' OR kind = 5 THEN NULL WHEN kind IN (0, 4, 6) THEN 1.0 WHEN kind IN (1, 2) THEN 0.5 ELSE 0.0 END AS grounded, l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AS publishable FROM sentences)
"""


@query("a1_publishable_guard", f"WITH {_CHEAP} SELECT count(*) FILTER (publishable) AS kept, count(*) FILTER (NOT publishable) AS refused FROM records")
def _(spark, sf):
    from marginalia.provenance import publishable

    return scored_rows(spark, sf).agg(F.count_if(publishable()).alias("kept"), F.count_if(~publishable()).alias("refused"))


@query("a2_final_guard", f"WITH {_CHEAP} SELECT model_name, count(*) AS rows FROM records WHERE publishable GROUP BY model_name")
def _(spark, sf):
    from marginalia.provenance import assert_final, split_publishable

    kept, _ = split_publishable(_cheap(spark, sf))
    return assert_final(kept).groupBy("model_name").agg(F.count("*").alias("rows"))


@query("a3_publishable_split", f"WITH {_CHEAP} SELECT question_id, publishable FROM records")
def _(spark, sf):
    from marginalia.provenance import split_publishable

    kept, refused = split_publishable(scored_rows(spark, sf))
    return kept.select("question_id", F.lit(True).alias("publishable")).unionByName(refused.select("question_id", F.lit(False).alias("publishable")))


@query("a4_export_summary", f"""
WITH {_CHEAP} SELECT model_name, retrieval_mode, count(*) FILTER (publishable) AS count, count(*) FILTER (NOT publishable) AS refused, round(avg(p) FILTER (publishable), 4) AS avg_citation_precision, round(avg(p) FILTER (publishable), 4) AS avg_citation_recall,
  round(avg(score) FILTER (publishable), 4) AS avg_correctness, round(avg(hallucinated::INT) FILTER (publishable), 4) AS hallucination_rate, round(avg(abstained::INT) FILTER (publishable), 4) AS abstention_rate FROM records GROUP BY 1, 2
""")
def _(spark, sf):
    return tables.export_summary(_cheap(spark, sf)).drop("abstained")


_ABST = """count(*) AS rows, count(*) FILTER (NOT asked) AS probes, count(*) FILTER (asked) AS answerable, count(*) FILTER (NOT asked AND abstained) AS true_positive, count(*) FILTER (asked AND abstained) AS false_abstention,
  count(*) FILTER (asked AND NOT abstained) AS true_negative, count(*) FILTER (NOT asked AND NOT abstained) AS answered_probe, round(count(*) FILTER (asked <> abstained) / count(*)::DOUBLE, 4) AS abstention_accuracy,
  round(count(*) FILTER (NOT asked AND abstained) / nullif(count(*) FILTER (NOT asked), 0)::DOUBLE, 4) AS probe_abstention_rate, round(count(*) FILTER (asked AND abstained) / nullif(count(*) FILTER (asked), 0)::DOUBLE, 4) AS false_abstention_rate,
  round(count(*) FILTER (NOT asked AND abstained) / nullif(count(*) FILTER (abstained), 0)::DOUBLE, 4) AS abstention_precision, round(count(*) FILTER (NOT asked AND abstained) / nullif(count(*) FILTER (NOT asked), 0)::DOUBLE, 4) AS abstention_recall, count(*) FILTER (hedged) AS hedged_then_answered"""


@query("a5_abstention_metrics", f"WITH {_CHEAP} SELECT {_ABST}, 'REFUSED_UNVALIDATED' AS provenance FROM records")
def _(spark, sf):
    return tables.abstention_metrics(_cheap(spark, sf), strict=False)


@query("a6_summarise_records", f"""
WITH {_CHEAP} SELECT model_name, retrieval_mode, count(*) AS count, round(avg(p), 4) AS citation_precision, count(*) FILTER (asked) AS citation_scorable_rows, round(avg(hallucinated::INT), 4) AS hallucination_rate, round(avg(score), 4) AS avg_correctness,
  round(avg(grounded), 4) AS groundedness_mean, count(grounded) AS groundedness_assessable_rows, count(*) FILTER (asked AND grounded IS NOT NULL) AS short_high FROM records GROUP BY 1, 2
""")
def _(spark, sf):
    s = tables.summarise(_cheap(spark, sf), strict=False)
    return s.select("model_name", "retrieval_mode", "count", "citation_precision", "citation_scorable_rows", "hallucination_rate", "avg_correctness", "groundedness_mean", "groundedness_assessable_rows", F.coalesce(F.col("gold_passage_strata")["short/high"], F.lit(0)).alias("short_high"))


@query("a7_grid_guard", f"""
WITH {ANSWERS_SQL}, q AS (SELECT DISTINCT question_id FROM answers), c AS (SELECT model_name, retrieval_mode, question_id, count(*) AS n FROM answers GROUP BY 1, 2, 3)
SELECT CAST((SELECT count(*) FROM q) * 9 - (SELECT count(*) FROM c) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unknown, (SELECT count(*) FROM c WHERE n > 1) AS doubled, (SELECT count(*) FROM answers WHERE l_orderkey % 13 = 0) AS bad_backend,
  (SELECT count(*) FROM answers WHERE l_orderkey % 11 = 0) AS bad_corpus, CAST(0 AS BIGINT) AS empty_answers
""")
def _(spark, sf):
    rows = scored_rows(spark, sf)
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    return tables.grid_problems(rows, one("model_name", MODELS), one("retrieval_mode", MODES), rows.select("question_id").distinct(), {m: "whole" for m in MODES}, "tier2_full")


_TABLE = """count(*) AS rows, count(*) FILTER (asked) AS answerable, count(*) FILTER (NOT asked) AS probes, round(count(*) FILTER (asked AND hallucinated) / nullif(count(*) FILTER (asked), 0)::DOUBLE, 4) AS hallucination_rate_answerable,
  round(avg(grounded), 4) AS groundedness_mean, count(grounded) AS groundedness_assessable_rows, round(count(*) FILTER (NOT asked AND abstained) / nullif(count(*) FILTER (NOT asked), 0)::DOUBLE, 4) AS probe_abstention_rate, count(*) FILTER (NOT asked AND abstained) AS probe_abstained,
  round(count(*) FILTER (asked AND abstained) / nullif(count(*) FILTER (asked), 0)::DOUBLE, 4) AS false_abstention_rate, count(*) FILTER (asked AND abstained) AS false_abstentions, count(*) FILTER (hedged) AS hedged_then_answered, round(avg(p), 4) AS citation_precision,
  round(avg(p), 4) AS citation_recall, CASE WHEN coalesce(round(avg(p), 4), 0) = 0 THEN 0.0 ELSE round(2 * round(avg(p), 4) * round(avg(p), 4) / (2 * round(avg(p), 4)), 4) END AS citation_f1, count(*) FILTER (asked) AS citation_scorable_rows, CAST(0 AS BIGINT) AS citation_unscorable_rows,
  count(*) FILTER (asked) AS clause_gold_rows, round(count(*) FILTER (asked AND kind IN (0, 2, 3, 6) AND kind <> 2) / nullif(count(*) FILTER (asked), 0)::DOUBLE, 4) AS clause_accuracy, count(*) FILTER (unfaithful) AS citation_unfaithfulness_rows"""


@query("a8_table_statistics", f"WITH {_CHEAP} SELECT model_name, {_TABLE} FROM records GROUP BY model_name")
def _(spark, sf):
    rows = _cheap(spark, sf).withColumn("cited", F.when(F.col("kind") == 2, F.transform("cited", lambda c: F.struct(F.lit("1/2023/X").alias("doc_id"), c["article_id"].alias("article_id"), c["clause_id"].alias("clause_id")))).otherwise(F.col("cited")))
    return rows.groupBy("model_name").agg(*tables.table_statistics())


@query("a9_grouping_sets", f"WITH {_CHEAP} SELECT model_name, retrieval_mode, CAST(grouping(model_name) AS INTEGER) AS pooled, {_TABLE} FROM records GROUP BY GROUPING SETS ((model_name, retrieval_mode), (retrieval_mode))")
def _(spark, sf):
    rows = _cheap(spark, sf).withColumn("cited", F.when(F.col("kind") == 2, F.transform("cited", lambda c: F.struct(F.lit("1/2023/X").alias("doc_id"), c["article_id"].alias("article_id"), c["clause_id"].alias("clause_id")))).otherwise(F.col("cited")))
    return tables.tables(rows)


@query("a10_type_histogram", f"WITH {_RECORDS} SELECT type, count(*) AS rows FROM (SELECT unnest(types) AS type FROM records WHERE is_answerable) GROUP BY type")
def _(spark, sf):
    return tables.type_histogram(records(spark, sf))


@query("a11_identical_answers", f"""
WITH {ANSWERS_SQL}, m AS (SELECT 'Q' || l_orderkey AS question_id, model_name, retrieval_mode, max(answer_text) AS answer_text FROM sentences GROUP BY 1, 2, 3),
c AS (SELECT a.answer_text AS x, b.answer_text AS y FROM m AS a JOIN m AS b USING (question_id, model_name) WHERE a.retrieval_mode = 'rag_bm25' AND b.retrieval_mode = 'rag_dense') SELECT count(*) AS total, count(*) FILTER (x = y) AS identical FROM c
""")
def _(spark, sf):
    rows = answers(spark, sf).withColumn("question_id", F.concat(F.lit("Q"), "l_orderkey"))
    return tables.identical_answers(rows)


def _meta(spark, sf):
    """A generation's meta record for each event."""
    e = table(spark, sf, "events")
    pick = lambda values, key: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(key), F.lit(len(values))).cast("int"))
    ranks = lambda n: F.when(F.col("event_id") % n == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return e.select(
        F.concat(F.lit("k"), "event_id").alias("cache_key"), pick(MODELS, "user_id").alias("model_name"), pick(MODES, "event_id").alias("retrieval_mode"), pick(["vllm", "transformers"], "user_id").alias("generation_backend"),
        F.lit("nf4").alias("quant_config"), pick(["m/a", "m/b", "m/c"], "user_id").alias("hf_model_id"), F.when(F.col("event_id") % 8 == 0, "length").otherwise("stop").alias("finish_reason"), (F.col("event_id") % 2 == 0).alias("prompt_exact"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), F.round(F.abs("value"), 3).alias("latency_s"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7000).alias("rag_context_chars"), ranks(5).alias("rag_context_truncated_ranks"), ranks(9).alias("rag_context_dropped_ranks"),
    )


@query("a12_campaign_metadata", """
SELECT ['transformers', 'vllm'] AS generation_backend, ['nf4'] AS quant_config, ['m/a', 'm/b', 'm/c'] AS hf_model_ids, count(*) FILTER (event_id % 8 <> 0) AS stopped, count(*) FILTER (event_id % 8 = 0) AS cut, count(*) FILTER (event_id % 2 = 0) AS prompt_exact_true,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_at, count(*) FILTER (event_id % 3 <> 0) AS rows_stamped, count(*) FILTER (event_id % 5 = 0) AS truncated_rows, count(*) FILTER (event_id % 9 = 0) AS dropped_rows,
  round(avg(CASE WHEN event_id % 3 <> 0 THEN event_id % 7000 END), 4) AS mean_chars, max(CASE WHEN event_id % 3 <> 0 THEN event_id % 7000 END) AS max_chars FROM events
""")
def _(spark, sf):
    return tables.campaign(_meta(spark, sf))


@query("a12_latencies", "SELECT ['alpha', 'beta', 'gamma'][CAST(user_id % 3 AS INTEGER) + 1] AS model_name, ['closed_book', 'rag_bm25', 'rag_dense'][CAST(event_id % 3 AS INTEGER) + 1] AS retrieval_mode, round(avg(round(abs(value), 3)), 4) AS latency_s, count(*) AS rows FROM events GROUP BY 1, 2")
def _(spark, sf):
    return tables.latencies(_meta(spark, sf))


@query("a13_example_picker", f"""
WITH {_CHEAP}, e AS (SELECT question_id, model_name, retrieval_mode, score, CASE kind WHEN 1 THEN 'NON_COVERING_PROVISION' ELSE 'WRONG_INSTRUMENT' END AS type, row_number() OVER (PARTITION BY kind ORDER BY l_orderkey, l_linenumber) AS n FROM records WHERE asked AND kind IN (1, 2))
SELECT question_id, model_name, retrieval_mode, type, score AS correctness_score FROM e WHERE n <= 3
""")
def _(spark, sf):
    return tables.examples(_cheap(spark, sf).withColumn("ordinal", F.struct("l_orderkey", "l_linenumber")))


_COND = "CASE WHEN kind IN (4, 5) THEN 'ABSENT' WHEN l_orderkey % 5 = 0 THEN 'TRUNCATED' ELSE 'INTACT' END"


def _conditioned(spark, sf):
    chunk = F.concat(F.lit("c"), "question_id")
    seen = F.when(F.col("kind") == 4, F.array(F.lit("other"))).otherwise(F.array(F.lit("other"), chunk))
    visible = tables.visible_head(F.col("gold_sentence"), F.concat(F.lit("Câu hỏi: "), F.when(F.col("kind") == 5, "").otherwise(F.col("gold_sentence"))))
    cut = F.when(F.col("l_orderkey") % 10 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    gone = F.when(F.col("l_orderkey") % 10 == 5, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    return _cheap(spark, sf).withColumn("gold_chunk", chunk).withColumn("retrieved", seen).withColumn("condition", tables.condition(chunk, seen, visible, cut, gone)).withColumn("older", tables.older_condition(chunk, seen, visible, cut))


@query("c16_context_condition", f"WITH {_CHEAP} SELECT question_id, {_COND} AS condition FROM records")
def _(spark, sf):
    return _conditioned(spark, sf).select("question_id", "condition")


@query("c17_older_condition", f"WITH {_CHEAP} SELECT question_id, CASE WHEN kind IN (4, 5) THEN 'ABSENT' WHEN l_orderkey % 10 = 0 THEN 'TRUNCATED' ELSE 'INTACT' END AS older FROM records")
def _(spark, sf):
    return _conditioned(spark, sf).select("question_id", "older")


@query("a14_conditioned_split", f"WITH {_CHEAP} SELECT retrieval_mode, {_COND} AS condition, count(*) AS rows, count(*) FILTER (unfaithful) AS unfaithful, count(*) FILTER (abstained) AS refused FROM records WHERE asked GROUP BY 1, 2")
def _(spark, sf):
    return tables.conditioned(_conditioned(spark, sf))


@query("a15_two_denominators", f"""
WITH {_CHEAP} SELECT model_name, retrieval_mode, count(*) AS answerable, count(*) FILTER (hallucinated) AS hallucinated, round(avg(hallucinated::INT), 4) AS rate_all, count(*) FILTER (NOT abstained) AS answered,
  round(count(*) FILTER (NOT abstained AND hallucinated) / nullif(count(*) FILTER (NOT abstained), 0)::DOUBLE, 4) AS rate_answered FROM records WHERE asked GROUP BY 1, 2
""")
def _(spark, sf):
    return tables.two_denominators(_cheap(spark, sf))


@query("r11_presence_by_mode", f"WITH {_CHEAP} SELECT retrieval_mode, count(DISTINCT question_id) FILTER (kind <> 4) AS retrieved_questions, count(DISTINCT question_id) FILTER (kind NOT IN (4, 5)) AS visible_questions FROM records GROUP BY 1")
def _(spark, sf):
    return tables.gold_presence(_conditioned(spark, sf))


@query("c18_strata", f"WITH {_CHEAP} SELECT question_id, CASE WHEN NOT asked THEN 'probe' WHEN abstained THEN 'false_abstention' WHEN hallucinated THEN 'ans_hallucinated' ELSE 'ans_clean' END AS stratum FROM records")
def _(spark, sf):
    return _cheap(spark, sf).select("question_id", validate.stratum(F.col("is_answerable"), F.col("abstained"), F.col("hallucinated")).alias("stratum"))


@query("a19_describe_corpus", "SELECT concat('D', s_suppkey) AS doc_id, CAST(CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 2 + n + (n + 1) // 2 END AS BIGINT) AS chunks, CAST(n + 2 AS BIGINT) AS articles, 'tier2_full' AS corpus_source, true AS publishable FROM (SELECT s_suppkey, s_suppkey % 4 + 1 AS n FROM supplier) WHERE s_suppkey % 5 <> 4")
def _(spark, sf):
    return tables.describe_corpus(segment.chunks(legal_documents(spark, sf)))


@query("a20_single_tier", "SELECT 'tier2_full' AS tier, count(*) AS documents FROM supplier WHERE s_suppkey % 5 <> 4")
def _(spark, sf):
    from marginalia.provenance import single_tier

    chunks = segment.chunks(legal_documents(spark, sf))
    return chunks.agg(F.count_distinct("doc_id").alias("documents")).select(F.lit(single_tier(chunks, "tier2_full")).alias("tier"), "documents")


@query("a22_null_skipping_mean", "SELECT n_regionkey, round(avg(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 7.0 END), 4) AS m FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    v = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 7.0)
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(tables.mean(v).alias("m"))


# --- prompts, grid, resume ------------------------------------------------------------
@query("g1_prompts", "SELECT item_id, CAST(length(text) AS BIGINT) + " + str(len(prompts.CLOSED[0]) + len(prompts.CLOSED[1])) + " AS closed_chars, CAST(2 * length(text) AS BIGINT) + " + str(sum(map(len, prompts.RAG))) + " AS rag_chars FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.length(prompts.closed_book(F.col("text"))).cast("long").alias("closed_chars"), F.length(prompts.rag_prompt(F.col("text"), F.col("text"))).cast("long").alias("rag_chars"))


_HEAD, _MARK = len("--- Tài liệu tham khảo [1] ---\n"), len(t.TRUNCATED) + 1


@query("g2_budgeted_context", f"""
WITH l AS (SELECT c_custkey, [100 + c_custkey * 37 % 4000, 50 + c_custkey * 91 % 5000, 30 + c_custkey * 13 % 3000] AS n FROM customer),
a AS (SELECT *, least(n[1], 3500) + {_HEAD} + CASE WHEN n[1] > 3500 THEN {_MARK} ELSE 0 END AS u1, n[1] > 3500 AS t1 FROM l),
b AS (SELECT *, 7000 - u1 AS r1 FROM a), c AS (SELECT *, r1 < 400 AS d2, least(3500, r1) AS a2 FROM b),
d AS (SELECT *, CASE WHEN d2 THEN u1 ELSE u1 + least(n[2], a2) + {_HEAD} + CASE WHEN n[2] > a2 THEN {_MARK} ELSE 0 END END AS u2, NOT d2 AND n[2] > a2 AS t2 FROM c),
e AS (SELECT *, d2 OR 7000 - u2 < 400 AS d3, least(3500, 7000 - u2) AS a3 FROM d), f AS (SELECT *, CASE WHEN d3 THEN u2 ELSE u2 + least(n[3], a3) + {_HEAD} + CASE WHEN n[3] > a3 THEN {_MARK} ELSE 0 END END AS u3, NOT d3 AND n[3] > a3 AS t3 FROM e)
SELECT c_custkey, CAST(u3 + 2 * (2 - d2::INT - d3::INT) AS BIGINT) AS context_chars, CAST(t1::INT + t2::INT + t3::INT AS INTEGER) AS truncated, CAST(d2::INT + d3::INT AS INTEGER) AS dropped FROM f
""")
def _(spark, sf):
    k = F.col("c_custkey")
    lengths = [100 + k * 37 % 4000, 50 + k * 91 % 5000, 30 + k * 13 % 3000]
    passages = F.array(*[F.rpad(F.lit(""), n.cast("int"), F.lit("x")) for n in lengths])
    p = prompts.pack(passages)
    return table(spark, sf, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p.context_chars", F.size("p.truncated_ranks").alias("truncated"), F.size("p.dropped_ranks").alias("dropped"))


@query("g3_prompt_field", "SELECT item_id, item_id % 2 = 0 AS exact, CASE WHEN item_id % 2 = 0 THEN CAST(length(text) AS BIGINT) ELSE CAST(length(text) + length(regexp_replace(text, '[^\"\\\\\t\n\r]', '', 'g')) + length('[messages] [{\"role\":\"user\",\"content\":\"\"}]') AS BIGINT) END AS chars FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    exact = F.col("item_id") % 2 == 0
    return b.select("item_id", exact.alias("exact"), F.length(prompts.prompt_field(F.col("text"), exact)).cast("long").alias("chars"))


@query("g4_grid", "SELECT r_name AS model_name, n_name AS retrieval_mode, item_id AS question_id FROM region, nation, benchmark")
def _(spark, sf):
    return prompts.grid(table(spark, sf, "region").select(F.col("r_name").alias("model_name")), table(spark, sf, "nation").select(F.col("n_name").alias("retrieval_mode")), table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id")))


@query("g5_cache_key", "SELECT item_id, substr(sha256(concat('Q', item_id, ':m:closed_book:', substr(sha256(concat(text, '|a|')), 1, 16), ':h')), 1, 24) AS cache_key FROM benchmark")
def _(spark, sf):
    content = prompts.question_hash(F.col("text"), F.lit("a"), F.lit(None).cast("string"))
    return table(spark, sf, "benchmark").select("item_id", prompts.cache_key(F.concat(F.lit("Q"), "item_id"), F.lit("m"), F.lit("closed_book"), content, F.lit("h")).alias("cache_key"))


@query("g6_corpus_hash", r"WITH h AS (SELECT sha256(concat(CAST(doc_id AS VARCHAR), chr(31), trim(regexp_replace(text, '\s+', ' ', 'g')), chr(30))) AS h FROM documents) SELECT sha256(concat_ws(',', count(*), sum(('0x' || h[1:15])::BIGINT), sum(('0x' || h[16:30])::BIGINT), sum(('0x' || h[31:45])::BIGINT), sum(('0x' || h[46:60])::BIGINT), sum(('0x' || h[61:64])::BIGINT))) AS corpus_hash FROM h")
def _(spark, sf):
    return prompts.corpus_hash(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), ("doc_id", "text"))


@query("g7_resume", "SELECT concat('k', event_id) AS cache_key, 'vllm' AS backend FROM events WHERE event_id % 3 <> 0")
def _(spark, sf):
    cells = table(spark, sf, "events").select(F.concat(F.lit("k"), "event_id").alias("cache_key"), F.lit("vllm").alias("backend"))
    return prompts.resume(cells, cells.filter("cast(substring(cache_key, 2) as bigint) % 3 = 0"))


@query("g7_resume_other_backend", "SELECT concat('k', event_id) AS cache_key, 'vllm' AS backend FROM events WHERE event_id % 6 <> 0")
def _(spark, sf):
    cells = table(spark, sf, "events").select(F.concat(F.lit("k"), "event_id").alias("cache_key"), F.lit("vllm").alias("backend"))
    done = table(spark, sf, "events").filter("event_id % 3 = 0").select(F.concat(F.lit("k"), "event_id").alias("cache_key"), F.when(F.col("event_id") % 2 == 0, "vllm").otherwise("other").alias("backend"))
    return prompts.resume(cells, done, "regenerate")


@query("g8_retrieve_once", """
SELECT r_name AS model_name, mode AS retrieval_mode, concat('Q', item_id) AS question_id, CAST(CASE WHEN mode = 'closed_book' THEN 0 ELSE item_id % 3 + 1 END AS INTEGER) AS passages FROM region, (SELECT unnest(['closed_book', 'rag_bm25']) AS mode), benchmark
""")
def _(spark, sf):
    q = table(spark, sf, "benchmark").select(F.concat(F.lit("Q"), "item_id").alias("question_id"), "item_id")
    modes = spark.createDataFrame([("closed_book",), ("rag_bm25",)], "retrieval_mode string")
    cells = prompts.grid(table(spark, sf, "region").select(F.col("r_name").alias("model_name")), modes, q)
    found = q.select("question_id", F.lit("rag_bm25").alias("retrieval_mode"), F.explode(F.sequence(F.lit(1), (F.col("item_id") % 3 + 1).cast("int"))).alias("rank")).withColumn("context", F.concat(F.lit("c"), "rank"))
    return prompts.retrieve_once(cells, found).select("model_name", "retrieval_mode", "question_id", F.size("passages").alias("passages"))


@query("g11_stub_backend", "SELECT item_id, CASE WHEN item_id IN (0, 3) THEN 'Không có trong kho văn bản' ELSE concat('A', item_id) END AS answer FROM benchmark")
def _(spark, sf):
    q = F.concat(F.lit("<"), "item_id", F.lit(">"))
    return table(spark, sf, "benchmark").select("item_id", prompts.stub_answer(F.concat(F.lit("Câu hỏi: "), q), ["<0>", "<3>"], F.concat(F.lit("A"), "item_id")).alias("answer"))


@query("g13_output_checks", """
SELECT n_nationkey, [NULL, 'empty-output', 'template-markup-in-output', 'repetition-single-token', 'not-vietnamese', 'hit-max-new-tokens'][CAST(n_nationkey % 6 AS INTEGER) + 1] AS first, n_nationkey % 6 IN (0, 5) AS ok FROM nation
""")
def _(spark, sf):
    k = F.col("n_nationkey") % 6
    fine = "Theo quy định của ngân hàng, hạn mức giao dịch thẻ là năm mươi triệu đồng mỗi ngày."
    text = F.when(k == 1, "  \n").when(k == 2, fine + " <|im_end|>").when(k == 3, F.concat(F.lit(fine), F.repeat(F.lit(" không"), 13))).when(k == 4, "The limit for card transactions is fifty million a day for all").otherwise(fine)
    rows = table(spark, sf, "nation").select("n_nationkey", text.alias("text"), F.when(k == 5, "length").otherwise("stop").alias("finish_reason"))
    return prompts.check_outputs(rows, "n_nationkey", "text", finish_reason="finish_reason").select("n_nationkey", F.get("findings", F.lit(0))["code"].alias("first"), "ok")


@query("g14_repetition", r"""
WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM w, unnest(range(1, len(w) - 2)) AS r(i)),
c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT doc_id, i, w[i] AS t, i - row_number() OVER (PARTITION BY doc_id, w[i] ORDER BY i) AS island FROM w, unnest(range(1, len(w) + 1)) AS r(i)), runs AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, t, island, count(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1)
SELECT doc_id, max(n) AS top_count, CAST(max(run) AS INTEGER) AS longest_run FROM c JOIN runs USING (doc_id) GROUP BY doc_id
""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    run = prompts.longest_run(F.filter(F.split(t.squeeze(F.col("text")), " "), lambda x: x != ""))
    return prompts.repeated_grams(docs, "doc_id", "text").join(docs.select("doc_id", run.alias("longest_run")), "doc_id").select("doc_id", "top_count", "longest_run")


@query("g15_language_check", "SELECT doc_id, CASE WHEN length(trim(text)) >= 20 AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 20 AND v < 0.01 THEN h = 0 ELSE false END AS foreign FROM (SELECT doc_id, text, (length(text) - length(regexp_replace(text, '[" + t.vietnamese_letters() + "]', '', 'g'))) / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0)::DOUBLE AS v, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in t.VIETNAMESE_WORDS) + " AS h FROM documents)")
def _(spark, sf):
    found = prompts.check_outputs(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", F.exists("findings", lambda f: f["code"] == "not-vietnamese").alias("foreign"))


@query("g16_question_echo", r"""
WITH u AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS a FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, length(q) >= 25 AND contains(a, q) AND length(a) < 1.6 * length(q) AS echoes FROM u JOIN a USING (conv_id, turn)
""")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    pairs = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text").join(u, ["conv_id", "turn"])
    q, a = F.lower(t.squeeze(F.col("question"))), F.lower(t.squeeze(F.col("text")))
    return pairs.select("conv_id", "turn", ((F.length(q) >= 25) & F.contains(a, q) & (F.length(a) < 1.6 * F.length(q))).alias("echoes"))


@query("g18_backend_pooling", f"WITH {ANSWERS_SQL} SELECT model_name, count(DISTINCT CASE WHEN l_orderkey % 13 = 0 THEN 'DEGRADED:stub' ELSE 'whole' END) AS backends FROM answers GROUP BY 1")
def _(spark, sf):
    return scored_rows(spark, sf).groupBy("model_name").agg(F.count_distinct("retriever_backend").alias("backends"))


@query("g19_provenance_summary", f"WITH {_CHEAP} SELECT model_name, 'DEGRADED:stub,whole' AS backends, 'tier1_passages,tier2_full' AS corpora, count(*) AS rows, count(*) FILTER (NOT publishable) AS refused_rows FROM records GROUP BY 1")
def _(spark, sf):
    return tables.provenance_summary(scored_rows(spark, sf))


@query("g20_newest_run", "SELECT r_name AS run FROM region WHERE r_regionkey % 2 = 0 ORDER BY r_regionkey DESC LIMIT 1")
def _(spark, sf):
    runs = table(spark, sf, "region").select(F.col("r_name").alias("run"), F.col("r_regionkey").alias("started_at"), F.when(F.col("r_regionkey") % 2 == 0, 5).otherwise(0).alias("rows"))
    return store.newest_run(runs).select("run")


@query("p15_prompt_blocks", "SELECT item_id, CAST(CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS blocks, CASE WHEN item_id % 2 = 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS first FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    context = prompts.unbounded_context(F.array("text", F.lit("khác")))
    prompt = F.when(F.col("item_id") % 2 == 0, prompts.rag_prompt(F.lit("q?"), context)).otherwise(prompts.closed_book(F.col("text")))
    blocks = segment.prompt_blocks(prompt)
    return b.select("item_id", F.size(blocks).alias("blocks"), F.get(blocks, F.lit(0)).alias("first"))


@query("p16_resolve_contexts", "SELECT item_id, ['caller_contexts', 'retrieved_results', 'prompt_recovered', 'none'][CAST(item_id % 4 AS INTEGER) + 1] AS source FROM benchmark")
def _(spark, sf):
    k = F.col("item_id") % 4
    none = F.array().cast("array<string>")
    prompt = F.when(k == 3, F.lit("x")).otherwise(prompts.rag_prompt(F.lit("q"), prompts.unbounded_context(F.array("text"))))
    return table(spark, sf, "benchmark").select("item_id", segment.resolve_contexts(F.when(k == 0, F.array("text")).otherwise(none), F.when(k == 1, F.array("text")).otherwise(none), prompt)["source"].alias("source"))


# --- sources and stores -----------------------------------------------------------------
def _log(spark, sf):
    """Checkpoint lines of events: every 50th torn, every 70th not an object, every 90th without a key; keys come again."""
    e = table(spark, sf, "events")
    good = F.to_json(F.struct(F.concat("user_id", F.lit("-"), "event_type").alias("cache_key"), F.col("value").alias("latency_s"), F.col("event_id").alias("n")))
    i = F.col("event_id")
    line = F.when(i % 50 == 1, F.substring(good, 1, 15)).when(i % 70 == 2, F.lit("[1]")).when(i % 90 == 3, F.lit('{"n": 1}')).otherwise(good)
    return e.select(i.alias("ordinal"), line.alias("value"))


_LOG = "e AS (SELECT *, concat(user_id, '-', event_type) AS cache_key, event_id % 50 = 1 OR (event_id % 70 = 2 AND event_id % 50 <> 1) AS broken, event_id % 90 = 3 AND event_id % 50 <> 1 AND event_id % 70 <> 2 AS keyless FROM events)"


@query("s9_checkpoint_last_wins", f"WITH {_LOG} SELECT cache_key, min(event_id) AS first_ordinal, max(event_id) AS n FROM e WHERE NOT broken AND NOT keyless GROUP BY cache_key")
def _(spark, sf):
    records_, _ = files.checkpoint_lines(_log(spark, sf), "cache_key string, latency_s double, n bigint")
    return records_.select("cache_key", "first_ordinal", "n")


@query("s9_checkpoint_problems", f"WITH {_LOG} SELECT CASE WHEN broken THEN 'not_a_record' ELSE 'no_cache_key' END AS problem, count(*) AS lines FROM e WHERE broken OR keyless GROUP BY 1")
def _(spark, sf):
    return files.checkpoint_lines(_log(spark, sf), "cache_key string, latency_s double, n bigint")[1]


@query("s10_generations_with_meta", "SELECT DISTINCT concat('k', user_id) AS cache_key, (SELECT max(event_id) FROM events AS m WHERE m.user_id = e.user_id AND m.event_id % 2 = 0) AS n FROM events AS e")
def _(spark, sf):
    e = table(spark, sf, "events")
    gens = e.select(F.concat(F.lit("k"), "user_id").alias("cache_key")).distinct()
    meta = e.filter("event_id % 2 = 0").select(F.concat(F.lit("k"), "user_id").alias("cache_key"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("n"))
    return files.with_meta(gens, meta)


@query("s7_answerable_and_probes", f"WITH {_GOLD} SELECT count(*) FILTER (NOT probe) AS answerable, count(*) FILTER (probe) AS probes FROM g")
def _(spark, sf):
    asked, rest = files.answerable_and_probes(gold.questions_from_rows(gold_rows(spark, sf)))
    return asked.agg(F.count("*").alias("answerable")).join(rest.agg(F.count("*").alias("probes")))


@query("s12_layer_choice", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'pdfplumber' ELSE 'ocr' END AS tag FROM supplier")
def _(spark, sf):
    good = F.lit("Điều 1. Phạm vi điều chỉnh của thông tư này")
    layers = F.array(F.struct(F.when(F.col("s_suppkey") % 2 == 0, good).otherwise("Dieu 1. Pham vi").alias("text"), F.lit("pdfplumber").alias("tag")), F.struct(F.lit("garbled").alias("text"), F.lit("pypdf").alias("tag")), F.struct(good.alias("text"), F.lit("ocr").alias("tag")))
    return table(spark, sf, "supplier").select("s_suppkey", files.choose_layer(layers)["tag"].alias("tag"))


@query("s13_ocr_header", "SELECT n_nationkey, n_name AS text FROM nation")
def _(spark, sf):
    raw = F.concat(F.lit("<!-- ocr: page 1\n-->\n"), "n_name")
    return table(spark, sf, "nation").select("n_nationkey", files.without_header(raw).alias("text"))


@query("s15_extractor_dispatch", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE concat('A', chr(10), n_name) END AS text FROM nation")
def _(spark, sf):
    even = F.col("n_nationkey") % 2 == 0
    raw = F.when(even, F.col("n_name")).otherwise(F.concat(F.lit("<nav>x</nav><h1>A</h1><p>"), "n_name", F.lit("</p>")))
    return table(spark, sf, "nation").select("n_nationkey", files.extracted(F.when(even, "txt").otherwise("HTML"), raw).alias("text"))


@query("s18_ingest_plan", "SELECT n_name AS doc_id, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 999 ELSE n_nationkey END AS INTEGER) AS priority FROM nation WHERE n_nationkey % 5 NOT IN (1, 2)")
def _(spark, sf):
    status = F.when(F.col("n_nationkey") % 5 == 1, "skipped").when(F.col("n_nationkey") % 5 == 2, "blocked").when(F.col("n_nationkey") % 5 == 3, "ready")
    plan = table(spark, sf, "nation").select(F.col("n_name").alias("doc_id"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).cast("int").alias("priority"), status.alias("status"))
    return files.plan_order(plan).select("doc_id", "priority")


@query("s20_request_batches", "SELECT c_custkey, CAST((c_custkey - (SELECT min(c_custkey) FROM customer)) // 25 + 1 AS BIGINT) AS batch FROM customer")
def _(spark, sf):
    return files.batches(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query("s21_abstract_decode", "SELECT n_nationkey, concat('we study ', n_name, ' and we like ', n_name) AS abstract FROM nation")
def _(spark, sf):
    places = lambda *p: F.array(*[F.lit(x) for x in p])
    m = F.create_map(F.lit("we"), places(0, 4), F.lit("study"), places(1), F.col("n_name"), places(2, 6), F.lit("and"), places(3), F.lit("like"), places(5))
    return table(spark, sf, "nation").select("n_nationkey", files.abstract(m).alias("abstract"))


def _events(spark, sf):
    return table(spark, sf, "events").select(F.concat("user_id", F.lit("-"), "event_type").alias("cache_key"), "event_id", "value")


_LAST = "SELECT cache_key, max(event_id) AS event_id FROM (SELECT concat(user_id, '-', event_type) AS cache_key, event_id FROM events) GROUP BY cache_key"


@query("k6_upsert", _LAST)
def _(spark, sf):
    e = _events(spark, sf)
    half = F.lit(table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2)
    old = store.last_of(e.filter(F.col("event_id") <= half), ["cache_key"], "event_id")
    new = store.last_of(e.filter(F.col("event_id") > half), ["cache_key"], "event_id")
    return store.upsert(old, new, ["cache_key"]).select("cache_key", "event_id")


@query("k3_repository", f"WITH {ANSWERS_SQL} SELECT model_name, retrieval_mode, count(*) AS count, count(*) FILTER (kind = 5) AS abstained FROM sentences WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 GROUP BY 1, 2")
def _(spark, sf):
    kept = _cheap(spark, sf).select("question_id", "model_name", "retrieval_mode", "abstained", "hallucinated", "citation_precision", "citation_recall", "correctness_score", "corpus_source", "retriever_backend")
    repo = store.Memory()
    repo.save_evaluations(kept.withColumn("abstained", F.lit(False)))
    repo.save_evaluations(kept)
    return repo.summary().select("model_name", "retrieval_mode", "count", "abstained")


@query("k4_point_lookup", f"WITH {ANSWERS_SQL} SELECT question_id, kind FROM sentences ORDER BY l_orderkey, l_linenumber LIMIT 1")
def _(spark, sf):
    rows = answers(spark, sf)
    first = rows.orderBy("l_orderkey", "l_linenumber").select(*store.KEY).first()
    repo = store.Memory()
    repo.save_evaluations(rows)
    return repo.evaluations(first[1], first[2]).filter(F.col("question_id") == first[0]).select("question_id", "kind")


@query("k5_filters", f"WITH {ANSWERS_SQL} SELECT model_name, retrieval_mode, count(*) AS rows FROM answers WHERE model_name = 'beta' GROUP BY 1, 2")
def _(spark, sf):
    return store.filtered(answers(spark, sf), "beta", "").groupBy("model_name", "retrieval_mode").agg(F.count("*").alias("rows"))


@query("k9_purge", "SELECT concat(user_id, '-', event_type) AS cache_key, event_id FROM events WHERE NOT (event_type = 'click' AND event_id % 2 = 0)")
def _(spark, sf):
    kept, _ = store.purge(_events(spark, sf), F.endswith("cache_key", F.lit("-click")) & (F.col("event_id") % 2 == 0))
    return kept.select("cache_key", "event_id")


@query("k10_materialise", "SELECT concat('k', event_id) AS cache_key FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("k"), "event_id").alias("cache_key"))
    once = store.materialise(rows.filter("cast(substring(cache_key, 2) as bigint) % 4 = 0"), rows)
    return store.materialise(once, rows)


@query("k11_split_record", "SELECT concat('k', event_id) AS cache_key, event_type, concat('{\"props\":', to_json(props), '}') IS NOT NULL AS extra FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("k"), "event_id").alias("cache_key"), "event_type", "value", "props")
    generation, meta = store.split_record(rows, ["cache_key", "event_type"], ["cache_key", "value"])
    return generation.join(meta, "cache_key").select("cache_key", "event_type", F.col("extra").isNotNull().alias("extra"))


@query("k12_meta_orphans", "SELECT concat('k', event_id) AS cache_key FROM events WHERE event_id % 100 = 0")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.when(F.col("event_id") % 100 == 1, F.lit(" ")).otherwise(F.concat(F.lit("k"), "event_id")).alias("cache_key"), "event_id")
    return store.orphans(rows, rows.filter("event_id % 100 > 1"))


@query("k14_meta_enrich", "SELECT concat('k', event_id) AS cache_key, CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END AS latency FROM events")
def _(spark, sf):
    meta = table(spark, sf, "events").select(F.concat(F.lit("k"), "event_id").alias("cache_key"), F.col("value").alias("latency"))
    over = meta.filter("cast(substring(cache_key, 2) as bigint) % 2 = 0").withColumn("latency", F.col("latency") * 2)
    return store.enrich(meta, over, ["latency"])


@query("k18_checkpoint_lookups", "SELECT concat(user_id, '-', event_type) AS cache_key, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def _(spark, sf):
    return _events(spark, sf).groupBy("cache_key").agg(F.min("event_id").alias("first"), F.max_by("event_id", "event_id").alias("last"))


# --- agreement, samples, ranks ------------------------------------------------------------
_PAIRS = "l AS (SELECT quality AS a, toxic AS b FROM labels), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) AS same FROM l), e AS (SELECT sum(x * y) AS meet FROM (SELECT a AS c, count(*) AS x FROM l GROUP BY a) JOIN (SELECT b AS c, count(*) AS y FROM l GROUP BY b) USING (c))"


@query("v1_kappa", f"WITH {_PAIRS} SELECT CAST(n AS BIGINT) AS n, round(same / n, 4) AS agreement, round((same / n - meet / (n * n)) / (1 - meet / (n * n)), 4) AS kappa FROM n, e")
def _(spark, sf):
    return validate.kappa(table(spark, sf, "labels"), "quality", "toxic")


@query("v2_kappa_unrounded", f"WITH {_PAIRS} SELECT round((same / n - meet / (n * n)) / (1 - meet / (n * n)), 9) AS kappa FROM n, e")
def _(spark, sf):
    return validate.kappa(table(spark, sf, "labels"), "quality", "toxic", rounded=False).select(F.round("kappa", 9).alias("kappa"))


def _pairs(spark, sf):
    flag = lambda c: F.col(c) == 1
    return table(spark, sf, "labels").select(F.col("doc_id").alias("question_id"), flag("quality").alias("human_correct"), (~flag("toxic")).alias("auto_correct"), flag("toxic").alias("human_hallucinated"), (F.col("doc_id") % 3 == 0).alias("auto_hallucinated"), (F.col("doc_id") % 5 == 0).alias("human_abstained"), (F.col("doc_id") % 5 == 0).alias("auto_abstained"))


_FLAT = "f AS (SELECT doc_id, 'correct' AS field, quality = 1 AS h, toxic = 0 AS a FROM labels UNION ALL SELECT doc_id, 'hallucinated', toxic = 1, doc_id % 3 = 0 FROM labels UNION ALL SELECT doc_id, 'abstained', doc_id % 5 = 0, doc_id % 5 = 0 FROM labels), c AS (SELECT field, count(*)::DOUBLE AS n, count(*) FILTER (h = a) AS same, count(*) FILTER (h) * count(*) FILTER (a) + count(*) FILTER (NOT h) * count(*) FILTER (NOT a) AS meet, count(*) FILTER (h AND a) AS yy, count(*) FILTER (h AND NOT a) AS yn, count(*) FILTER (NOT h AND a) AS ny, count(*) FILTER (NOT h AND NOT a) AS nn FROM f GROUP BY field)"
_KAPPA = "CASE WHEN meet = n * n THEN 1.0 ELSE round((same / n - meet / (n * n)) / (1 - meet / (n * n)), 4) END"


@query("v3_validation_report", f"WITH {_FLAT} SELECT field, CAST(n AS BIGINT) AS n, round(same / n, 4) AS agreement, {_KAPPA} AS kappa, yy AS both_yes, yn AS human_yes_auto_no, ny AS human_no_auto_yes, nn AS both_no, CAST(yn + ny AS INTEGER) AS differ FROM c")
def _(spark, sf):
    r = validate.validation_report(_pairs(spark, sf))
    return r.select("field", "n", "agreement", "kappa", "both_yes", "human_yes_auto_no", "human_no_auto_yes", "both_no", F.size("disagreements").alias("differ"))


@query("v4_scorer_analysis", f"WITH {_FLAT} SELECT field, CAST(n AS BIGINT) AS n, round(same / n, 4) AS agreement, {_KAPPA} AS kappa, round(yy / nullif(yy + ny, 0)::DOUBLE, 4) AS precision, round(yy / nullif(yy + yn, 0)::DOUBLE, 4) AS recall FROM c")
def _(spark, sf):
    return validate.scorer_analysis(_pairs(spark, sf))


@query("v5_quota_sample", "SELECT quality, toxic, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5(concat('20260913:', doc_id)), doc_id) AS n FROM labels) WHERE n <= CASE WHEN quality = 1 THEN 12 ELSE 6 END")
def _(spark, sf):
    quotas = spark.createDataFrame([(1, 12), (0, 6)], "quality int, quota int")
    return validate.quota_sample(table(spark, sf, "labels"), quotas.join(spark.createDataFrame([(0,), (1,)], "toxic int")), ["quality", "toxic"], "doc_id")


@query("v6_round_robin", "SELECT toxic, doc_id, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('1:', doc_id)), doc_id) - 1) % 2 AS INTEGER) AS part FROM labels")
def _(spark, sf):
    return validate.round_robin(table(spark, sf, "labels"), "toxic", "doc_id").select("toxic", "doc_id", "part")


@query("v7_blind_pack", "WITH r AS (SELECT doc_id, false AS is_ours FROM documents WHERE doc_id <> 5 ORDER BY md5(concat('7:', doc_id)), doc_id LIMIT 48), b AS (SELECT * FROM r UNION ALL SELECT 5, true) SELECT concat('P', lpad(CAST(row_number() OVER (ORDER BY md5(concat('8:', doc_id)), doc_id) AS VARCHAR), 2, '0')) AS blind_id, doc_id, is_ours FROM b")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return validate.blind_pack(docs, docs.filter("doc_id = 5"), "doc_id")


@query("v8_percentile_rank", """
WITH o AS (SELECT o_totalprice AS mine FROM orders WHERE o_orderkey = 7), s AS (SELECT list_sort(list(o_totalprice)) AS v FROM orders)
SELECT mine AS ours, (SELECT count(*) FROM orders WHERE o_totalprice > mine) + 1 AS rank, (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM orders WHERE o_totalprice < mine) AS below, (SELECT count(*) FROM orders WHERE o_totalprice = mine) AS ties, (SELECT count(*) FROM orders WHERE o_totalprice > mine) AS better,
  round((SELECT count(*) FROM orders WHERE o_totalprice < mine) * 100.0 / ((SELECT count(*) FROM orders) - 1), 6) AS strict_pct, round(((SELECT count(*) FROM orders WHERE o_totalprice < mine) + 0.5 * ((SELECT count(*) FROM orders WHERE o_totalprice = mine) - 1)) * 100.0 / ((SELECT count(*) FROM orders) - 1), 6) AS midpoint_pct,
  (SELECT min(o_totalprice) FROM orders) AS least, v[CAST(len(v) // 2 AS INTEGER) + 1] AS upper_median, (SELECT round(avg(o_totalprice), 6) FROM orders) AS mean, (SELECT max(o_totalprice) FROM orders) AS most FROM o, s
""")
def _(spark, sf):
    return validate.percentile_of(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7, "o_totalprice")


@query("v9_arms_report", """
WITH s AS (SELECT p_partkey % 3 AS arm, p_partkey // 3 AS id, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM part), f AS (SELECT arm, id, 'price' AS metric, price AS v FROM s UNION ALL SELECT arm, id, 'size', size FROM s), m AS (SELECT arm, metric, v AS mine FROM f WHERE id = 5),
p AS (SELECT arm, metric, any_value(mine) AS mine, count(*) FILTER (v < mine) * 100.0 / count(*) AS pct FROM f JOIN m USING (arm, metric) WHERE id <> 5 GROUP BY 1, 2) SELECT metric, count(*) AS arms, round(median(mine), 6) AS median_score, round(median(pct), 6) AS median_pct, round(max(pct) - min(pct), 6) AS spread FROM p GROUP BY metric
""")
def _(spark, sf):
    p = table(spark, sf, "part")
    s = p.select((F.col("p_partkey") % 3).alias("arm"), F.floor(F.col("p_partkey") / 3).alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return validate.arms_report(s, "id", 5, ["price", "size"])


@query("q6_article_texts", "SELECT concat('D', s_suppkey) AS doc_id, CAST(i AS VARCHAR) AS article_id, CASE WHEN i % 2 = 0 THEN concat('Điều ', i, chr(10), 'Phạm vi điều chỉnh', chr(10), 'Văn bản này quy định về thẻ.') ELSE concat('Điều ', i, '. Tiêu đề', chr(10), '1. Khoản một.', chr(10), 'Tiếp theo.', chr(10), '2. Khoản hai.') END AS text FROM (SELECT s_suppkey, unnest(range(1, s_suppkey % 4 + 2)) AS i FROM supplier WHERE s_suppkey % 5 <> 4)")
def _(spark, sf):
    return matching.article_texts(segment.chunks(legal_documents(spark, sf))).filter("article_id rlike '^[1-9]'")


@query("q7_passage_repair", "SELECT concat('Q', s_suppkey) AS id, CASE WHEN s_suppkey % 5 = 4 THEN 'no_article' WHEN s_suppkey % 4 = 0 THEN 'repaired' WHEN s_suppkey % 4 = 1 THEN 'already' WHEN s_suppkey % 4 = 2 THEN 'refused' ELSE 'no_article' END AS action FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey") % 4
    whole = F.lit("Điều 1. Tiêu đề\n1. Khoản một.\nTiếp theo.\n2. Khoản hai.")
    passage = F.when(k == 0, "Điều 1: khoản một, khoản hai").when(k == 1, whole).when(k == 2, "Điều 1: một câu tóm tắt hoàn toàn khác hẳn với văn bản gốc về tiền gửi").otherwise("Điều 77: khoản một")
    q = table(spark, sf, "supplier").select(F.concat(F.lit("Q"), "s_suppkey").alias("id"), F.lit(True).alias("is_answerable"), F.array(F.lit("UNRESOLVED:x"), F.concat(F.lit("D"), "s_suppkey")).alias("gold_doc_ids"), passage.alias("gold_passage"))
    return matching.repair(q, segment.chunks(legal_documents(spark, sf))).select("id", "action")


@query("q9_cell_corrections", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'X' ELSE n_name END AS n_name FROM nation")
def _(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    patches = rows.filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("expected"), F.lit("X").alias("value"))
    once, _ = matching.corrections(rows, patches, "n_nationkey", "n_name")
    return matching.corrections(once, patches, "n_nationkey", "n_name")[0]


@query("q10_manifest_updates", "SELECT n_name AS url, CASE n_nationkey % 3 WHEN 0 THEN 'A/1' WHEN 1 THEN 'A/1' ELSE 'B/2' END AS doc_id, CASE n_nationkey % 3 WHEN 0 THEN 'fill' WHEN 1 THEN 'same' ELSE 'conflict' END AS change FROM nation UNION ALL SELECT 'nowhere', 'C/3', 'add'")
def _(spark, sf):
    k = F.col("n_nationkey") % 3
    manifest = table(spark, sf, "nation").select(F.col("n_name").alias("url"), F.when(k == 0, "").when(k == 1, "A/1").otherwise("B/2").alias("doc_id"))
    facts = spark.createDataFrame([("NATION_", "A/1"), ("nowhere", "C/3")], "fragment string, doc_id string")
    return matching.manifest_updates(manifest, facts)


@query("q11_self_match", f"WITH {ANSWERS_SQL} SELECT question_id, 2.0 AS score, 1.0 AS p, false AS hallucinated FROM sentences WHERE asked")
def _(spark, sf):
    rows = scored_rows(spark, sf).filter("asked").withColumn("answer_text", F.col("gold_sentence"))
    return scoring.score_responses(rows).select("question_id", F.col("correctness_score").alias("score"), F.col("citation_precision").alias("p"), "hallucinated")


# --- the log as a stream --------------------------------------------------------------------
@query("stream_upsert", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def _(spark, sf):
    from marginalia.streaming import checkpoints

    folder = _stream_folder(spark)
    stream = _event_stream(spark, sf)
    job = checkpoints.upsert_into(stream, f"{folder}/table", ["user_id", "event_type"], "event_id", f"{folder}/offsets")
    job.awaitTermination()
    versions = [p["batchId"] for p in job.recentProgress if p["numInputRows"]]
    return checkpoints.current(spark, f"{folder}/table", max(versions, default=0) + 1).select("user_id", "event_type", "event_id")


@query("stream_daily_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS rows FROM events GROUP BY 1, 2")
def _(spark, sf):
    from marginalia.streaming import checkpoints

    folder = _stream_folder(spark)
    # the last windows are still open when the input ends: late rows could come
    stream = _event_stream(spark, sf)
    name = f"daily_{abs(hash(folder))}"
    job = checkpoints.counted(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "rows")


def _event_stream(spark, sf):
    from marginalia.streaming import checkpoints

    return checkpoints.read_files(spark, sf, table(spark, sf, "events").schema, "events.parquet", "ts")


def _stream_folder(spark):
    return new_folder(spark, "stream")


