"""Citations, quantities, refusals and canonical ids over generated sentences; SQL computes what they must give from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import legal
from marginalia.functions import text as t

from marginalia.operators import gold, matching, scoring, segment
from marginalia.plans.fixtures import ANSWERS_SQL, answers, gold_rows, legal_documents, scored_rows, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


KEY = "l_orderkey, l_linenumber"
#: What each kind of answer cites: none for 4 and 5.
_CITED = "CASE kind WHEN 1 THEN article + 100 ELSE article END"
_DOC = "CASE kind WHEN 2 THEN replace(doc, '/2024/', '/2023/') ELSE doc END"


@query("x1_extract_citations", f"""
WITH {ANSWERS_SQL} SELECT {KEY}, {_DOC} AS doc_id, CAST({_CITED} AS VARCHAR) AS article_id, CAST(clause AS VARCHAR) AS clause_id FROM sentences WHERE kind NOT IN (4, 5)
""")
def _(spark, sf):
    c = legal.citations(F.col("answer_text"))
    return answers(spark, sf).select("l_orderkey", "l_linenumber", F.explode(c).alias("c")).select("l_orderkey", "l_linenumber", "c.doc_id", "c.article_id", "c.clause_id")


@query("x2_span_distance", "SELECT l_orderkey, l_linenumber, greatest(0, CAST(l_quantity AS INTEGER) - 30, 10 - (CAST(l_quantity AS INTEGER) + 5)) AS far FROM lineitem")
def _(spark, sf):
    q = F.round("l_quantity").cast("int")
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", legal.distance(span(q, q + 5), span(F.lit(10), F.lit(30))).alias("far"))


@query("x3_citation_scores", f"""
WITH {ANSWERS_SQL} SELECT {KEY},
  CASE WHEN asked THEN CASE WHEN kind IN (0, 3, 6) THEN 1.0 ELSE 0.0 END ELSE CASE WHEN kind IN (4, 5) THEN 1.0 ELSE 0.0 END END AS p,
  CASE WHEN asked THEN CASE WHEN kind IN (0, 3, 6) THEN 1.0 ELSE 0.0 END ELSE 1.0 END AS r FROM sentences
""")
def _(spark, sf):
    p, r = legal.citation_scores(legal.citations(F.col("answer_text")), F.col("gold_citations"))
    return scored_rows(spark, sf).select("l_orderkey", "l_linenumber", p.alias("p"), r.alias("r"))


@query("x4_clause_match", f"""WITH {ANSWERS_SQL} SELECT {KEY}, kind IN (0, 3, 6) AS hit FROM sentences WHERE asked""")
def _(spark, sf):
    hit = legal.clause_matches(legal.citations(F.col("answer_text")), F.get("gold_citations", F.lit(0)))
    return scored_rows(spark, sf).filter("asked").select("l_orderkey", "l_linenumber", hit.alias("hit"))


@query("x5_reference_surface", f"""
WITH {ANSWERS_SQL} SELECT {KEY}, CASE WHEN kind IN (4, 5) THEN '' ELSE concat('điều', {_CITED}, '|', lower({_DOC})) END AS refs FROM sentences
""")
def _(spark, sf):
    refs = F.array_sort(legal.reference_surface(F.col("answer_text")))
    return answers(spark, sf).select("l_orderkey", "l_linenumber", F.array_join(F.reverse(refs), "|").alias("refs"))


@query("m1_mask_references", f"""
WITH {ANSWERS_SQL} SELECT {KEY}, CAST(CASE WHEN kind = 5 THEN 0 ELSE 1 END AS INTEGER) AS numbers FROM sentences
""")
def _(spark, sf):
    n = F.size(F.regexp_extract_all(legal.mask_references(F.col("answer_text")), F.lit(r"\d+"), F.lit(0)))
    return answers(spark, sf).select("l_orderkey", "l_linenumber", n.alias("numbers"))


@query("m2_numeric_facts", f"""
WITH {ANSWERS_SQL} SELECT {KEY}, CAST(CASE kind WHEN 3 THEN figure + 100 ELSE figure END AS DOUBLE) AS value, 'triệu đồng/ngày' AS unit, 'VND' AS family,
  CAST(CASE kind WHEN 3 THEN figure + 100 ELSE figure END AS DOUBLE) * 1000000 AS amount FROM sentences WHERE kind <> 5
""")
def _(spark, sf):
    f = F.explode(legal.quantities(F.col("answer_text"))).alias("f")
    return answers(spark, sf).select("l_orderkey", "l_linenumber", f).select("l_orderkey", "l_linenumber", "f.value", "f.unit", "f.family", "f.amount")


@query("m3_unit_families", """
SELECT n_nationkey, ['VND', 'VND', '%', 'ngày', 'ngày', '', '', 'tuổi'][CAST(n_nationkey % 8 AS INTEGER) + 1] AS family,
  [n_nationkey * 1e9, n_nationkey * 1e3, n_nationkey + 0.5, n_nationkey, n_nationkey, n_nationkey, n_nationkey, n_nationkey][CAST(n_nationkey % 8 AS INTEGER) + 1] AS amount FROM nation
""")
def _(spark, sf):
    unit = F.expr("element_at(array(' tỷ đồng', ' nghìn đồng', ',5 %', ' ngày làm việc', ' ngày', ' đồng thời báo cáo', ' con trâu', ' tuổi'), cast(n_nationkey % 8 as int) + 1)")
    f = F.get(legal.quantities(F.concat("n_nationkey", unit)), F.lit(0))
    return table(spark, sf, "nation").select("n_nationkey", f["family"].alias("family"), f["amount"].alias("amount"))


@query("m4_compare_quantities", f"""
WITH {ANSWERS_SQL} SELECT {KEY}, CAST(CASE WHEN kind = 3 THEN 1 ELSE 0 END AS INTEGER) AS conflicts, CAST(CASE WHEN kind IN (3, 5) THEN 1 ELSE 0 END AS INTEGER) AS missing, 0 AS mismatches FROM sentences
""")
def _(spark, sf):
    c = legal.compare_quantities(legal.quantities(F.col("gold_sentence")), legal.quantities(F.col("answer_text")))
    return answers(spark, sf).select("l_orderkey", "l_linenumber", F.size(c["conflicts"]).alias("conflicts"), F.size(c["missing"]).alias("missing"), F.size(c["unit_mismatches"]).alias("mismatches"))


@query("m5_refusal_lists", f"WITH {ANSWERS_SQL} SELECT {KEY}, kind IN (5, 6) AS abstained, CASE WHEN kind IN (5, 6) THEN 'gold_sentinel' END AS matched, false AS soft_only FROM sentences")
def _(spark, sf):
    v = legal.refusal_lists(F.col("answer_text"))
    return answers(spark, sf).select("l_orderkey", "l_linenumber", v["abstained"].alias("abstained"), v["matched"].alias("matched"), v["soft_only"].alias("soft_only"))


_SOFT = ["Tài liệu không đề cập đến nội dung này", "không tìm thấy quy định nào", "KHÔNG ĐỦ THÔNG TIN", "Không thể trả lời câu hỏi", "Nội dung ngoài phạm vi", "I cannot answer", "Hạn mức là 5 ngày"]


@query("m6_soft_patterns", """
SELECT n_nationkey, ['corpus_silent', 'not_found', 'insufficient', 'cannot_answer', 'out_of_scope', 'unable_english', NULL][CAST(n_nationkey % 7 AS INTEGER) + 1] AS first FROM nation
""")
def _(spark, sf):
    said = F.get(F.array(*[F.lit(s) for s in _SOFT]), (F.col("n_nationkey") % 7).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", F.get(F.filter(legal.soft_refusals(said), lambda x: ~F.startswith(x, F.lit("phrase:"))), F.lit(0)).alias("first"))


@query("m7_abstention", f"""
WITH {ANSWERS_SQL} SELECT question_id, kind = 5 AS abstained, CASE WHEN kind = 5 THEN 'exact' ELSE 'none' END AS tier, kind = 6 AS hedged, false AS empty_answer,
  CAST(CASE WHEN kind IN (5, 6) THEN 1 ELSE 0 END AS BIGINT) AS n_abstention, CAST(CASE WHEN kind = 5 THEN 0 ELSE 1 END AS BIGINT) AS n_assertion, kind <> 5 AS states_figure FROM sentences
""")
def _(spark, sf):
    return scoring.abstention(answers(spark, sf), ["question_id"], "answer_text").drop("abstention_reason")


@query("m8_verdict_summary", f"WITH {ANSWERS_SQL} SELECT count(*) AS rows, count(*) FILTER (kind IN (5, 6)) AS abstained_exact, CAST(0 AS BIGINT) AS soft_only, count(*) FILTER (kind NOT IN (5, 6)) AS others FROM sentences")
def _(spark, sf):
    v = answers(spark, sf).select(legal.refusal_lists(F.col("answer_text")).alias("v"))
    return v.agg(F.count("*").alias("rows"), F.count_if("v.abstained").alias("abstained_exact"), F.count_if("v.soft_only").alias("soft_only"), F.count_if(~F.col("v.abstained") & (F.size("v.soft") == 0)).alias("others"))


@query("m9_groundedness", f"""
WITH {ANSWERS_SQL} SELECT question_id, retrieval_mode <> 'closed_book' AS assessable,
  CASE WHEN retrieval_mode = 'closed_book' OR kind = 5 THEN NULL WHEN kind IN (0, 4, 6) THEN 1.0 WHEN kind IN (1, 2) THEN 0.5 ELSE 0.0 END AS groundedness,
  CAST(CASE WHEN retrieval_mode <> 'closed_book' AND kind = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_conflict, retrieval_mode <> 'closed_book' AND kind IN (1, 2) AS ref_not_in_context FROM sentences
""")
def _(spark, sf):
    g = scoring.groundedness(scored_rows(spark, sf), ["question_id"], "answer_text", "contexts")
    return g.select("question_id", "assessable", "groundedness", "n_conflict", "ref_not_in_context")


@query("m10_negations", f"WITH {ANSWERS_SQL} SELECT {KEY}, CAST(CASE WHEN kind IN (5, 6) THEN 1 ELSE 0 END AS INTEGER) AS n FROM sentences")
def _(spark, sf):
    return answers(spark, sf).select("l_orderkey", "l_linenumber", F.size(legal.negations(F.col("answer_text"))).alias("n"))


_SCORE = "CASE WHEN NOT asked THEN CASE WHEN kind = 5 THEN 2.0 ELSE 0.0 END WHEN kind IN (3, 5) THEN 0.0 WHEN kind IN (1, 2) THEN 1.0 ELSE 2.0 END"
_IN_CONTEXT = "retrieval_mode <> 'closed_book'"


@query("m11_correctness", f"""
WITH {ANSWERS_SQL} SELECT question_id, {_SCORE} AS score,
  CASE WHEN NOT asked THEN CASE WHEN kind = 5 THEN 'probe_abstention' ELSE 'probe_answered' END WHEN kind = 5 THEN 'false_abstention' ELSE 'gold_answer' END AS reason FROM sentences
""")
def _(spark, sf):
    s = scoring.score_responses(scored_rows(spark, sf))
    return s.select("question_id", F.col("correctness_score").alias("score"), F.col("correctness_reason").alias("reason"))


@query("m12_thresholds", f"""
WITH {ANSWERS_SQL} SELECT question_id, kind IN (0, 1, 2, 4, 6) AS full FROM sentences
""")
def _(spark, sf):
    rows = answers(spark, sf)
    c = scoring.correctness(F.col("answer_text"), F.col("gold_sentence"), F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.lit(False))
    return rows.select("question_id", (c["score"] == 2).alias("full"))


_TYPES = f"""list_filter([
  CASE WHEN NOT asked AND kind <> 5 THEN 'ANSWERED_UNANSWERABLE' END, CASE WHEN NOT asked AND kind NOT IN (4, 5) THEN 'SPURIOUS_CITATION' END,
  CASE WHEN asked AND kind = 2 THEN 'WRONG_INSTRUMENT' END, CASE WHEN asked AND kind = 1 THEN 'NON_COVERING_PROVISION' END,
  CASE WHEN {_IN_CONTEXT} AND kind = 3 THEN 'CONTRADICTS_CONTEXT' END, CASE WHEN asked AND kind = 3 THEN 'NUMERIC_THRESHOLD_MISMATCH' END,
  CASE WHEN asked AND kind = 3 THEN 'UNSUPPORTED_BY_GOLD' END], lambda x: x IS NOT NULL)"""


@query("m13_error_types", f"WITH {ANSWERS_SQL} SELECT question_id, array_to_string({_TYPES}, ',') AS types, len({_TYPES}) > 0 AS hallucinated, CAST(CASE WHEN len({_TYPES}) = 0 THEN 0 WHEN NOT asked AND kind <> 5 THEN 3 ELSE 2 END AS INTEGER) AS severity FROM sentences")
def _(spark, sf):
    return scoring.score_responses(scored_rows(spark, sf)).select("question_id", F.array_join("types", ",").alias("types"), "hallucinated", "severity")


@query("m14_citation_scorability", f"""
WITH {ANSWERS_SQL} SELECT question_id, asked AS citation_scorable, CASE WHEN asked THEN '' ELSE 'probe_no_gold_citation' END AS citation_unscorable_reason,
  CASE WHEN asked THEN CASE WHEN kind IN (0, 3, 6) THEN 1.0 ELSE 0.0 END END AS citation_precision FROM sentences
""")
def _(spark, sf):
    return scoring.score_responses(scored_rows(spark, sf)).select("question_id", "citation_scorable", "citation_unscorable_reason", "citation_precision")


@query("m15_evaluation_record", f"""
WITH {ANSWERS_SQL} SELECT question_id, model_name, retrieval_mode, asked AS is_answerable, kind = 5 AS abstained, NOT asked AND kind = 5 AS abstained_correctly, 'unvalidated' AS metric_status,
  CASE WHEN l_orderkey % 11 = 0 THEN 'tier1_passages' ELSE 'tier2_full' END AS corpus_source FROM sentences
""")
def _(spark, sf):
    s = scoring.score_responses(scored_rows(spark, sf))
    return s.select("question_id", "model_name", "retrieval_mode", "is_answerable", "abstained", "abstained_correctly", "metric_status", "corpus_source")


@query("p14_sentences", f"""
WITH {ANSWERS_SQL} SELECT question_id, CAST(0 AS INTEGER) AS pos, CASE WHEN kind IN (5, 6) THEN 'abstention' ELSE 'content' END AS kind FROM sentences
UNION ALL SELECT question_id, 1, 'content' FROM sentences WHERE kind = 6
""")
def _(spark, sf):
    return segment.sentences(answers(spark, sf), ["question_id"], "answer_text").select("question_id", "pos", "kind")


# --- canonical ids and gold ------------------------------------------------------
@query("c1_canonical_doc", """
SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN concat(lpad(CAST(s_suppkey % 90 + 1 AS VARCHAR), 2, '0'), '/2019/TT-NHNN') WHEN 1 THEN concat(CAST(s_suppkey + 10 AS VARCHAR), '/2021/NĐ-CP') WHEN 2 THEN '46/2024/QH15'
  WHEN 3 THEN concat(CAST(s_suppkey AS VARCHAR), '/2017/NHNN-TTGSNH') WHEN 4 THEN 'M/1' WHEN 5 THEN 'UNRESOLVED:datafiles:2018/48-nhnn' ELSE 'UNRESOLVED:empty' END AS doc_id,
  CASE s_suppkey % 7 WHEN 4 THEN 'manifest' WHEN 5 THEN 'unresolved' WHEN 6 THEN 'unresolved' ELSE 'slug' END AS confidence FROM supplier
""")
def _(spark, sf):
    k = F.col("s_suppkey")
    number = (k % 90 + 1).cast("string")
    url = F.when(k % 7 == 0, F.concat(F.lit("https://c.example/thong-tu-so-"), number, F.lit("-2019-tt-nhnn-2.htm"))).when(k % 7 == 1, F.concat(F.lit("https://c.example/Nghi-dinh-"), (k + 10).cast("string"), F.lit("-2021-ND-CP-x")))
    url = url.when(k % 7 == 2, F.lit("https://l.example/luat-cong-chung-2024-so-46-2024-qh15-379073-d1.html")).when(k % 7 == 3, F.concat(F.lit("https://t.example/Cong-van-"), k.cast("string"), F.lit("-NHNN-TTGSNH-2017-x.aspx")))
    url = url.when(k % 7 == 4, F.lit("https://m.example/doc?id=1&x=2")).when(k % 7 == 5, F.lit("https://datafiles.example/cpp/files/vbpq/2018/02/48-nhnn.pdf")).otherwise(F.lit("  "))
    c = gold.canonical_doc(url, {"https://m.example/doc?id=1": "M/1", "https://m.example/doc": "M/2"})
    return table(spark, sf, "supplier").select("s_suppkey", c["doc_id"].alias("doc_id"), c["confidence"].alias("confidence"))


@query("c2_passage_named_doc", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '48/2018/TT-NHNN' WHEN 1 THEN '23/2015/NĐ-CP' END AS named FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey") % 3
    passage = F.when(k == 0, "Điểm c Khoản 1 Điều 18 Thông tư 48/2018/TT-NHNN").when(k == 1, "Nghị định 23/2015 và các quy định khác").otherwise("Điều 18 quy định")
    return table(spark, sf, "supplier").select("s_suppkey", gold.named_doc(passage, F.array(F.lit("UNRESOLVED:x"), F.lit("23/2015/NĐ-CP"), F.lit("48/2018/TT-NHNN"))).alias("named"))


_GOLD = """
g AS (SELECT p_partkey, p_partkey + 1 AS ordinal, p_partkey % 4 = 0 AS probe, p_partkey % 17 = 1 AND p_partkey % 4 <> 0 AS bare, p_partkey % 3 = 0 AS two,
  CASE WHEN p_partkey % 10 = 3 THEN concat('Q', CASE WHEN p_partkey + 1 < 1000 THEN lpad(CAST(p_partkey + 1 AS VARCHAR), 3, '0') ELSE CAST(p_partkey + 1 AS VARCHAR) END) WHEN p_partkey % 10 = 5 THEN concat('P', p_partkey)
    ELSE concat('Q', CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END) END AS id,
  concat('0', p_partkey % 9 + 1, '/2019/TT-NHNN') AS doc, concat(p_partkey % 50 + 10, '/2021/NĐ-CP') AS doc2, p_size FROM part)
"""


@query("s2_row_id", f"WITH {_GOLD} SELECT ordinal, id FROM g")
def _(spark, sf):
    return gold_rows(spark, sf).select("ordinal", gold.row_id(F.col("ID"), F.col("ordinal")).alias("id"))


@query("c3_primary_doc", f"""
WITH {_GOLD} SELECT ordinal, CASE WHEN probe THEN '' WHEN two THEN concat(doc, '|', doc2) ELSE doc END AS docs, CASE WHEN probe THEN 'n/a-unanswerable' WHEN two THEN 'ambiguous-multi-url' ELSE 'slug' END AS confidence FROM g
""")
def _(spark, sf):
    q = gold.questions_from_rows(gold_rows(spark, sf))
    return q.select("ordinal", F.array_join("gold_doc_ids", "|").alias("docs"), F.col("doc_id_confidence").alias("confidence"))


@query("c4_probe_classification", f"WITH {_GOLD} SELECT ordinal, probe AS is_probe, CAST(NULL AS VARCHAR) AS anomaly FROM g")
def _(spark, sf):
    p = gold.probe(t.urls(F.col("doc_link")), F.col("text_contains_answer_in_the_doc"), F.col("answer"))
    return gold_rows(spark, sf).select("ordinal", p["is_probe"].alias("is_probe"), p["anomaly"].alias("anomaly"))


@query("c5_answerability", f"WITH {_GOLD} SELECT ordinal, NOT probe AS answerable, CASE WHEN probe THEN 'loader_flag' ELSE 'gold_present' END AS basis, '' AS anomaly FROM g")
def _(spark, sf):
    return gold.questions_from_rows(gold_rows(spark, sf)).withColumn("a", gold.answerability()).select("ordinal", "a.answerable", "a.basis", "a.anomaly")


@query("c6_scorer_answerability", f"WITH {_GOLD} SELECT ordinal, NOT probe AS answerable, 'gold_flag' AS basis, CASE WHEN bare THEN 'answerable_without_gold_passage' ELSE '' END AS anomaly FROM g")
def _(spark, sf):
    return gold.questions_from_rows(gold_rows(spark, sf)).withColumn("a", gold.scorer_answerability()).select("ordinal", "a.answerable", "a.basis", "a.anomaly")


@query("c7_unstable_ids", "SELECT CASE WHEN p_partkey < 999 THEN concat('Q', lpad(CAST(p_partkey + 1 AS VARCHAR), 3, '0')) ELSE concat('Q', p_partkey + 1) END AS id FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 10 = 8")
def _(spark, sf):
    # blank cells on probes too
    rows = gold_rows(spark, sf).withColumn("ID", F.when(F.col("ordinal") % 10 == 9, F.lit(" ")).otherwise(F.col("ID")))
    return gold.unstable_ids(gold.questions_from_rows(rows), rows)


@query("s3_duplicate_ids", f"WITH {_GOLD} SELECT id, count(*) AS rows FROM g GROUP BY id HAVING count(*) > 1")
def _(spark, sf):
    return gold.questions_from_rows(gold_rows(spark, sf)).groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1")


@query("n17_article_and_clauses", f"WITH {_GOLD} SELECT ordinal, CASE WHEN probe OR bare THEN NULL ELSE CAST(p_size AS VARCHAR) END AS article, CAST(NULL AS VARCHAR) AS title, CAST(0 AS INTEGER) AS clauses FROM g")
def _(spark, sf):
    p = F.col("text_contains_answer_in_the_doc")
    title = F.when(p.rlike("Khoản"), F.lit(None)).otherwise(legal.article_title(p))
    return gold_rows(spark, sf).select("ordinal", legal.article_id(p).alias("article"), title.alias("title"), F.size(legal.clause_numbers(p)).alias("clauses"))


@query("n18_gold_citation", f"WITH {_GOLD} SELECT ordinal, doc AS doc_id, CAST(p_size AS VARCHAR) AS article_id, '2' AS clause_id FROM g WHERE NOT probe AND NOT bare")
def _(spark, sf):
    q = gold.questions_from_rows(gold_rows(spark, sf)).select("ordinal", F.explode("gold_citations").alias("c"))
    return q.select("ordinal", "c.doc_id", "c.article_id", "c.clause_id")


@query("n19_articles_in", f"WITH {ANSWERS_SQL} SELECT question_id, CASE WHEN kind IN (4, 5) THEN '' ELSE CAST({_CITED} AS VARCHAR) END AS articles FROM sentences")
def _(spark, sf):
    return answers(spark, sf).select("question_id", F.array_join(legal.articles_in(F.col("answer_text")), ",").alias("articles"))


_RAW = ["Thông tư 6/2019/TT-NHNN", "Nghị định 21/2021/ND-CP", "Quyết định 2345/QD-NHNN", "276/NHNN-TTGSNH/2017", "Luật Các tổ chức tín dụng 2024", "", "Bộ luật dân sự năm 2015"]


@query("c8_normalize_doc_id", """
SELECT n_nationkey, ['06/2019/TT-NHNN', '21/2021/NĐ-CP', '2345/QĐ-NHNN', '276/2017/NHNN-TTGSNH', '32/2024/QH15', 'UNKNOWN', '91/2015/QH13'][CAST(n_nationkey % 7 AS INTEGER) + 1] AS doc FROM nation
""")
def _(spark, sf):
    raw = F.get(F.array(*[F.lit(x) for x in _RAW]), (F.col("n_nationkey") % 7).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", legal.normalize_doc_id(raw).alias("doc"))


@query("c9_comparable_doc", "SELECT n_nationkey, ['06/2019/TT/NHNN', '21/2021/NĐ/CP', 'UNKNOWN', '2345/QĐ/NHNN'][CAST(n_nationkey % 4 AS INTEGER) + 1] AS doc FROM nation")
def _(spark, sf):
    raw = F.get(F.array(*[F.lit(x) for x in ("6/2019/tt-nhnn", "21/2021/ND-CP", "unknown ", "2345/QĐ-NHNN")]), (F.col("n_nationkey") % 4).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", legal.comparable_doc(raw).alias("doc"))


@query("c10_identify_instrument", "SELECT concat('T', s_suppkey) AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN concat(s_suppkey % 50 + 1, '/2024/TT-NHNN') END AS instrument FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    own = F.concat((k % 50 + 1).cast("string"), F.lit("/2024/TT-NHNN"))
    text = F.concat(F.when(k % 2 == 0, "THÔNG TƯ số ").otherwise("Số "), F.lit("99/2010/QH12 "), F.lpad(own, F.length(own) + 1, "0"), F.lit(" sửa đổi "), own)
    return matching.identify_instruments(table(spark, sf, "supplier").select(F.concat(F.lit("T"), k).alias("doc_id"), text.alias("text")))


@query("c11_text_layer", "SELECT doc_id, CASE WHEN length(trim(text)) < 50 THEN 'no-layer' WHEN doc_id % 3 = 0 THEN 'clean' ELSE 'corrupt' END AS layer FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", matching.layer_class(F.col("text"), F.when(F.col("doc_id") % 3 == 0, 0.2).otherwise(0.01)).alias("layer"))


@query("c13_provenance_predicates", "SELECT n_nationkey, n_nationkey % 4 <> 3 AS degraded, n_nationkey % 2 = 0 AS publishable FROM nation")
def _(spark, sf):
    from marginalia.provenance import is_degraded, is_publishable_corpus

    backend = F.get(F.array(F.lit(""), F.lit("UNSET"), F.lit("DEGRADED:x"), F.lit("bm25")), (F.col("n_nationkey") % 4).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", is_degraded(backend).alias("degraded"), is_publishable_corpus(F.when(F.col("n_nationkey") % 2 == 0, "tier2_full").otherwise("tier1_passages")).alias("publishable"))


@query("c15_passage_quality", f"""
WITH {_GOLD} SELECT ordinal, CASE WHEN probe OR bare THEN 'empty' ELSE 'summary' END AS shape, CASE WHEN probe OR bare THEN 'unmeasured' WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS overlap_class FROM g
""")
def _(spark, sf):
    q = gold.questions_from_rows(gold_rows(spark, sf))
    ctx = F.array(F.when(F.col("ordinal") % 2 == 1, F.col("gold_passage")).otherwise("một hai ba bốn"))
    v = scoring.passage_quality(F.col("gold_passage"), ctx)
    return q.select("ordinal", v["shape"].alias("shape"), v["overlap_class"].alias("overlap_class"))


@query("a16_coverage_report", f"""
WITH {_GOLD} SELECT count(*) AS questions, count(*) FILTER (NOT probe) AS answerable_questions, count(*) FILTER (probe) AS unanswerable_probes, count(*) FILTER (NOT probe) AS doc_ids_resolved, CAST(0 AS BIGINT) AS doc_ids_unresolved,
  count(*) FILTER (NOT probe AND NOT bare) AS with_article_gold, count(*) FILTER (NOT probe AND NOT bare) AS with_clause_gold, count(*) FILTER (bare) AS empty_passage FROM g
""")
def _(spark, sf):
    return gold.coverage(gold.questions_from_rows(gold_rows(spark, sf))).drop("unanswerable_probe_ids", "empty_passage_ids", "distinct_doc_ids")


# --- segmentation -----------------------------------------------------------------
from marginalia.plans.fixtures import LEGAL_SQL  # noqa: E402


@query("p1_segment_chunks", f"""
WITH {LEGAL_SQL}, a AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i FROM legal WHERE NOT bare),
c AS (
  SELECT doc_id, concat(doc_id, '_preamble') AS chunk_id, '0' AS article_id, 'Lời nói đầu' AS article_title, CAST(NULL AS VARCHAR) AS clause_id, CAST(NULL AS VARCHAR) AS chapter, 'NGÂN HÀNG NHÀ NƯỚC' AS text FROM legal WHERE NOT bare
  UNION ALL SELECT doc_id, concat(doc_id, '_D', i, '_Kall'), CAST(i AS VARCHAR), 'Phạm vi điều chỉnh', NULL, 'Phần thứ nhất: Chung / Chương I: Mở đầu', concat('Điều ', i, chr(10), 'Phạm vi điều chỉnh', chr(10), 'Văn bản này quy định về thẻ.') FROM a WHERE i % 2 = 0
  UNION ALL SELECT doc_id, concat(doc_id, '_D', i, '_K1'), CAST(i AS VARCHAR), 'Tiêu đề', '1', 'Phần thứ nhất: Chung / Chương I: Mở đầu', concat('Điều ', i, '. Tiêu đề', chr(10), '1. Khoản một.', chr(10), 'Tiếp theo.') FROM a WHERE i % 2 = 1
  UNION ALL SELECT doc_id, concat(doc_id, '_D', i, '_K2'), CAST(i AS VARCHAR), 'Tiêu đề', '2', 'Phần thứ nhất: Chung / Chương I: Mở đầu', '2. Khoản hai.' FROM a WHERE i % 2 = 1
  UNION ALL SELECT doc_id, concat(doc_id, '_DPLII_Kall'), 'PLII', 'Mẫu biểu', NULL, 'Phần thứ nhất: Chung / Chương I: Mở đầu', concat('Phụ lục II: Mẫu biểu', chr(10), 'Dòng mẫu') FROM legal WHERE NOT bare)
SELECT * FROM c
""")
def _(spark, sf):
    return segment.chunks(legal_documents(spark, sf)).select("doc_id", "chunk_id", "article_id", "article_title", "clause_id", "chapter", "text")


@query("p2_line_kinds", f"""
WITH {LEGAL_SQL}, k AS (
  SELECT 'text' AS kind, count(*) FILTER (NOT bare) + 2 * count(*) FILTER (bare) + count(*) FILTER (NOT bare) + sum(CASE WHEN NOT bare THEN 2 * (n // 2) + (n + 1) // 2 ELSE 0 END) AS lines FROM legal
  UNION ALL SELECT 'part', count(*) FROM legal WHERE NOT bare UNION ALL SELECT 'chapter', count(*) FROM legal WHERE NOT bare UNION ALL SELECT 'annex', count(*) FROM legal WHERE NOT bare
  UNION ALL SELECT 'article', sum(n) FROM legal WHERE NOT bare UNION ALL SELECT 'clause', sum(2 * ((n + 1) // 2)) FROM legal WHERE NOT bare UNION ALL SELECT 'furniture', sum(n - 1) FROM legal WHERE NOT bare)
SELECT kind, CAST(lines AS BIGINT) AS lines FROM k WHERE lines > 0
""")
def _(spark, sf):
    return segment.lines(legal_documents(spark, sf)).groupBy("kind").agg(F.count("*").alias("lines"))


@query("p8_whole_document", f"WITH {LEGAL_SQL} SELECT doc_id, concat(doc_id, '_wholedoc') AS chunk_id, concat('Công văn không có điều khoản', chr(10), 'Nội dung') AS text FROM legal WHERE bare")
def _(spark, sf):
    return segment.chunks(legal_documents(spark, sf).filter("bare"), whole_when_articleless=True).select("doc_id", "chunk_id", "text")


@query("p10_parse_report", f"""
WITH {LEGAL_SQL} SELECT doc_id, CAST(CASE WHEN bare THEN 0 ELSE n + 1 END AS BIGINT) AS articles_found, CAST(CASE WHEN bare THEN 0 ELSE 2 * ((n + 1) // 2) END AS BIGINT) AS clauses_found, NOT bare AS preamble_captured,
  CAST(CASE WHEN bare THEN 2 ELSE n - 1 END AS BIGINT) AS lines_dropped, CAST(0 AS BIGINT) AS missing_titles, CASE WHEN bare THEN 'No articles (Điều) found in document' END AS warning FROM legal
""")
def _(spark, sf):
    return segment.report(legal_documents(spark, sf))


@query("p11_distinct_ids", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN concat('K', l_orderkey) ELSE concat('K', l_orderkey, '-', l_linenumber) END AS chunk_id
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_linenumber FROM lineitem)
""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("chunk_id", F.concat(F.lit("K"), "l_orderkey"))
    done = segment.distinct_ids(rows, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    number = F.coalesce(F.nullif(F.regexp_extract("chunk_id", r"-(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    return done.select("l_orderkey", number.alias("l_linenumber"), "chunk_id")


@query("p13_tier1_chunks", f"WITH {_GOLD} SELECT id AS question_id, doc AS doc_id, concat('Điều ', p_size, ' Khoản 2: hạn mức ', p_size, ' triệu đồng') AS text, 'tier1_passages' AS corpus_source FROM g WHERE NOT probe AND NOT bare")
def _(spark, sf):
    return segment.passages_as_chunks(gold.questions_from_rows(gold_rows(spark, sf))).select("question_id", "doc_id", "text", "corpus_source")


