import random

import pytest
from pyspark.sql import functions as F

from marginalia import provenance
from marginalia.operators import gold, matching, prompts, retrieval, segment, tables, validate
from marginalia.sources import files, store


def chunks(spark, text, **options):
    return [r.asDict() for r in segment.chunks(spark.createDataFrame([("D", "T", text)], "doc_id string, doc_title string, text string"), **options).orderBy("ordinal").collect()]


TEXT = """NGÂN HÀNG
Phần thứ nhất. Chung
Chương I. Mở đầu
Điều 1. Phạm vi
1. Một.
tiếp.
2. Hai.
Trang 3/10
Chương II. Sau
Điều 2
Tiêu đề dòng sau
Nội dung.
Phụ lục II: Mẫu
x"""


def test_segments(spark):
    got = chunks(spark, TEXT)
    assert [c["chunk_id"] for c in got] == ["D_preamble", "D_D1_K1", "D_D1_K2", "D_D2_Kall", "D_DPLII_Kall"]
    assert got[1]["text"] == "Điều 1. Phạm vi\n1. Một.\ntiếp." and got[1]["chapter"] == "Phần thứ nhất: Chung / Chương I: Mở đầu"
    assert got[3]["article_title"] == "Tiêu đề dòng sau" and got[3]["chapter"].endswith("Chương II: Sau")


@pytest.mark.parametrize("line,article", [("Đi ều 8", "8"), ("Điều8", "8"), ("ĐIỀU 12: x", "12"), ("TT61 - Điều 3:", "3"), ("**Điều 5a. Tiêu đề**", "5a")])
def test_damaged_headers(spark, line, article):
    assert chunks(spark, line + "\nnội dung")[0]["article_id"] == article


def test_text_without_articles(spark):
    assert chunks(spark, "chỉ là văn xuôi") == []
    assert [c["chunk_id"] for c in chunks(spark, "chỉ là văn xuôi", whole_when_articleless=True)] == ["D_wholedoc"]
    assert chunks(spark, "") == [] and chunks(spark, None) == []


def test_inline_article_opens_only_the_first(spark):
    got = chunks(spark, "Điểm c Khoản 1 Điều 18 Thông tư 48/2018/TT-NHNN: a\nKhoản 2 Điều 19: b")
    assert [(c["article_id"], c["clause_id"]) for c in got] == [("18", "1")]


def test_segments_dont_depend_on_partitions(spark):
    docs = spark.createDataFrame([(f"D{i}", "T", TEXT) for i in range(20)], "doc_id string, doc_title string, text string")
    a = {tuple(r) for r in segment.chunks(docs.repartition(1)).select("chunk_id", "text", "ordinal").collect()}
    b = {tuple(r) for r in segment.chunks(docs.repartition(7)).select("chunk_id", "text", "ordinal").collect()}
    assert a == b and len(a) == 100


def test_distinct_ids_skip_those_taken(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a-2"), (3, "a"), (4, "a")], "n int, chunk_id string")
    assert [r[0] for r in segment.distinct_ids(df, "n").orderBy("n").select("chunk_id").collect()] == ["a", "a-2", "a-3", "a-4"]


def brute_bm25(docs, query, k):
    import math

    toks = {i: t.lower().split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for ws in toks.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else eps for w, v in raw.items()}
    score = {i: sum(idf.get(w, 0) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in query.lower().split()) for i, ws in toks.items()}
    return sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]


def test_bm25_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    docs = {i: " ".join(r.choices(words, k=r.randint(1, 12))) for i in range(40)}
    asked = {j: " ".join(r.choices([*words, "absent"], k=4)) for j in range(8)} | {99: "absent"}
    corpus = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = {}
    for row in retrieval.bm25(corpus, queries).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["id"])
    assert got == {j: brute_bm25(docs, q, 3) for j, q in asked.items()}


def test_unknown_mode(spark):
    assert retrieval.dispatch({}, "closed_book") is None
    with pytest.raises(ValueError):
        retrieval.dispatch({}, "telepathy")


def packed(spark, passages):
    return spark.createDataFrame([(passages,)], "p array<string>").select(prompts.pack(F.col("p")).alias("r")).select("r.*").first()


def test_budget(spark):
    r = packed(spark, ["x" * 20000, "y" * 100])
    assert r["truncated_ranks"] == [1] and "bị cắt" in r["context"] and r["dropped_ranks"] == []
    small = packed(spark, ["a", "b"])
    assert small["context"] == spark.createDataFrame([(["a", "b"],)], "p array<string>").select(prompts.unbounded_context(F.col("p"))).first()[0]
    r = packed(spark, ["x" * 3500, "y" * 3300, "z" * 50, "w"])
    assert r["dropped_ranks"] == [3, 4]
    assert packed(spark, [])["context_chars"] == 0


def test_guards(spark):
    rows = spark.createDataFrame([("q", "m", "r", "bm25", "tier2_full", "final"), ("q2", "m", "r", "DEGRADED:x", "tier2_full", "final")], "question_id string, model_name string, retrieval_mode string, retriever_backend string, corpus_source string, metric_status string")
    with pytest.raises(provenance.ProvenanceError, match="q2/m/r"):
        provenance.assert_publishable(rows)
    kept, refused = provenance.split_publishable(rows)
    assert provenance.assert_final(kept).count() == 1 and refused.count() == 1
    with pytest.raises(provenance.ProvenanceError):
        provenance.unique(rows, "model_name")
    with pytest.raises(provenance.ProvenanceError):
        tables.abstention_metrics(kept.withColumn("metric_status", F.lit("unvalidated")).withColumns({"is_answerable": F.lit(True), "abstained": F.lit(False), "hedged": F.lit(False)}))


def test_resume_policies(spark):
    cells = spark.createDataFrame([("a", "x"), ("b", "x")], "cache_key string, backend string")
    done = spark.createDataFrame([("a", "y")], "cache_key string, backend string")
    with pytest.raises(provenance.ProvenanceError):
        prompts.resume(cells, done)
    assert [r[0] for r in prompts.resume(cells, done, "reuse").collect()] == ["b"]
    assert prompts.resume(cells, done, "regenerate").count() == 2


@pytest.mark.parametrize("make", ["memory", "files"])
def test_repository_contract(spark, tmp_path, make):
    repo = store.Memory() if make == "memory" else store.Repository(spark, str(tmp_path / "repo"))
    schema = "question_id string, model_name string, retrieval_mode string, citation_precision double, citation_recall double, correctness_score double, hallucinated boolean, abstained boolean, corpus_source string, retriever_backend string"
    row = lambda q, score, backend="bm25": (q, "m", "rag", 1.0, 1.0, score, False, False, "tier2_full", backend)
    assert repo.summary() is None and repo.evaluation("q1", "m", "rag") is None
    repo.save_evaluations(spark.createDataFrame([row("q1", 0.0), row("q2", 2.0, "DEGRADED:x")], schema))
    repo.save_evaluations(spark.createDataFrame([row("q1", 2.0)], schema))
    assert repo.evaluation("q1", "m", "rag")["correctness_score"] == 2.0
    assert repo.evaluations("", "").count() == 2 and repo.evaluations("other").count() == 0
    s = repo.summary().first()
    assert (s["count"], s["refused"], s["avg_correctness"]) == (1, 1, 2.0)
    gens = spark.createDataFrame([("q1", "m", "rag")], "question_id string, model_name string, retrieval_mode string")
    repo.save_generations(gens)
    repo.save_generations(gens)
    assert repo.generations().count() == 2


def test_checkpoint_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"cache_key": "a", "n": 1}\n{"cache_key": "b", "n": 2}\n{"cache_key": "a", "n": 3}\n{"cache_key": "c", "n"\n[1]\n{"n": 4}\n\n', encoding="utf-8")
    records, problems = files.checkpoint(spark, str(tmp_path / "log.jsonl"), "cache_key string, n bigint")
    assert [tuple(r) for r in records.orderBy("first_ordinal").select("cache_key", "n").collect()] == [("a", 3), ("b", 2)]
    assert {r[0]: r[1] for r in problems.collect()} == {"not_a_record": 2, "no_cache_key": 1}


def test_gold_csv(spark, tmp_path):
    (tmp_path / "gold.csv").write_text('﻿ID,question,answer,text_contains_answer_in_the_doc,doc_link,author\n1,"Hỏi ""gì""?\nthêm","Là 5 ngày","Điều 3 Khoản 2: x","https://x.vn/thong-tu-so-6-2019-tt-nhnn-1.htm\n\nhttps://x.vn/Nghi-dinh-21-2021-ND-CP-y",A\n,Probe?,Không có trong kho văn bản.,,N/A,B\n3,,bỏ,,,\n', encoding="utf-8")
    q = {r["id"]: r for r in files.gold_questions(spark, str(tmp_path / "gold.csv")).collect()}
    assert set(q) == {"Q001", "Q002"} and not q["Q002"]["is_answerable"]
    assert q["Q001"]["gold_doc_ids"] == ["06/2019/TT-NHNN", "21/2021/NĐ-CP"] and q["Q001"]["gold_citations"][0]["article_id"] == "3"
    assert q["Q001"]["question"] == 'Hỏi "gì"?\nthêm'
    assert files.manifest(spark, str(tmp_path / "none.json")) == {}


def test_gold_csv_without_columns(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("question,answer\na,b\n", encoding="utf-8")
    with pytest.raises(provenance.ProvenanceError, match="doc_link"):
        files.gold_questions(spark, str(tmp_path / "bad.csv"))


def test_probe_needs_all_three_marks(spark):
    def classified(link, passage, answer):
        df = spark.createDataFrame([(link, passage, answer)], "l string, p string, a string")
        from marginalia.functions.text import urls

        return tuple(df.select(gold.probe(urls(F.col("l")), F.col("p"), F.col("a")).alias("x")).first()["x"])

    assert classified("N/A", "", "Không có trong kho văn bản.") == (True, None)
    assert classified("http://x.vn", "", "Không có trong kho văn bản") == (False, "sentinel-answer-with-gold")
    assert classified("", None, "Có") == (False, "no-gold-without-sentinel")
    assert classified("http://x.vn", "Điều 1", "Có") == (False, None)


def test_coverage_tiers(spark):
    q = spark.createDataFrame([("a", True, "một hai ba"), ("b", True, "vi ệc nhẹ"), ("c", True, "khong dau"), ("d", True, "không thấy"), ("e", False, ""), ("f", True, " ")], "id string, is_answerable boolean, gold_passage string")
    c = spark.createDataFrame([("x một  hai ba y",), ("công việc nhẹ",), ("không dấu",), (None,)], "text string")
    got = {r[0]: r[1] for r in matching.coverage_tiers(q, c).collect()}
    assert got == {"a": "strict", "b": "squash", "c": "loose", "d": "not_found", "e": "probe", "f": "no_passage"}
    damaged = {r[0]: r[1] for r in matching.coverage_tiers(q.filter("id = 'c'").withColumn("gold_passage", F.lit("không dấu")), spark.createDataFrame([("khong dau",)], "text string")).collect()}
    assert damaged == {"c": "loose"}


def test_kappa_edges(spark):
    df = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert validate.kappa(df, "a", "b").first()["kappa"] == 1.0
    assert validate.kappa(df, "a", "b", rounded=False).first()["kappa"] is None
    two = spark.createDataFrame([("y", "y"), ("n", "n"), ("y", "n"), ("n", "n")], "a string, b string")
    assert validate.kappa(two, "a", "b").first()["kappa"] == 0.5
    with pytest.raises(provenance.ProvenanceError):
        validate.validation_report(spark.createDataFrame([], "question_id string, " + ", ".join(f"{s}_{f} boolean" for s in ("human", "auto") for f in validate.FIELDS)))


def test_samples_are_the_same_everywhere(spark):
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("s"))
    quotas = spark.createDataFrame([(0, 5), (1, 3), (2, 500)], "s long, quota int")
    a = sorted(r[0] for r in validate.quota_sample(rows.repartition(1), quotas, ["s"], "id").collect())
    b = sorted(r[0] for r in validate.quota_sample(rows.repartition(9), quotas, ["s"], "id").collect())
    assert a == b and len(a) == 5 + 3 + 66
