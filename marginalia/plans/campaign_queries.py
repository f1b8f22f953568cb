"""Campaign rows, readers over files that the query itself writes, segmentation's single rules, deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions.text import url_basename
from marginalia.operators import campaign, gold, matching, prompts, segment
from marginalia.plans.fixtures import ANSWERS_SQL, LEGAL_SQL, answers, gold_rows, legal_documents, table
from marginalia.plans.legal_queries import _GOLD
from marginalia.plans.table_queries import _stream_folder
from marginalia.provenance import ProvenanceError, require
from marginalia.sources import files, store

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("c12_quantization", """
SELECT n_nationkey, ['full-bfloat16', 'bnb-4bit-nf4+float16', 'DEGRADED:partial-4bit-1of4-linear-modules', 'DEGRADED:quantization-fell-back-to-float16', 'DEGRADED:quantization-not-applied-loaded-float16', 'bnb-4bit-nf4+float16', 'DEGRADED:quantization-unverifiable-no-linear-modules'][CAST(n_nationkey % 7 AS INTEGER) + 1] AS quant_config, n_nationkey % 7 IN (1, 5) AS verified, n_nationkey % 7 IN (2, 3, 4, 6) AS degraded FROM nation
""")
def _(spark, sf):
    k = F.col("n_nationkey") % 7
    census = lambda a, b: F.create_map(F.lit("Linear4bit"), F.lit(a).cast("long"), F.lit("Linear"), F.lit(b).cast("long"))
    found = F.when(k == 1, census(203, 1)).when(k == 2, census(1, 3)).when(k.isin(3, 4), census(0, 9)).when(k == 6, census(0, 0))
    dtype = F.when(k == 0, "torch.bfloat16").when(k == 5, "uint8").otherwise("torch.float16")
    return table(spark, sf, "nation").select("n_nationkey", campaign.quantization(k != 0, k != 4, dtype, found).alias("q")).select("n_nationkey", "q.*")


@query("c14_select_models", "SELECT n_name AS alias, CASE WHEN n_regionkey = 0 THEN 'peer' ELSE 'extra' END AS role, n_regionkey <> 0 AS needs_label, CAST((SELECT count(*) FROM nation WHERE n_regionkey IN (0, 2)) * 3 * (SELECT count(*) FROM benchmark) AS BIGINT) AS cells FROM nation WHERE n_regionkey IN (0, 2)")
def _(spark, sf):
    n = table(spark, sf, "nation")
    registry = n.select(F.col("n_name").alias("alias"), F.when(F.col("n_regionkey") == 0, "peer").otherwise("extra").alias("role"))
    wanted = [r[0] for r in n.filter("n_regionkey in (0, 2)").select("n_name").collect()]
    cells = campaign.expected_cells(len(wanted), list(campaign.MODES), table(spark, sf, "benchmark").count())
    return campaign.select_models(registry, wanted).withColumn("cells", F.lit(cells).cast("long"))


@query("g9_answer_records", f"WITH {ANSWERS_SQL} SELECT question_id, kind IN (5, 6) AS abstained, CAST(CASE WHEN kind IN (4, 5) THEN 0 ELSE 1 END AS INTEGER) AS citations, 0.333333 AS score FROM sentences")
def _(spark, sf):
    rows = answers(spark, sf).select("question_id", F.concat(F.lit("\n "), "answer_text", F.lit(" \n")).alias("raw_response"), F.lit("vllm").alias("generation_backend"), F.array(F.lit(1 / 3)).alias("retrieved_scores"))
    return campaign.answer_records(rows).select("question_id", "abstained", F.size("extracted_citations").alias("citations"), F.get("retrieved_scores", F.lit(0)).alias("score"))


@query("g10_generation", "SELECT item_id, CAST(length(text) AS BIGINT) + " + str(len(prompts.CLOSED[0]) + len(prompts.CLOSED[1])) + " AS chars FROM benchmark")
def _(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", prompts.closed_book(F.col("text")).alias("prompt"))
    return prompts.generate(rows, lambda prompt: prompt).select("item_id", F.length("raw_response").cast("long").alias("chars"))


@query("g17_probe_gate", "SELECT n_nationkey FROM nation")
def _(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.lit("Theo quy định của ngân hàng, hạn mức giao dịch thẻ là năm mươi triệu đồng mỗi ngày.").alias("text"))
    return prompts.probe_gate(prompts.check_outputs(rows, "n_nationkey", "text")).select("n_nationkey")


# --- segmentation, rule by rule ---------------------------------------------------
@query("p3_chunk_ids", f"""
WITH {LEGAL_SQL}, a AS (SELECT doc_id, unnest(range(1, n + 1)) AS i FROM legal WHERE NOT bare)
SELECT concat(doc_id, '_preamble') AS chunk_id FROM legal WHERE NOT bare UNION ALL SELECT concat(doc_id, '_DPLII_Kall') FROM legal WHERE NOT bare
UNION ALL SELECT concat(doc_id, '_D', i, '_Kall') FROM a WHERE i % 2 = 0 UNION ALL SELECT concat(doc_id, '_D', i, '_K', unnest([1, 2])) FROM a WHERE i % 2 = 1
""")
def _(spark, sf):
    return segment.chunks(legal_documents(spark, sf)).select("chunk_id")


@query("p4_part_and_chapter", f"WITH {LEGAL_SQL} SELECT doc_id, 'Phần thứ nhất: Chung' AS part, 'Phần thứ nhất: Chung / Chương I: Mở đầu' AS chapter, CAST(1 + n + (n + 1) // 2 AS BIGINT) AS chunks FROM legal WHERE NOT bare")
def _(spark, sf):
    return segment.chunks(legal_documents(spark, sf)).filter("not is_preamble").groupBy("doc_id", "part", "chapter").agg(F.count("*").alias("chunks"))


@query("p5_annexes", f"WITH {LEGAL_SQL} SELECT doc_id, 'PLII' AS article_id, 'Mẫu biểu' AS article_title FROM legal WHERE NOT bare")
def _(spark, sf):
    return segment.chunks(legal_documents(spark, sf)).filter("article_id like 'PL%'").select("doc_id", "article_id", "article_title")


@query("p6_first_clause_keeps_header", f"WITH {LEGAL_SQL} SELECT doc_id, CAST((n + 1) // 2 AS BIGINT) AS with_header, CAST((n + 1) // 2 AS BIGINT) AS without FROM legal WHERE NOT bare")
def _(spark, sf):
    c = segment.chunks(legal_documents(spark, sf)).filter("clause_id is not null")
    return c.groupBy("doc_id").agg(F.count_if(F.startswith("text", F.lit("Điều"))).alias("with_header"), F.count_if(~F.startswith("text", F.lit("Điều"))).alias("without"))


@query("p7_title_on_next_line", f"WITH {LEGAL_SQL} SELECT doc_id, i AS article_id, 'Phạm vi điều chỉnh' AS article_title FROM (SELECT doc_id, CAST(unnest(range(1, n + 1)) AS VARCHAR) AS i FROM legal WHERE NOT bare) WHERE CAST(i AS INTEGER) % 2 = 0")
def _(spark, sf):
    return segment.chunks(legal_documents(spark, sf)).filter("article_title = 'Phạm vi điều chỉnh'").select("doc_id", "article_id", "article_title")


@query("p9_preambles", f"WITH {LEGAL_SQL} SELECT doc_id, CAST(1 AS BIGINT) AS ordinal, 'NGÂN HÀNG NHÀ NƯỚC' AS text FROM legal WHERE NOT bare")
def _(spark, sf):
    return segment.chunks(legal_documents(spark, sf)).filter("is_preamble").select("doc_id", "ordinal", "text")


@query("p12_ingest_build", f"WITH {LEGAL_SQL} SELECT doc_id, n AS priority, CAST(CASE WHEN bare THEN 0 ELSE 2 + n + (n + 1) // 2 END AS BIGINT) AS chunks, bare AS suspect FROM legal")
def _(spark, sf):
    docs = legal_documents(spark, sf)
    plan = files.plan_order(docs.select("doc_id", F.col("n").alias("priority"), F.lit("ready").alias("status")))
    made = segment.distinct_ids(segment.chunks(docs), "doc_id", "ordinal").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    t = plan.join(docs.select("doc_id", "text"), "doc_id").join(made, "doc_id", "left")
    return t.select("doc_id", "priority", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), (~F.col("text").rlike(r"(?iuU)Điều\s*\d")).alias("suspect"))


# --- readers, over files that the query writes ---------------------------------------
@query("s1_qa_csv_scan", f"WITH {_GOLD} SELECT ordinal, NOT probe AS is_answerable, CASE WHEN probe THEN '' WHEN two THEN concat(doc, '|', doc2) ELSE doc END AS docs FROM g")
def _(spark, sf):
    folder = _stream_folder(spark)
    gold_rows(spark, sf).orderBy("ordinal").drop("ordinal").coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    return gold.questions_from_rows(files.csv(spark, folder)).select("ordinal", "is_answerable", F.array_join("gold_doc_ids", "|").alias("docs"))


@query("s5_chunk_json", f"WITH {LEGAL_SQL} SELECT doc_id, CAST(2 + n + (n + 1) // 2 AS BIGINT) AS chunks FROM legal WHERE NOT bare")
def _(spark, sf):
    folder = _stream_folder(spark)
    made = segment.chunks(legal_documents(spark, sf)).withColumn("metadata", F.create_map(F.lit("version"), F.lit("1")))
    every = made.agg(F.to_json(F.collect_list(F.struct(*[f.name for f in files.CHUNK.fields]))).alias("value"))
    every.coalesce(1).write.text(folder)
    return files.chunks(spark, folder, "tier2_full").groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("s11_text_files", "SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(n_name)) + count(*) AS BIGINT) AS chars FROM nation")
def _(spark, sf):
    folder = _stream_folder(spark)
    table(spark, sf, "nation").select(F.col("n_name").alias("value")).repartition(5).write.text(folder)
    t = files.whole_texts(spark, folder)
    return t.agg(F.sum(F.size(F.split("text", "\n")) - 1).cast("long").alias("lines"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("s19_score_csv", "SELECT concat('P', s_suppkey) AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS overall, CASE WHEN s_suppkey % 2 = 0 THEN 'accept' ELSE 'reject' END AS verdict, CASE WHEN s_suppkey % 2 = 1 THEN 'weak' END AS note FROM supplier")
def _(spark, sf):
    folder = _stream_folder(spark)
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("P"), k).alias("id"), F.when(k % 3 == 0, "n/a").otherwise(F.round("s_acctbal", 2).cast("string")).alias("overall"), F.when(k % 2 == 0, "ACCEPT").otherwise("Reject ").alias("verdict"), F.when(k % 2 == 1, "weak").alias("fatal_flaw"))
    rows.coalesce(1).write.option("header", True).csv(folder)
    return files.scores(spark, folder, ["overall"])


@query("k8_guarded_append", f"WITH {ANSWERS_SQL} SELECT count(*) AS rows FROM answers")
def _(spark, sf):
    rows = answers(spark, sf).withColumns({"cache_key": F.col("question_id"), "corpus_source": F.lit("tier2_full"), "retriever_backend": F.lit("bm25"), "generation_backend": F.lit("vllm")})
    return store.guard_rows(rows).agg(F.count("*").alias("rows"))


@query("k2_generations_append_only", f"WITH {ANSWERS_SQL} SELECT model_name, 2 * count(*) AS rows FROM answers GROUP BY model_name")
def _(spark, sf):
    rows = answers(spark, sf).select(*store.KEY)
    repo = store.Memory()
    repo.save_generations(rows)
    repo.save_generations(rows)
    return repo.generations().groupBy("model_name").agg(F.count("*").alias("rows"))


def _json_array(rows, folder):
    """rows as one JSON array in a file: what small hand-kept files are."""
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).coalesce(1).write.text(folder)
    return folder


@query("s4_manifest", "SELECT n_name AS url, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat('A/', n_nationkey) END AS doc_id FROM nation")
def _(spark, sf):
    folder = _stream_folder(spark)
    n = table(spark, sf, "nation").select(F.struct("n_name", F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("A/"), "n_nationkey")).alias("d")).alias("e"))
    n.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("e")).alias("urls"))).alias("value")).coalesce(1).write.text(folder)
    if files.manifest(spark, f"{folder}-that-is-not-there"):
        raise AssertionError("a missing file has no addresses")
    return spark.createDataFrame(list(files.manifest(spark, folder).items()), "url string, doc_id string")


@query("s6_evaluation_corpus", f"WITH {LEGAL_SQL} SELECT CAST(sum(2 + n + (n + 1) // 2) AS BIGINT) AS chunks, count(*) AS documents FROM legal WHERE NOT bare")
def _(spark, sf):
    made = segment.chunks(legal_documents(spark, sf)).withColumn("metadata", F.create_map(F.lit("version"), F.lit("1")))
    folder = _json_array(made.select(*[f.name for f in files.CHUNK.fields]), _stream_folder(spark))
    return files.evaluation_corpus(spark, folder, 3).agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))


@query("s8_sample_gold", "SELECT concat('Q', n_nationkey) AS id, n_regionkey > 0 AS is_answerable, n_name AS question, CAST(11 AS INTEGER) AS fields FROM nation")
def _(spark, sf):
    rows = table(spark, sf, "nation").select(F.concat(F.lit("Q"), "n_nationkey").alias("id"), F.col("n_name").alias("question"), (F.col("n_regionkey") > 0).alias("is_answerable"), F.lit("x").alias("a_field_nobody_knows"), F.struct(F.lit(1).alias("deep")).alias("another"))
    df = files.questions(spark, _json_array(rows, _stream_folder(spark)))
    return df.select("id", "is_answerable", "question", F.lit(len(df.columns)).alias("fields"))


@query("s22_audit_rows", f"WITH {_GOLD} SELECT id, p_partkey % 8 = 0 AS is_probe, (probe OR bare) AND p_partkey % 8 <> 0 AS unanswerable_no_passage FROM g")
def _(spark, sf):
    folder = _stream_folder(spark)
    # every other probe's answer is the sentinel to the letter; the others end with a full stop
    rows = gold_rows(spark, sf).withColumn("answer", F.when((F.col("ordinal") - 1) % 8 == 0, F.regexp_replace("answer", r"\.$", "")).otherwise(F.col("answer")))
    rows.orderBy("ordinal").drop("ordinal").coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
    return files.audit_rows(spark, folder).select("id", "is_probe", "unanswerable_no_passage")


@query("s22_audit_extract", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 IN (0, 1) THEN n_name ELSE '' END AS text, CAST(0 AS INTEGER) AS pages, n_nationkey % 4 IN (0, 1) AS has_text_layer FROM nation")
def _(spark, sf):
    k = F.col("n_nationkey") % 4
    path = F.when(k == 0, "a/b.TXT").when(k == 1, "c.htm").when(k == 2, "d.docx").otherwise("e.txt")
    return table(spark, sf, "nation").withColumn("x", files.audit_text(path, F.when(k == 3, "  ").otherwise(F.col("n_name")))).select("n_nationkey", F.trim("x.text").alias("text"), "x.pages", "x.has_text_layer")


@query("s24_positional_csv", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS ordinal, n_name, CAST(n_nationkey AS VARCHAR) AS key FROM nation")
def _(spark, sf):
    folder = _stream_folder(spark)
    table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n")).alias("n_name")).orderBy("n_nationkey").coalesce(1).write.option("header", True).option("quoteAll", True).csv(folder)
    names, rows = files.positional(spark, folder, ("n_name",))
    at = {n: F.get("cells", F.lit(i)) for i, n in enumerate(names)}
    return rows.select("ordinal", F.trim(F.regexp_replace(at["n_name"], "\\s+$", "")).alias("n_name"), at["n_nationkey"].alias("key"))


@query("q8_loader_gate", f"WITH {_GOLD} SELECT CAST(0 AS BIGINT) AS unresolved, CAST(0 AS BIGINT) AS contradictory, count(*) FILTER (bare) AS empty_passages, count(*) FILTER (bare) > 0 AS blocking FROM g")
def _(spark, sf):
    rows = gold_rows(spark, sf)
    report = gold.loader_gate(rows, allow_unresolved=True)
    if refused(lambda: gold.loader_gate(rows)) != report.first()["blocking"]:
        raise AssertionError("the gate blocks what it reports")
    return report


def refused(act) -> bool:
    """Whether act() raises because something isn't established."""
    try:
        act()
    except ProvenanceError:
        return True
    return False


@query("a21_require", "SELECT n_nationkey, n_regionkey = 0 AS refused FROM nation")
def _(spark, sf):
    # a driver's check, tried on each row of a table of 25
    tried = [(r[0], refused(lambda r=r: require(r[1] != 0, "region 0"))) for r in table(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect()]
    return spark.createDataFrame(tried, table(spark, sf, "nation").select("n_nationkey").schema.add("refused", "boolean"))


@query("k17_safe_output", "SELECT * FROM (VALUES ('/data/corpus', true), ('/data/corpus/', true), ('/data/corpus2', false), ('/data/fixture', false)) AS t(path, refused)")
def _(spark, sf):
    paths = ["/data/corpus", "/data/corpus/", "/data/corpus2", "/data/fixture"]
    return spark.createDataFrame([(p, refused(lambda p=p: store.safe_output(p, "/data/corpus"))) for p in paths], "path string, refused boolean")


@query("k1_repository", f"WITH {ANSWERS_SQL} SELECT model_name, count(*) AS evaluations, count(*) AS second, 2 * count(*) AS generations FROM sentences GROUP BY model_name")
def _(spark, sf):
    repo = store.Repository(spark, _stream_folder(spark))
    rows = answers(spark, sf).select(*store.KEY, "kind")
    repo.save_evaluations(rows.withColumn("kind", F.lit(-1)))
    repo.save_evaluations(rows)
    repo.save_generations(rows)
    repo.save_generations(rows)
    count = lambda df, name, cond=None: df.groupBy("model_name").agg(F.count_if(cond if cond is not None else F.lit(True)).alias(name))
    held = count(repo.evaluations(), "evaluations").join(count(repo.evaluations(), "second", F.col("kind") >= 0), "model_name")
    return held.join(count(repo.generations(), "generations"), "model_name")


@query("k7_batched", f"WITH {ANSWERS_SQL} SELECT retrieval_mode, 3 * count(*) AS rows FROM sentences GROUP BY retrieval_mode")
def _(spark, sf):
    repo = store.Batched(spark, _stream_folder(spark))
    rows = answers(spark, sf).select(*store.KEY)
    for _ in range(3):
        repo.save_generations(rows)
    if repo.generations() is not None:
        raise AssertionError("nothing is written before flush()")
    repo.flush()
    return repo.generations().groupBy("retrieval_mode").agg(F.count("*").alias("rows"))


@query("k13_run_manifest", "SELECT r_name AS model, CAST(r_regionkey AS BIGINT) AS rows FROM region")
def _(spark, sf):
    folder = _stream_folder(spark)
    models = {r[0]: r[1] for r in table(spark, sf, "region").select("r_name", "r_regionkey").collect()}
    store.write_manifest(spark, folder, {"models": {}})
    store.write_manifest(spark, folder, {"models": models})
    return spark.createDataFrame(list(store.read_manifest(spark, folder)["models"].items()), "model string, rows long")


# --- deliveries and reports --------------------------------------------------------------
@query("q4_delivery_scan", r"""
WITH f AS (SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS base FROM pages), d AS (SELECT base AS file, min(page_id) AS first, count(*) AS n FROM f WHERE base <> '' GROUP BY base)
SELECT file, concat('doc', first) AS plan_doc_id, n AS cited_by_questions FROM d
""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", url_basename(F.col("url")).alias("basename")).filter("basename <> ''")
    plan = p.select(F.col("page_id").alias("priority"), F.concat(F.lit("doc"), "page_id").alias("doc_id"), "basename")
    return campaign.deliveries(p.select(F.col("basename").alias("file")).distinct(), plan, p.select("basename"))


@query("q13_unmatched_passages", r"SELECT item_id AS passage_id FROM benchmark WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(trim(regexp_replace(documents.text, '\s+', ' ', 'g')), trim(regexp_replace(benchmark.text, '\s+', ' ', 'g'))))")
def _(spark, sf):
    found = matching.match_passages(table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")), table(spark, sf, "documents"))
    return found.filter("tier <> 'strict'").select("passage_id")


@query("q14_arms", "SELECT metric, CAST(3 AS BIGINT) AS arms FROM (SELECT unnest(['price', 'size']) AS metric)")
def _(spark, sf):
    from marginalia.operators import validate

    p = table(spark, sf, "part")
    s = p.select((F.col("p_partkey") % 4).alias("arm"), F.floor(F.col("p_partkey") / 4).alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    # one arm lacks our row, and is left out
    return validate.arms_report(s.filter("not (arm = 3 and id = 5)"), "id", 5, ["price", "size"]).select("metric", "arms")


@query("v10_blind_report", """
WITH s AS (SELECT p_partkey % 3 AS arm, p_partkey // 3 AS id, p_retailprice AS v FROM part), m AS (SELECT arm, v AS mine FROM s WHERE id = 5), p AS (SELECT arm, any_value(mine) AS mine, count(*) FILTER (v < mine) * 100.0 / count(*) AS pct FROM s JOIN m USING (arm) WHERE id <> 5 GROUP BY 1)
SELECT 'price' AS metric, printf('| price | %.2f | %.1f | %d |', round(median(mine), 6), round(median(pct), 6), count(*)) AS line FROM p
""")
def _(spark, sf):
    p = table(spark, sf, "part")
    s = p.select((F.col("p_partkey") % 3).alias("arm"), F.floor(F.col("p_partkey") / 3).alias("id"), F.col("p_retailprice").alias("price"))
    return campaign.blind_report(s, "id", 5, ["price"])


