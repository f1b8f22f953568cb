"""Inputs made of the driver's tables by the same expressions in Spark and in SQL.

Every expected value follows from columns, so an oracle never repeats what it tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.legal import SENTINEL

MODELS, MODES = ["alpha", "beta", "gamma"], ["closed_book", "rag_bm25", "rag_dense"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same columns in SQL: a WITH list that oracles begin with.
ANSWERS_SQL = f"""
answers AS (
  SELECT concat('Q', l_orderkey, '-', l_linenumber) AS question_id,
         ['alpha', 'beta', 'gamma'][CAST(l_suppkey % 3 AS INTEGER) + 1] AS model_name,
         ['closed_book', 'rag_bm25', 'rag_dense'][CAST(l_linenumber % 3 AS INTEGER) + 1] AS retrieval_mode,
         CAST(l_orderkey % 7 AS INTEGER) AS kind, l_orderkey, l_linenumber, p_size AS article, l_linenumber AS clause,
         concat(CAST(10 + l_suppkey % 80 AS VARCHAR), '/2024/TT-NHNN') AS doc, CAST(l_quantity AS INTEGER) AS figure, (p_partkey % 4) <> 0 AS asked
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) JOIN part ON l_partkey = p_partkey),
sentences AS (
  SELECT *, concat('Theo Điều ', article, ' Khoản ', clause, ' Thông tư ', doc, ', hạn mức giao dịch thẻ là ', figure, ' triệu đồng/ngày') AS gold_sentence,
    CASE kind
      WHEN 0 THEN concat('Theo Điều ', article, ' Khoản ', clause, ' Thông tư ', doc, ', hạn mức giao dịch thẻ là ', figure, ' triệu đồng/ngày')
      WHEN 1 THEN concat('Theo Điều ', article + 100, ' Khoản ', clause, ' Thông tư ', doc, ', hạn mức giao dịch thẻ là ', figure, ' triệu đồng/ngày')
      WHEN 2 THEN concat('Theo Điều ', article, ' Khoản ', clause, ' Thông tư ', replace(doc, '/2024/', '/2023/'), ', hạn mức giao dịch thẻ là ', figure, ' triệu đồng/ngày')
      WHEN 3 THEN concat('Theo Điều ', article, ' Khoản ', clause, ' Thông tư ', doc, ', hạn mức giao dịch thẻ là ', figure + 100, ' triệu đồng/ngày')
      WHEN 4 THEN concat('Hạn mức giao dịch thẻ là ', figure, ' triệu đồng/ngày')
      WHEN 5 THEN '{SENTINEL}'
      ELSE concat('{SENTINEL}. Theo Điều ', article, ' Khoản ', clause, ' Thông tư ', doc, ', hạn mức giao dịch thẻ là ', figure, ' triệu đồng/ngày')
    END AS answer_text
  FROM answers)
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer for each line item: right, wrong in one of three ways, uncited, a refusal, or a refusal with an answer."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    rows = items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pick = lambda names, key: F.get(F.array(*[F.lit(n) for n in names]), (F.col(key) % 3).cast("int"))
    t = rows.select(
        F.concat(F.lit("Q"), "l_orderkey", F.lit("-"), "l_linenumber").alias("question_id"), pick(MODELS, "l_suppkey").alias("model_name"), pick(MODES, "l_linenumber").alias("retrieval_mode"),
        (F.col("l_orderkey") % 7).cast("int").alias("kind"), "l_orderkey", "l_linenumber", F.col("p_size").alias("article"), F.col("l_linenumber").alias("clause"),
        F.concat((10 + F.col("l_suppkey") % 80).cast("string"), F.lit("/2024/TT-NHNN")).alias("doc"), F.round("l_quantity").cast("int").alias("figure"), (F.col("p_partkey") % 4 != 0).alias("asked"),
    )

    def sentence(article, doc, figure):
        return F.concat(F.lit("Theo Điều "), article.cast("string"), F.lit(" Khoản "), F.col("clause").cast("string"), F.lit(" Thông tư "), doc, F.lit(", hạn mức giao dịch thẻ là "), figure.cast("string"), F.lit(" triệu đồng/ngày"))

    a, d, f, kind = F.col("article"), F.col("doc"), F.col("figure"), F.col("kind")
    gold = sentence(a, d, f)
    text = (
        F.when(kind == 0, gold).when(kind == 1, sentence(a + 100, d, f)).when(kind == 2, sentence(a, F.replace(d, F.lit("/2024/"), F.lit("/2023/")), f)).when(kind == 3, sentence(a, d, f + 100))
        .when(kind == 4, F.concat(F.lit("Hạn mức giao dịch thẻ là "), f.cast("string"), F.lit(" triệu đồng/ngày"))).when(kind == 5, SENTINEL).otherwise(F.concat(F.lit(SENTINEL + ". "), gold))
    )
    return t.withColumn("gold_sentence", gold).withColumn("answer_text", text)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers() with gold and contexts, as the scorer takes them; closed book has no context, a probe no gold."""
    asked = F.col("asked")
    cite = F.struct(F.col("doc").alias("doc_id"), F.col("article").cast("string").alias("article_id"), F.col("clause").cast("string").alias("clause_id"), F.lit("passage-header").alias("confidence"))
    none = F.array().cast("array<string>")
    return answers(spark, sf_dir).withColumns({
        "contexts": F.when(F.col("retrieval_mode") == "closed_book", none).otherwise(F.array("gold_sentence")),
        "is_answerable": asked, "category": F.when(asked, "factual").otherwise("unanswerable"), "reference_answer": F.when(asked, F.col("gold_sentence")).otherwise(SENTINEL),
        "gold_passage": F.when(asked, F.col("gold_sentence")).otherwise(""), "gold_doc_ids": F.when(asked, F.array("doc")).otherwise(none),
        "gold_citations": F.filter(F.array(cite), lambda c: F.col("asked")), "source_urls": none, "gold_citation_validity": F.lit("unknown"),
        "corpus_source": F.when(F.col("l_orderkey") % 11 == 0, "tier1_passages").otherwise("tier2_full"),
        "retriever_backend": F.when(F.col("l_orderkey") % 13 == 0, "DEGRADED:stub").otherwise("whole"),
    })


def legal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legal text for each supplier, with a part, chapters, articles, clauses and page furniture."""
    k = F.col("s_suppkey")
    n = (k % 4 + 1).cast("int")

    def article(i):
        head = F.concat(F.lit("Điều "), i.cast("string"), F.when(i % 2 == 0, F.lit("")).otherwise(F.lit(". Tiêu đề")))
        body = F.when(i % 2 == 0, F.lit("Phạm vi điều chỉnh\nVăn bản này quy định về thẻ.")).otherwise(F.lit("1. Khoản một.\nTiếp theo.\n2. Khoản hai."))
        return F.concat(head, F.lit("\n"), body)

    text = F.concat(F.lit("NGÂN HÀNG NHÀ NƯỚC\nPhần thứ nhất. Chung\nChương I. Mở đầu\n"), F.array_join(F.transform(F.sequence(F.lit(1), n), article), "\nTrang 2/9\n"), F.lit("\nPhụ lục II: Mẫu biểu\nDòng mẫu"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("D"), k).alias("doc_id"), F.lit("Thông tư").alias("doc_title"), F.when(k % 5 == 4, F.lit("Công văn không có điều khoản\nNội dung")).otherwise(text).alias("text"), n.alias("n"), (k % 5 == 4).alias("bare"))


LEGAL_SQL = """
legal AS (SELECT concat('D', s_suppkey) AS doc_id, CAST(s_suppkey % 4 + 1 AS INTEGER) AS n, s_suppkey % 5 = 4 AS bare FROM supplier)
"""


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold CSV's row for each part: every fourth a probe, one without id, one without evidence, several addresses."""
    k = F.col("p_partkey")
    link = F.concat(F.lit("https://congbao.example/van-ban/thong-tu-so-"), (k % 9 + 1).cast("string"), F.lit("-2019-tt-nhnn-1.htm"))
    second = F.concat(F.lit("\nhttps://x.example/Nghi-dinh-"), (k % 50 + 10).cast("string"), F.lit("-2021-ND-CP-a.htm."))
    probe = k % 4 == 0
    return table(spark, sf_dir, "part").select(
        (k + 1).alias("ordinal"), F.when(k % 10 == 3, F.lit("")).when(k % 10 == 5, F.concat(F.lit("P"), k)).otherwise(k.cast("string")).alias("ID"), F.concat(F.lit("Hạn mức của "), "p_name", F.lit(" là gì?")).alias("question"),
        F.when(probe, F.lit(SENTINEL + ".")).otherwise(F.concat(F.lit("Là "), "p_size", F.lit(" triệu đồng"))).alias("answer"),
        F.when(probe | (k % 17 == 1), F.lit("")).otherwise(F.concat(F.lit("Điều "), "p_size", F.lit(" Khoản 2: hạn mức "), "p_size", F.lit(" triệu đồng"))).alias("text_contains_answer_in_the_doc"),
        F.when(probe, F.lit("N/A")).when(k % 3 == 0, F.concat(link, second)).otherwise(link).alias("doc_link"), F.lit("An; Binh").alias("author"),
    )
