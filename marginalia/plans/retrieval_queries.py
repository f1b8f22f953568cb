"""Retrieval, recall, and passages against documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import matching, retrieval
from marginalia.plans.fixtures import table
from marginalia.sources.scratch import written

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_TOKENS = r"lower(unnest(regexp_extract_all({x}, '[\p{{L}}\p{{M}}]+')))"
_BM25 = f"""
d AS (SELECT doc_id, {_TOKENS.format(x='text')} AS term FROM documents), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM d) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
dl AS (SELECT doc_id, count(*) AS dl FROM d GROUP BY doc_id), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, {_TOKENS.format(x='text')} AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id AS id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), n GROUP BY 1, 2),
f AS (SELECT query_id, id, round(score, 9) AS score FROM s UNION ALL SELECT item_id, doc_id, 0.0 FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 6) AS d6 WHERE (item_id, doc_id) NOT IN (SELECT (query_id, id) FROM s)),
top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 3),
gold AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))
"""


def _queries(spark, sf):
    return table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")


def _bm25(spark, sf):
    return retrieval.bm25(table(spark, sf, "documents"), _queries(spark, sf), tokenizer=retrieval.letters)


def _gold(spark, sf):
    held = matching.candidates(table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")), table(spark, sf, "documents"))
    both = held.join(retrieval.broadcast_if_small(table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("p"))), "passage_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return both.filter(F.contains("text", F.col("p"))).select(F.col("passage_id").alias("query_id"), F.col("doc_id").alias("id"))


#: Only what the index needs.
_INDEX = _BM25[: _BM25.index("\nq AS (")].rstrip().rstrip(",")


@query("r2_bm25_index", f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM df JOIN idf USING (term)")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    index = written(retrieval.postings(docs, "doc_id", "text", retrieval.letters), "postings")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(retrieval.idf(index, retrieval.statistics(docs, index)), "term").select("term", "df", F.round("idf", 6).alias("idf"))


@query("r3_bm25_search", f"WITH {_BM25} SELECT query_id, id, round(score, 4) AS score, rank FROM top")
def _(spark, sf):
    return _bm25(spark, sf).select("query_id", "id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("r3_bm25_recall", f"""
WITH {_BM25}, b AS (SELECT query_id, min(rank) AS best FROM gold LEFT JOIN top USING (query_id, id) GROUP BY query_id)
SELECT count(*) AS questions, count(*) FILTER (best <= 1) AS hits_at_1, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, count(*) FILTER (best <= 3) AS hits_at_3, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3 FROM b
""")
def _(spark, sf):
    return retrieval.recall(_bm25(spark, sf), written(_gold(spark, sf), "gold"))


@query("r4_overlap_fallback", r"""
WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s\-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: replace(x, '-', '') <> ''))) AS term FROM documents),
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s\-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: replace(x, '-', '') <> ''))) AS term FROM benchmark),
s AS (SELECT query_id, doc_id AS id, CAST(count(*) AS DOUBLE) AS score FROM q JOIN w USING (term) GROUP BY 1, 2)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, 'DEGRADED:word overlap' AS retriever_backend FROM s QUALIFY rank <= 3
""")
def _(spark, sf):
    return retrieval.overlap_search(table(spark, sf, "documents"), _queries(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query("r5_backend_tag", "SELECT DISTINCT 'DEGRADED:no compound segmenter' AS retriever_backend, true AS degraded FROM benchmark")
def _(spark, sf):
    from marginalia.provenance import is_degraded

    return _bm25(spark, sf).select("retriever_backend").distinct().withColumn("degraded", is_degraded(F.col("retriever_backend")))


_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"
_DENSE = f"""
v AS (SELECT vec_id, label, {_UNIT} AS u FROM embeddings), q AS (SELECT vec_id AS query_id, label AS asked, u AS w FROM v WHERE vec_id % 50 = 0),
p AS (SELECT query_id, asked, vec_id AS id, label, round(list_dot_product(u, w), 6) AS score FROM v, q WHERE vec_id <> query_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p QUALIFY rank <= 3)
"""


def _dense(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.dense(e, e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


@query("r6_unit_vectors", f"SELECT vec_id, round(list_sum(list_transform({_UNIT}, lambda z: z * z)), 6) AS norm, round(({_UNIT})[1], 6) AS first FROM embeddings")
def _(spark, sf):
    u = retrieval.unit_length(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf, "embeddings").withColumn("u", u).select("vec_id", F.round(retrieval.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("r7_dense_search", f"WITH {_DENSE} SELECT query_id, id, round(score, 5) AS score, rank FROM top")
def _(spark, sf):
    return _dense(spark, sf).select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("r8_mode_dispatch", f"WITH {_BM25}, {_DENSE.replace('top AS', 'dtop AS').replace(', q AS', ', dq AS').replace('FROM v, q', 'FROM v, dq')} SELECT 'rag_bm25' AS mode, count(*) AS rows FROM top UNION ALL SELECT 'rag_dense', count(*) FROM dtop")
def _(spark, sf):
    modes = {"rag_bm25": _bm25(spark, sf).select("query_id", "id"), "rag_dense": _dense(spark, sf).select("query_id", "id")}
    parts = [(m, retrieval.dispatch(modes, m)) for m in ("closed_book", "rag_bm25", "rag_dense")]
    found = [df.agg(F.count("*").alias("rows")).select(F.lit(m).alias("mode"), "rows") for m, df in parts if df is not None]
    return found[0].unionByName(found[1])


@query("r9_dense_recall", f"""
WITH {_DENSE}, b AS (SELECT query_id, min(CASE WHEN label = asked THEN rank END) AS best FROM top GROUP BY query_id)
SELECT count(*) AS questions, count(*) FILTER (best <= 1) AS hits_at_1, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, count(*) FILTER (best <= 3) AS hits_at_3, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3 FROM b
""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # gold is every row of a query's label: only those that were found are asked for, and each query has itself
    found = written(_dense(spark, sf), "found")
    labels = found.select("query_id", "id").join(e.select(F.col("vec_id").alias("id"), "label"), "id").join(retrieval.broadcast_if_small(asked), ["query_id", "label"])
    gold = labels.select("query_id", "id").unionByName(asked.filter("label is not null").select("query_id", F.col("query_id").alias("id")))
    return retrieval.recall(found, gold)


@query("r10_recall_misses", f"""
WITH {_BM25}, wrong AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN -1 ELSE id END AS id FROM gold), hit AS (SELECT DISTINCT query_id FROM wrong JOIN top USING (query_id, id))
SELECT query_id, (SELECT count(*) FROM top WHERE top.query_id = g.query_id) AS instead FROM (SELECT DISTINCT query_id FROM wrong WHERE query_id NOT IN (SELECT query_id FROM hit)) AS g
""")
def _(spark, sf):
    # every third question has a gold id that nothing has
    wrong = written(_gold(spark, sf), "gold").withColumn("id", F.when(F.col("query_id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")))
    return retrieval.misses(written(_bm25(spark, sf), "found"), wrong).select("query_id", F.size("instead").cast("long").alias("instead"))


@query("r11_gold_presence", f"WITH {_BM25} SELECT count(DISTINCT query_id) AS questions, count(DISTINCT CASE WHEN (query_id, id) IN (SELECT (query_id, id) FROM top) THEN query_id END) AS present FROM gold")
def _(spark, sf):
    gold = _gold(spark, sf)
    seen = gold.join(_bm25(spark, sf).select("query_id", "id", F.lit(True).alias("seen")), ["query_id", "id"], "left")
    return seen.agg(F.count_distinct("query_id").alias("questions"), F.count_distinct(F.when(F.col("seen"), F.col("query_id"))).alias("present"))


# --- passages -----------------------------------------------------------------------
def _passages(spark, sf):
    """Benchmark items as passages: every third with spoiled spaces, every third of the rest without diacritics."""
    text = F.when(F.col("item_id") % 3 == 1, F.regexp_replace("text", "(e)([a-z])", "$1 $2")).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 7 != 0).alias("is_answerable"), F.when(F.col("item_id") % 11 == 1, F.lit("  ")).otherwise(text).alias("gold_passage"))


_TIERS = r"""
p AS (SELECT item_id AS id, item_id % 7 <> 0 AS asked, CASE WHEN item_id % 11 = 1 THEN '  ' WHEN item_id % 3 = 1 THEN regexp_replace(text, '(e)([a-z])', '\1 \2', 'g') ELSE text END AS t FROM benchmark),
f AS (SELECT id, asked, trim(regexp_replace(t, '\s+', ' ', 'g')) AS s, regexp_replace(t, '\s+', '', 'g') AS q FROM p), d AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS s, regexp_replace(text, '\s+', '', 'g') AS q FROM documents),
h AS (SELECT f.id, min(CASE WHEN contains(d.s, f.s) OR (length(d.s) >= 30 AND contains(f.s, d.s)) THEN 0 WHEN contains(d.q, f.q) OR (length(d.q) >= 30 AND contains(f.q, d.q)) THEN 1
  WHEN contains(replace(strip_accents(d.s), 'đ', 'd'), replace(strip_accents(f.s), 'đ', 'd')) THEN 2 END) AS tier FROM f, d WHERE f.asked AND f.s <> '' GROUP BY f.id),
tiers AS (SELECT f.id, CASE WHEN NOT asked THEN 'probe' WHEN s = '' THEN 'no_passage' WHEN tier IS NULL THEN 'not_found' ELSE ['strict', 'squash', 'loose'][tier + 1] END AS tier FROM f LEFT JOIN h USING (id))
"""


@query("a17_passage_coverage", f"WITH {_TIERS} SELECT id, tier FROM tiers")
def _(spark, sf):
    return matching.coverage_tiers(_passages(spark, sf), table(spark, sf, "documents"))


@query("a18_coverage_report", f"""
WITH {_TIERS} SELECT count(*) AS total_questions, count(*) FILTER (tier IN ('strict', 'squash', 'loose', 'not_found')) AS answerable_questions, count(*) FILTER (tier = 'probe') AS unanswerable_probes_excluded,
  count(*) FILTER (tier = 'no_passage') AS answerable_without_passage, count(*) FILTER (tier = 'strict') AS strict_matches, count(*) FILTER (tier = 'squash') AS squash_matches, count(*) FILTER (tier = 'loose') AS loose_matches, count(*) FILTER (tier = 'not_found') AS not_found,
  round(count(*) FILTER (tier = 'strict') * 100.0 / count(*) FILTER (tier NOT IN ('probe', 'no_passage')), 2) AS strict_coverage_pct, round(count(*) FILTER (tier = 'squash') * 100.0 / count(*) FILTER (tier NOT IN ('probe', 'no_passage')), 2) AS squash_coverage_pct,
  round(count(*) FILTER (tier = 'loose') * 100.0 / count(*) FILTER (tier NOT IN ('probe', 'no_passage')), 2) AS loose_coverage_pct, round(count(*) FILTER (tier IN ('strict', 'squash', 'loose')) * 100.0 / count(*) FILTER (tier NOT IN ('probe', 'no_passage')), 2) AS total_coverage_pct FROM tiers
""")
def _(spark, sf):
    return matching.coverage_report(matching.coverage_tiers(_passages(spark, sf), table(spark, sf, "documents")))


_WINDOWS = r"""
w AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
k AS (SELECT *, greatest(len(w) - {size} + 1, 1) AS n, least(greatest(len(w) - {size} + 1, 1), 24) AS k FROM w),
pr AS (SELECT item_id, p, len(w) AS words, list_transform(range(0, CAST(k AS BIGINT)), lambda i: array_to_string(w[CAST(floor(i * n / k) AS BIGINT) + 1 : CAST(floor(i * n / k) AS BIGINT) + {size}], ' ')) AS probes FROM k),
d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
m AS (SELECT item_id, doc_id, contains(t, p) AS whole, len(list_filter(probes, lambda x: contains(t, x))) / len(probes)::DOUBLE AS ratio FROM pr, d)
"""


@query("q1_match_passages", f"""
WITH {_WINDOWS.format(size=8)}, b AS (SELECT item_id, min(CASE WHEN whole THEN doc_id END) AS strict, max(ratio) AS ratio FROM m GROUP BY item_id),
f AS (SELECT b.item_id, min(m.doc_id) AS first FROM b JOIN m ON m.item_id = b.item_id AND m.ratio = b.ratio GROUP BY b.item_id)
SELECT item_id AS passage_id, CASE WHEN strict IS NOT NULL THEN strict WHEN ratio > 0 THEN first END AS doc_id, CASE WHEN strict IS NOT NULL THEN 'strict' WHEN ratio > 0 THEN 'fragment' ELSE 'none' END AS tier,
  round(CASE WHEN strict IS NOT NULL THEN 1.0 ELSE ratio END, 6) AS ratio FROM b JOIN f USING (item_id)
""")
def _(spark, sf):
    return matching.match_passages(table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")), table(spark, sf, "documents"))


@query("q2_audit_fidelity", r"""
WITH w AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
z AS (SELECT *, CASE WHEN len(w) < 12 THEN 3 WHEN len(w) < 25 THEN 4 WHEN len(w) < 60 THEN 6 ELSE 8 END AS size FROM w),
k AS (SELECT *, greatest(len(w) - size + 1, 1) AS n, least(greatest(len(w) - size + 1, 1), 24) AS k FROM z),
pr AS (SELECT item_id, p, size, list_transform(range(0, CAST(k AS BIGINT)), lambda i: array_to_string(w[CAST(floor(i * n / k) AS BIGINT) + 1 : CAST(floor(i * n / k) AS BIGINT) + size], ' ')) AS probes FROM k),
d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
m AS (SELECT item_id, size, doc_id, contains(t, p) AS whole, len(list_filter(probes, lambda x: contains(t, x))) / len(probes)::DOUBLE AS ratio FROM pr, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY whole DESC, ratio DESC, doc_id) AS rn FROM m QUALIFY rn = 1)
SELECT item_id AS passage_id, CAST(size AS BIGINT) AS "window", CASE WHEN whole OR ratio > 0 THEN doc_id END AS doc_id, round(CASE WHEN whole THEN 1.0 ELSE ratio END, 3) AS ratio,
  CASE WHEN whole THEN 'verbatim' WHEN ratio >= 0.7 THEN 'quotable' WHEN ratio >= 0.35 THEN 'partial' ELSE 'paraphrase-or-missing' END AS fidelity, CAST(NULL AS BOOLEAN) AS article_present FROM r
""")
def _(spark, sf):
    return matching.audit(table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")), table(spark, sf, "documents"))


@query("q3_yield_by_document", f"""
WITH {_WINDOWS.format(size=8)}, b AS (SELECT item_id, min(CASE WHEN whole THEN doc_id END) AS strict, max(ratio) AS ratio FROM m GROUP BY item_id), f AS (SELECT b.item_id, min(m.doc_id) AS first FROM b JOIN m ON m.item_id = b.item_id AND m.ratio = b.ratio GROUP BY b.item_id),
v AS (SELECT CASE WHEN strict IS NOT NULL THEN strict WHEN ratio > 0 THEN first END AS doc_id, strict IS NOT NULL AS s FROM b JOIN f USING (item_id))
SELECT documents.doc_id, count(v.doc_id) AS passages, count(*) FILTER (v.s) AS verbatim FROM documents LEFT JOIN v ON v.doc_id = documents.doc_id GROUP BY documents.doc_id
""")
def _(spark, sf):
    found = matching.match_passages(table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")), table(spark, sf, "documents"))
    return matching.yield_by_document(found, table(spark, sf, "documents"))


@query("q5_token_recall", r"""
WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(strip_accents(text)), '[0-9a-zA-ZÀ-ỹ]{2,}')) AS s FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(strip_accents(text)), '[0-9a-zA-ZÀ-ỹ]{2,}')) AS a FROM documents)
SELECT item_id, doc_id, round(len(list_intersect(s, a)) / len(s)::DOUBLE, 6) AS recall FROM b, d WHERE item_id = doc_id
""")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("s"))
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.join(retrieval.broadcast_if_small(b), F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", F.round(matching.token_recall(F.col("s"), F.col("text")), 6).alias("recall"))


@query("q12_containment", f"WITH {_WINDOWS.format(size=8)} SELECT item_id, doc_id, round(ratio, 6) AS ratio FROM m WHERE ratio > 0")
def _(spark, sf):
    from marginalia.functions.text import squeeze, windows

    p = table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    d = table(spark, sf, "documents").select("doc_id", "text")
    pairs = matching.candidates(p, d).join(retrieval.broadcast_if_small(p), "passage_id").join(d, "doc_id")
    ratio = matching.containment(windows(F.col("passage"), 8, 24), squeeze(F.col("text")))
    return pairs.select(F.col("passage_id").alias("item_id"), "doc_id", F.round(ratio, 6).alias("ratio")).filter("ratio > 0")


@query("c15_bigram_overlap", r"""
WITH w AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{M}]+'), lambda x: lower(x)) AS w FROM benchmark), g AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] AS g FROM w, unnest(range(1, len(w))) AS r(i)),
v AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{M}]+'), lambda x: lower(x)) AS w FROM documents), h AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM v, unnest(range(1, len(w))) AS r(i)), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id)
SELECT item_id AS passage_id, doc_id, round(count(*) / n::DOUBLE, 4) AS overlap FROM g JOIN h USING (g) JOIN n USING (item_id) GROUP BY item_id, doc_id, n
""")
def _(spark, sf):
    return matching.overlap(table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")), table(spark, sf, "documents"))
