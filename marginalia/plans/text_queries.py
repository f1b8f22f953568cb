"""Text functions over the tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import legal
from marginalia.functions import text as t
from marginalia.operators import retrieval
from marginalia.plans.fixtures import table
from marginalia.sources import files

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark, sf):
    return table(spark, sf, "documents")


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_WORDS = r"regexp_extract_all({x}, '[\p{{L}}\p{{M}}]+')"


@query("n1_normalize_ws", f"SELECT doc_id, md5({_FLAT}) AS h, CAST(length({_FLAT}) AS BIGINT) AS n FROM documents")
def _(spark, sf):
    c = t.normalize_ws(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(c).alias("h"), F.length(c).cast("long").alias("n"))


@query("n2_fold_diacritics", f"SELECT doc_id, md5(replace(replace(strip_accents({_FLAT}), 'đ', 'd'), 'Đ', 'D')) AS h FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.fold(t.squeeze(F.col("text")))).alias("h"))


@query("n3_squash_ws", r"SELECT doc_id, md5(regexp_replace(text, '\s+', '', 'g')) AS h FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.squash(F.col("text"))).alias("h"))


@query("n4_normalize_case", f"SELECT doc_id, md5(lower({_FLAT})) AS plain, md5(lower(strip_accents({_FLAT}))) AS folded FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.plain(F.col("text"))).alias("plain"), F.md5(t.folded(F.col("text"))).alias("folded"))


@query("n5_answer_cell", r"SELECT conv_id, turn, md5(lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[\s.!?;:,-]+$', ''))) AS h FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(t.answer_cell(F.col("text"))).alias("h"))


_SENTINELS = "CASE r_regionkey WHEN 0 THEN 'Không có trong kho văn bản' WHEN 1 THEN '  không có  trong kho văn bản. ' WHEN 2 THEN 'Không có trong kho' WHEN 3 THEN 'KHÔNG CÓ TRONG KHO VĂN BẢN!' ELSE r_name END"


@query("n6_sentinel_answer", "SELECT r_regionkey, r_regionkey IN (0, 1, 3) AS sentinel FROM region")
def _(spark, sf):
    from marginalia.operators.gold import is_sentinel

    return table(spark, sf, "region").select("r_regionkey", is_sentinel(F.expr(_SENTINELS)).alias("sentinel"))


@query("n7_content_tokens", f"""
SELECT doc_id, CAST(count(DISTINCT w) AS BIGINT) AS n, md5(string_agg(DISTINCT w, ' ' ORDER BY w)) AS h
FROM (SELECT doc_id, lower(unnest({_WORDS.format(x='text')})) AS w FROM documents)
WHERE length(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in t.STOPWORDS)}) GROUP BY doc_id
""")
def _(spark, sf):
    tokens = F.array_sort(t.content_tokens(F.col("text")))
    return _docs(spark, sf).select("doc_id", tokens.alias("w")).filter(F.size("w") > 0).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("h"))


@query("n8_stopwords", f"SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, ['và', 'không', 'phải', 'được', 'của'][CAST(n_nationkey % 5 AS INTEGER) + 1] IN ('và', 'của') AS stop FROM nation")
def _(spark, sf):
    word = F.expr("element_at(array('và', 'không', 'phải', 'được', 'của'), cast(n_nationkey % 5 as int) + 1)")
    return table(spark, sf, "nation").select("n_nationkey", word.isin(t.STOPWORDS).alias("stop"))


_VI = t.vietnamese_letters()


@query("n9_vietnamese_ratio", f"""
SELECT doc_id, round(coalesce(v / nullif(v + a, 0), 0), 6) AS ratio FROM (SELECT doc_id,
  CAST(length(text) - length(regexp_replace(text, '[{_VI}]', '', 'g')) AS DOUBLE) AS v, CAST(length(text) - length(regexp_replace(text, '[a-zA-Z]', '', 'g')) AS DOUBLE) AS a FROM documents)
""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(t.vietnamese_ratio(F.col("text")), 6).alias("ratio"))


@query("n10_looks_reversed", r"""
WITH l AS (SELECT doc_id, text, list_sort(list_transform(list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x))) AS n FROM documents)
SELECT doc_id, len(n) >= 8 AND length(text) >= 400 AND coalesce(n[CAST(floor(len(n) / 2) AS INTEGER) + 1], 99) <= 6 AS reversed FROM l
""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", t.looks_reversed(F.col("text")).alias("reversed"))


@query("n11_bigrams", f"""
WITH w AS (SELECT item_id, list_transform({_WORDS.format(x='text')}, lambda x: lower(x)) AS w FROM benchmark),
g AS (SELECT item_id, w[i] || ' ' || w[i + 1] AS g FROM w, unnest(range(1, len(w))) AS r(i))
SELECT item_id, CAST(count(DISTINCT g) AS BIGINT) AS n, md5(string_agg(DISTINCT g, '|' ORDER BY g)) AS h FROM g GROUP BY item_id
""")
def _(spark, sf):
    g = F.array_sort(t.bigrams(F.col("text")))
    return table(spark, sf, "benchmark").select("item_id", F.size(g).cast("long").alias("n"), F.md5(F.array_join(g, "|")).alias("h"))


@query("n12_even_windows", r"""
WITH w AS (SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
s AS (SELECT item_id, w, greatest(len(w) - 8 + 1, 1) AS n FROM w), k AS (SELECT *, least(n, 24) AS k FROM s)
SELECT item_id, k AS windows, md5(list_aggregate(list_transform(range(0, CAST(k AS BIGINT)), lambda i: list_aggregate(w[CAST(floor(i * n / k) AS BIGINT) + 1 : CAST(floor(i * n / k) AS BIGINT) + 8], 'string_agg', ' ')), 'string_agg', '|')) AS h FROM k
""")
def _(spark, sf):
    w = t.windows(F.col("text"), 8, 24)
    return table(spark, sf, "benchmark").select("item_id", F.size(w).cast("long").alias("windows"), F.md5(F.array_join(w, "|")).alias("h"))


@query("n13_window_size", r"""
SELECT doc_id, CAST(CASE WHEN n < 12 THEN 3 WHEN n < 25 THEN 4 WHEN n < 60 THEN 6 ELSE 8 END AS INTEGER) AS w
FROM (SELECT doc_id, len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS n FROM documents)
""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", t.window_size(F.size(F.split(t.squeeze(F.col("text")), " "))).alias("w"))


@query("n14_repair_tokens", r"""
SELECT item_id, CAST(count(DISTINCT w) AS BIGINT) AS n, md5(string_agg(DISTINCT w, ' ' ORDER BY w)) AS h
FROM (SELECT item_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[0-9a-zA-ZÀ-ỹ]{2,}')) AS w FROM benchmark) GROUP BY item_id
""")
def _(spark, sf):
    from marginalia.operators.matching import repair_tokens

    w = F.array_sort(repair_tokens(F.col("text")))
    return table(spark, sf, "benchmark").select("item_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("h"))


@query("n15_split_urls", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat(url, '|http://b.example/x') ELSE url END AS urls, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n FROM pages")
def _(spark, sf):
    cell = F.concat(F.lit("xem "), "url", F.lit(".\n"), F.when(F.col("page_id") % 2 == 0, F.lit("<http://b.example/x>, ")).otherwise(""), F.col("url"), F.lit("\n\n"))
    found = t.urls(cell)
    return table(spark, sf, "pages").select("page_id", F.array_join(found, "|").alias("urls"), F.size(found).alias("n")).withColumn("urls", F.when(F.col("n") == 2, F.col("urls")).otherwise(F.col("urls")))


@query("n16_url_basename", r"SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.url_basename(F.col("url")).alias("name"))


@query("n20_parse_number", """
SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 900 + 1) * 1000000 WHEN 1 THEN p_partkey + 0.5 WHEN 2 THEN p_size ELSE (p_partkey % 900 + 1) * 1000 + 123 END AS DOUBLE) AS value FROM part
""")
def _(spark, sf):
    k = F.col("p_partkey")
    three = (k % 900 + 1).cast("string")
    raw = F.when(k % 4 == 0, F.concat(three, F.lit(".000.000"))).when(k % 4 == 1, F.concat(k, F.lit(",5"))).when(k % 4 == 2, F.lpad("p_size", 2, "0")).otherwise(F.concat(three, F.lit(".123")))
    return table(spark, sf, "part").select("p_partkey", legal.parse_number(raw).alias("value"))


@query("n21_hashes", "SELECT doc_id, substr(sha256(text), 1, 16) AS content, substr(sha256(concat(doc_id, ':', source)), 1, 24) AS key FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", t.hash_prefix(F.col("text"), 16).alias("content"), t.hash_prefix(F.concat_ws(":", "doc_id", "source"), 24).alias("key"))


@query("n22_clip", rf"SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text ELSE concat(regexp_replace(substr(text, 1, 500), '\s+$', ''), chr(10), '{t.TRUNCATED}') END) AS h FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.clip(F.col("text"), 500)).alias("h"))


@query("n23_output_stats", rf"""
WITH w AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters,
  length(text) - length(regexp_replace(text, '[{_VI}]', '', 'g')) AS v FROM documents)
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(w) AS BIGINT) AS tokens, coalesce(round(CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS DOUBLE) / nullif(len(w), 0), 3), 0) AS distinct_ratio,
  coalesce(round(CAST(v AS DOUBLE) / nullif(letters, 0), 4), 0) AS diacritic_ratio, CAST({" + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in t.VIETNAMESE_WORDS)} AS BIGINT) AS function_words FROM w
""")
def _(spark, sf):
    stats = t.output_stats(F.col("text"))
    return _docs(spark, sf).select("doc_id", *[c.alias(n) for n, c in stats.items()])


@query("n24_tex_plain", "SELECT n_nationkey, concat('We study ', n_name, ' with 5% of data and x y.') AS plain FROM nation")
def _(spark, sf):
    raw = F.concat(F.lit("We  study \\emph{"), "n_name", F.lit("} \\cite{a,b} with 5\\% of data % note\nand $x$ \\alpha~y."))
    return table(spark, sf, "nation").select("n_nationkey", t.tex_plain(raw).alias("plain"))


@query("n25_clean_text", f"SELECT conv_id, turn, md5({_FLAT}) AS h FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(t.squeeze(F.col("text"))).alias("h"))


@query("n26_as_flag", "SELECT n_nationkey, n_nationkey % 6 < 3 AS flag FROM nation")
def _(spark, sf):
    raw = F.expr("element_at(array('1', ' TRUE', 'yes ', '0', 'False', 'NO'), cast(n_nationkey % 6 as int) + 1)")
    return table(spark, sf, "nation").select("n_nationkey", t.as_flag(raw).alias("flag"))


@query("n27_notes_codec", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, CAST(3 AS INTEGER) AS keys FROM nation")
def _(spark, sf):
    notes = t.notes_text({"name": F.col("n_name"), "region": F.col("n_regionkey"), "a": F.lit("x(b=c)"), "gone": F.lit(None).cast("string")})
    m = t.notes_map(F.concat(notes, F.lit("; junk")))
    return table(spark, sf, "nation").select("n_nationkey", m["name"].alias("name"), m["region"].alias("region"), F.size(m).alias("keys"))


@query("s14_html_body", r"""
WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<header\b.*?</header\s*>|<footer\b.*?</footer\s*>|<form\b.*?</form\s*>|<aside\b.*?</aside\s*>|<head\b.*?</head\s*>', chr(10), 'g') AS h FROM pages),
c AS (SELECT page_id, replace(replace(replace(regexp_replace(h, '<[^>]*>', chr(10), 'g'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS h FROM b)
SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS h FROM c
""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(files.html_body(F.col("html"))).alias("h"))


@query("r1_tokens", r"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS h FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s\-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: replace(x, '-', '') <> '') AS w FROM documents)
""")
def _(spark, sf):
    w = retrieval.tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("h"))
