"""Segmentation of legal text into article and clause chunks, with windows over lines.

A document is its text; its lines are numbered, classified by what they begin with, and
carried state (part, chapter, article, title, clause) is the last one set before a line.
A chunk is a run of lines between two boundaries. Only a document's own lines are ordered,
so the work is dealt by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.legal import content_kind, judged
from marginalia.functions.text import let, squeeze

#: What lines of an instrument begin with.
PART = r"(?iuU)^\s*(Phần\s+(?:thứ\s+[^.:\n\r\-]+|[IVXLCDM\d]+)|Phần)[.:\-\s]*(.*)$"
CHAPTER = r"(?iuU)^\s*(Chương\s+[IVXLCDM\d]+)[.:\-\s]*(.*)$"
ANNEX = r"(?iuU)^\s*(Phụ\s*lục)\s*([IVXLCDM\d]*)[.:\-\s]*(.*)$"
ARTICLE = r"(?iuU)^\s*(?:.*?\s*[-—]\s*)?[ĐD]\s*i\s*[ềêe]\s*u\s*(\d+[a-zA-Z]?)(?:[.:\-\s]*(.*))?$"
CLAUSE, CLAUSE_INLINE = r"^(\d+)\.\s+", r"(?U)^(?:[Kk]hoản\s*(\d+)|(\d+)\.)[.:\s]*(.*)$"
FURNITURE = r"(?iuU)^(?:Trang\s+\d+(?:\s*/\s*\d+)?|Page\s+\d+(?:\s+(?:of|/)\s+\d+)?|-+\s*\d+\s*-+|\d+)\s*$"
INLINE = r"(?iuU)^\s*(?:Điểm\s*([a-zA-Z]+)\s*)?(?:Khoản\s*(\d+)\s*)?Điều\s*(\d+[a-zA-Z]?)\b"
PREAMBLE_TITLE, WHOLE_TITLE = "Lời nói đầu", "Toàn văn (văn bản không có Điều)"


def _got(text: Column, pattern: str, group: int) -> Column:
    return F.trim(F.regexp_extract(text, pattern, group))


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, line, kind): lines with text, and what each begins with."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")).alias("pos", "line"))
    t = t.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter("line <> ''")
    bare = F.regexp_replace("line", r"^\*+\s*|\s*\*+$", "")
    kind = F.when(F.col("line").rlike(FURNITURE), "furniture").when(F.col("line").rlike(PART), "part").when(F.col("line").rlike(CHAPTER), "chapter").when(F.col("line").rlike(ANNEX), "annex")
    kind = kind.when(bare.rlike(ARTICLE), "article").when(F.col("line").rlike(INLINE), "inline").when(F.col("line").rlike(CLAUSE), "clause").when(F.col("line").rlike(CLAUSE_INLINE), "clause_word").otherwise("text")
    return t.withColumn("kind", kind).withColumn("bare", bare)


def _states(kept: DataFrame) -> DataFrame:
    """Lines without furniture, with the state that holds for each."""
    whole = Window.partitionBy("doc_id").orderBy("pos")
    before, upto = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind, line, bare = F.col("kind"), F.col("line"), F.col("bare")
    last = lambda c, w=upto: F.last(c, ignorenulls=True).over(w)
    headed = kind.isin("article", "annex")
    t = kept.withColumn("seen", F.coalesce(last(F.when(headed | (kind == "inline"), True), before), F.lit(False)))
    # an inline reference heads an article only where none has begun
    t = t.withColumn("kind", F.when((kind == "inline") & F.col("seen"), F.when(line.rlike(CLAUSE), "clause").when(line.rlike(CLAUSE_INLINE), "clause_word").otherwise("text")).otherwise(kind))
    kind = F.col("kind")
    rest = _got(bare, ARTICLE, 2)
    opens = kind.isin("article", "annex", "inline")
    in_header = (kind == "article") & rest.rlike(CLAUSE_INLINE)
    t = t.withColumn("in_header", in_header).withColumn("untitled", (kind == "article") & (rest == ""))
    t = t.withColumn("opens", opens).withColumn("rest", rest)
    t = t.withColumn("article_seq", F.sum(opens.cast("int")).over(upto))
    annex = _got(line, ANNEX, 2)
    own_article = F.when(kind == "article", _got(bare, ARTICLE, 1)).when(kind == "annex", F.concat(F.lit("PL"), annex)).when(kind == "inline", _got(line, INLINE, 3))
    t = t.withColumn("article_id", last(own_article))
    # the line after a header without a title is its title, or a clause
    follows = F.coalesce(F.lag("untitled").over(whole), F.lit(False))
    clausal = kind.isin("clause", "clause_word")
    t = t.withColumn("is_title", follows & (kind == "text")).withColumn("opens_clause", follows & clausal)
    # a clause joins its article's header if nothing but text came in between
    event = F.when(kind == "article", F.when(F.col("in_header"), "closed").otherwise("pending")).when(kind.isin("annex", "inline", "part", "chapter"), "closed").when(kind == "clause", "closed").when(F.col("opens_clause"), "closed")
    t = t.withColumn("joins", ((kind == "clause") & F.coalesce(F.last(event, ignorenulls=True).over(before) == "pending", F.lit(False))) | F.col("opens_clause"))
    starts = opens | kind.isin("part", "chapter") | ((kind == "clause") & ~F.col("joins"))
    t = t.withColumn("segment", F.sum(starts.cast("int")).over(upto))
    label = lambda p: F.concat_ws(": ", _got(line, p, 1), F.nullif(_got(line, p, 2), F.lit("")))
    t = t.withColumn("part_seq", F.sum((kind == "part").cast("int")).over(upto))
    t = t.withColumn("part", last(F.when(kind == "part", label(PART))))
    t = t.withColumn("chapter_title", F.last(F.when(kind == "chapter", label(CHAPTER)), ignorenulls=True).over(Window.partitionBy("doc_id", "part_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    number = F.coalesce(F.nullif(F.regexp_extract(line, CLAUSE_INLINE, 1), F.lit("")), F.nullif(F.regexp_extract(line, CLAUSE_INLINE, 2), F.lit("")))
    head_number = F.coalesce(F.nullif(F.regexp_extract(rest, CLAUSE_INLINE, 1), F.lit("")), F.nullif(F.regexp_extract(rest, CLAUSE_INLINE, 2), F.lit("")))
    # an article clears the clause before it; -1 stands for none
    set_clause = F.when(F.col("in_header"), head_number).when(kind.isin("article", "annex"), "-1").when(kind == "inline", F.coalesce(F.nullif(_got(line, INLINE, 2), F.lit("")), F.lit("-1"))).when((kind == "clause") | F.col("opens_clause"), number)
    t = t.withColumn("clause_now", last(set_clause))
    title = F.when(kind == "annex", _got(line, ANNEX, 3)).when((kind == "article") & ~F.col("in_header") & (rest != ""), rest).when(F.col("is_title"), line)
    t = t.withColumn("own_title", title)
    return t


def chunks(docs: DataFrame, doc_id: str = "doc_id", title: str = "doc_title", text: str = "text", corpus_source: str = "tier2_full", whole_when_articleless: bool = False, preamble: bool = True) -> DataFrame:
    """A row for each chunk: chunk_id, ordinal, article, clause, text and what they stand in.

    Page furniture goes. The first clause of an article keeps its header. Text before the
    first article is a preamble chunk. A document without articles gives nothing, or one
    whole chunk where that is asked for.
    """
    every = lines(docs, doc_id, text)
    t = _states(every.filter("kind <> 'furniture'"))
    articles = t.filter(F.col("article_id").isNotNull())
    titles = articles.groupBy("doc_id", "article_seq").agg(F.first("own_title", ignorenulls=True).alias("article_title"))
    body = articles.filter(~F.col("kind").isin("part", "chapter")).groupBy("doc_id", "article_seq", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"), F.min("pos").alias("pos"),
        F.max_by("clause_now", "pos").alias("clause_now"), F.first("article_id").alias("article_id"), F.max_by("part", "pos").alias("part"), F.max_by("chapter_title", "pos").alias("chapter_title"),
    )
    body = body.join(titles, ["doc_id", "article_seq"])
    clause = F.nullif("clause_now", F.lit("-1"))
    body = body.select(
        "doc_id", "pos", F.concat(F.col("doc_id"), F.lit("_D"), F.col("article_id"), F.lit("_K"), F.coalesce(clause, F.lit("all"))).alias("chunk_id"), "article_id",
        F.coalesce("article_title", F.lit("")).alias("article_title"), clause.alias("clause_id"), F.coalesce(F.when(F.col("chapter_title").isNotNull(), F.concat_ws(" / ", "part", "chapter_title")), F.col("part")).alias("chapter"),
        "part", F.lit(False).alias("is_preamble"), "text",
    )
    headless = t.filter(F.col("article_id").isNull() & ~F.col("kind").isin("part", "chapter"))
    with_articles = articles.select("doc_id").distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    one = lambda df, suffix, name, flag: df.groupBy("doc_id").agg(joined.alias("text")).select(
        "doc_id", F.lit(-1).alias("pos"), F.concat(F.col("doc_id"), F.lit(suffix)).alias("chunk_id"), F.lit("0").alias("article_id"), F.lit(name).alias("article_title"),
        F.lit(None).cast("string").alias("clause_id"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("part"), F.lit(flag).alias("is_preamble"), "text",
    )
    out = body
    if preamble:
        out = out.unionByName(one(headless.join(with_articles, "doc_id", "left_semi"), "_preamble", PREAMBLE_TITLE, True))
    if whole_when_articleless:
        furniture = every.filter("kind = 'furniture'").select("doc_id", (F.col("pos") + 2**30).alias("pos"), "line")
        rest = headless.select("doc_id", "pos", "line").unionByName(furniture).join(with_articles, "doc_id", "left_anti")
        out = out.unionByName(one(rest, "_wholedoc", WHOLE_TITLE, False))
    out = out.filter("text <> ''").withColumn("corpus_source", F.lit(corpus_source))
    out = out.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long")).drop("pos")
    names = docs.select(F.col(doc_id).alias("doc_id"), F.col(title).alias("doc_title")) if title in docs.columns else docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("doc_title"))
    return out.join(names, "doc_id")


def distinct_ids(df: DataFrame, *order: str, id_col: str = "chunk_id") -> DataFrame:
    """df with -2, -3 and so on after ids that come again, in order; an id that is then taken goes on counting.

    A suffixed id is only taken by a row that has it from the start, so candidates are
    numbered past those: one window and one grouped list of the numbers taken.
    """
    taken = df.select(F.regexp_extract(id_col, r"^(.*)-(\d+)$", 1).alias("stem"), F.regexp_extract(id_col, r"^(.*)-(\d+)$", 2).alias("n")).filter("n <> ''").groupBy("stem").agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("taken"))
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))
    joined = numbered.join(taken, F.col(id_col) == F.col("stem"), "left")
    none = F.array().cast("array<int>")
    # the (n-1)-th number from 2 on that isn't taken
    free = F.array_except(F.sequence(F.lit(2), F.col("__n") + 1 + F.size(F.coalesce("taken", none))), F.coalesce("taken", none))
    fresh = F.when(F.col("__n") == 1, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("-"), F.get(free, F.col("__n") - 2).cast("string")))
    return joined.withColumn(id_col, fresh).drop("__n", "stem", "taken")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: articles found, clause chunks, preamble, lines dropped, titles missing, a warning."""
    every = lines(docs, doc_id, text)
    t = _states(every.filter("kind <> 'furniture'"))
    made = chunks(docs, doc_id, "doc_title", text).groupBy("doc_id").agg(F.count("clause_id").alias("clauses_found"), F.bool_or("is_preamble").alias("preamble_captured"))
    per = t.groupBy("doc_id").agg(F.count_distinct("article_id").alias("articles_found"), F.count_if(F.col("in_header") | F.col("opens_clause")).alias("missing_titles"), F.count_if(F.col("article_id").isNull() & ~F.col("kind").isin("part", "chapter")).alias("headless"))
    dropped = every.groupBy("doc_id").agg(F.count_if(F.col("kind") == "furniture").alias("furniture"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    t = docs.select(F.col(doc_id).alias("doc_id")).join(per, "doc_id", "left").join(made, "doc_id", "left").join(dropped, "doc_id", "left")
    none = zero(F.col("articles_found")) == 0
    return t.select(
        "doc_id", zero(F.col("articles_found")).alias("articles_found"), zero(F.col("clauses_found")).alias("clauses_found"), F.coalesce("preamble_captured", F.lit(False)).alias("preamble_captured"),
        (zero(F.col("furniture")) + F.when(none, zero(F.col("headless"))).otherwise(F.lit(0))).alias("lines_dropped"), zero(F.col("missing_titles")).alias("missing_titles"), F.when(none, "No articles (Điều) found in document").alias("warning"),
    )


def passages_as_chunks(questions: DataFrame) -> DataFrame:
    """Fixture chunks from gold passages: an id by content, _2 and so on for equal ones; probes and empty ones go."""
    q = questions.filter(F.col("is_answerable") & (squeeze(F.col("gold_passage")) != ""))
    stem = F.concat(F.lit("T1_"), F.substring(F.sha2(squeeze(F.col("gold_passage")), 256), 1, 16))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("ordinal"))
    q = q.withColumn("stem", stem).withColumn("n", n)
    return q.select("ordinal", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise("")).alias("chunk_id"), F.get("gold_doc_ids", F.lit(0)).alias("doc_id"), F.col("gold_passage").alias("text"), F.col("id").alias("question_id"), F.lit("tier1_passages").alias("corpus_source"))


EDGES = r"^[ \t;:,()\-]+|[ \t;:,()\-]+$"


def cut(text: Column) -> Column:
    """The sentences of a text, squeezed and then cut at . ! ? so numbers with dots fall apart here; some may be empty."""
    stops = F.split(F.translate(squeeze(text), "!?\n\r", "...."), "\\.", -1)
    return F.transform(F.when(F.size(stops) == 1, stops).otherwise(F.filter(stops, lambda x, i: (x != "") | (i == 0) | (i == F.size(stops) - 1))), lambda x: F.regexp_replace(x, EDGES, ""))


def sentences(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, sentence, kind, tokens, facts) for each sentence; kind is abstention, content or fragment.

    Text is squeezed before it is cut at . ! ? so numbers with dots fall apart here, while
    quantities of a whole text see them whole.
    """
    t = df.select(*key, F.posexplode(cut(F.col(text))).alias("pos", "sentence")).filter("sentence <> ''")
    return content_kind(t, "sentence")


def parts(text: Column) -> Column:
    """sentences() of a text inside its row: an array of (sentence, tokens, facts, exact, soft, kind)."""
    return F.transform(F.filter(cut(text), lambda x: x != ""), lambda x: let(judged(x), lambda j: F.struct(x.alias("sentence"), *[j[f].alias(f) for f in ("tokens", "facts", "exact", "soft", "kind")])))


def prompt_blocks(prompt: Column) -> Column:
    """The passages that a stored prompt shows, in order; none for a prompt without markers."""
    mark = r"---\s*Tài\s+liệu\s+tham\s+khảo\s*\[\d+\]\s*---"
    found = F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(rf"(?isuU){mark}\s*(.*?)(?=\n\s*{mark}|\n---\s*\n|\z)"), F.lit(1))
    return F.filter(F.transform(found, squeeze), lambda x: x != "")


def resolve_contexts(given: Column, retrieved: Column, prompt: Column) -> Column:
    """(contexts, source): what the caller gives, else what was retrieved, else what the prompt shows."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), squeeze), lambda x: x != "")
    pair = lambda a, s: F.struct(a.alias("contexts"), F.lit(s).alias("source"))
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(given, none)) > 0, pair(clean(given), "caller_contexts")).when(F.size(clean(retrieved)) > 0, pair(clean(retrieved), "retrieved_results")).when(F.size(prompt_blocks(prompt)) > 0, pair(prompt_blocks(prompt), "prompt_recovered")).otherwise(pair(none, "none"))


