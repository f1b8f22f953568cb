"""Gold questions: ids, instruments behind addresses, answerability, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.legal import SENTINEL, gold_citation, padded
from marginalia.functions.text import answer_cell, squeeze, urls
from marginalia.provenance import require

UNRESOLVED = "UNRESOLVED"
#: Addresses that spell an instrument's number and year, and the id that they stand for.
SLUGS = [
    (r"(?i)thong-tu-(?:so-)?(\d+)-(\d{4})-tt-nhnn", "TT-NHNN"),
    (r"(?i)nghi-dinh-(?:so-)?(\d+)-(\d{4})-nd-cp", "NĐ-CP"),
    (r"(?i)-so-(\d+)-(\d{4})-qh15", "QH15"),
]
LETTER = r"(?i)Cong-van-(\d+)-([A-Za-z-]+?)-(\d{4})"
DATA_FILE = r"(?i)/vbpq/(\d{4})/(\d{1,2})/([^/?#]+)\.pdf"


def row_id(raw: Column, ordinal: Column) -> Column:
    """Q and three digits for a number, a text as it is, the row's number for a blank."""
    r = F.trim(F.coalesce(raw, F.lit("")))
    three = lambda n: F.concat(F.lit("Q"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))
    return F.when(r.rlike(r"^\d+$"), three(F.coalesce(F.nullif(F.ltrim(r, F.lit("0")), F.lit("")), F.lit("0")))).when(r != "", r).otherwise(three(ordinal.cast("string")))


def canonical_doc(url: Column, manifest: dict[str, str] | None = None) -> Column:
    """(doc_id, confidence) for an address.

    The manifest (ordered, as large as people keep by hand) is asked first: its first key
    that equals, holds or is held by the address. Then what the address spells. What can't
    be resolved says so, and never guesses.
    """
    u = F.trim(F.coalesce(url, F.lit("")))
    part = lambda p, i: F.regexp_extract(u, p, i)
    result = lambda doc, how: F.struct(doc.alias("doc_id"), F.lit(how).alias("confidence"))
    out = F.when(u == "", result(F.lit(f"{UNRESOLVED}:empty"), "unresolved"))
    if manifest:
        entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v or "").alias("doc")) for k, v in manifest.items() if k])
        hit = F.get(F.filter(entries, lambda e: F.contains(u, e["key"]) | F.contains(e["key"], u)), F.lit(0))
        out = out.when(hit.isNotNull() & (hit["doc"] != ""), result(hit["doc"], "manifest")).when(hit.isNotNull(), result(F.lit(f"{UNRESOLVED}:manifest-pending"), "unresolved"))
    out = out.when(u.rlike(LETTER), result(F.concat_ws("/", part(LETTER, 1), part(LETTER, 3), F.upper(part(LETTER, 2))), "slug"))
    for pattern, agency in SLUGS:
        out = out.when(u.rlike(pattern), result(F.concat_ws("/", padded(part(pattern, 1)), part(pattern, 2), F.lit(agency)), "slug"))
    out = out.when(u.rlike(DATA_FILE) & part(DATA_FILE, 3).rlike(r"\d"), result(F.concat(F.lit(f"{UNRESOLVED}:datafiles:"), part(DATA_FILE, 1), F.lit("/"), part(DATA_FILE, 3)), "unresolved"))
    return out.otherwise(result(F.concat(F.lit(f"{UNRESOLVED}:"), F.substring(F.sha1(u), 1, 8)), "unresolved"))


def named_doc(passage: Column, docs: Column) -> Column:
    """The first candidate that the passage names, by its id or by number and year; null if none."""
    p = squeeze(passage)
    core = lambda d: F.concat(F.element_at(F.split(d, "/"), 1), F.lit("/"), F.get(F.split(d, "/"), F.lit(1)))
    named = F.filter(docs, lambda d: (d != "") & ~F.startswith(d, F.lit(UNRESOLVED)) & (F.contains(p, squeeze(d)) | F.coalesce(F.contains(p, core(d)), F.lit(False))))
    return F.when(p != "", F.get(named, F.lit(0)))


def docs_resolved(docs: Column) -> Column:
    return (F.size(docs) > 0) & ~F.exists(docs, lambda d: F.startswith(d, F.lit(UNRESOLVED)))


def is_sentinel(answer: Column) -> Column:
    return answer_cell(answer) == answer_cell(F.lit(SENTINEL))


def probe(links: Column, passage: Column, answer: Column) -> Column:
    """(is_probe, anomaly): a probe has no address, no passage, and the agreed answer; two of them are an anomaly."""
    gold = (F.size(links) > 0) | (F.trim(F.coalesce(passage, F.lit(""))) != "")
    said = is_sentinel(answer)
    return F.struct((~gold & said).alias("is_probe"), F.when(said & gold, "sentinel-answer-with-gold").when(~gold & ~said, "no-gold-without-sentinel").alias("anomaly"))


def _evidence() -> Column:
    return (F.trim(F.coalesce("gold_passage", F.lit(""))) != "") | (F.size("gold_doc_ids") > 0) | (F.size("gold_citations") > 0) | (F.size("source_urls") > 0)


def _said_sentinel() -> Column:
    strip = lambda c: F.rtrim(squeeze(c), F.lit("."))
    return strip(F.col("reference_answer")) == SENTINEL


def answerability() -> Column:
    """(answerable, basis, anomaly) of a loaded question, for the benchmark."""
    ok = lambda a, b, c="": F.struct(F.lit(a).alias("answerable"), F.lit(b).alias("basis"), F.lit(c).alias("anomaly"))
    ev, said = _evidence(), _said_sentinel()
    return (
        F.when(~F.col("is_answerable"), ok(False, "loader_flag"))
        .when((F.col("category") == "unanswerable") & ev, ok(False, "loader_category", "category_unanswerable_with_gold"))
        .when(F.col("category") == "unanswerable", ok(False, "loader_category"))
        .when(said & ~ev, ok(False, "sentinel_no_gold"))
        .when(said, ok(True, "sentinel_with_gold", "sentinel_answer_but_has_gold"))
        .when(~ev, ok(True, "no_evidence", "answerable_without_any_gold_evidence"))
        .otherwise(ok(True, "gold_present"))
    )


def scorer_answerability() -> Column:
    """The same for the scorer, which also names what a gold row lacks."""
    ok = lambda a, b, c="": F.struct(F.lit(a).alias("answerable"), F.lit(b).alias("basis"), F.lit(c).alias("anomaly"))
    ev, said = _evidence(), _said_sentinel()
    other = F.lower(F.coalesce("category", F.lit(""))) == "unanswerable"
    return (
        F.when(~F.col("is_answerable"), ok(False, "gold_flag"))
        .when(other & ev, ok(False, "category", "category_unanswerable_with_gold"))
        .when(other, ok(False, "category"))
        .when(said & ~ev, ok(False, "sentinel_answer"))
        .when(said, ok(True, "gold_flag", "sentinel_answer_with_gold"))
        .when(~ev, ok(True, "gold_flag", "answerable_without_any_gold_evidence"))
        .when(squeeze(F.col("reference_answer")) == "", ok(True, "gold_flag", "answerable_without_gold_answer"))
        .when(squeeze(F.col("gold_passage")) == "", ok(True, "gold_flag", "answerable_without_gold_passage"))
        .otherwise(ok(True, "gold_flag"))
    )


def questions_from_rows(rows: DataFrame, manifest: dict[str, str] | None = None) -> DataFrame:
    """Gold questions from rows (ordinal, ID, question, answer, text_contains_answer_in_the_doc, doc_link, author).

    Rows without a question go; all others stay, with what can't be resolved named.
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    t = rows.filter(clean(F.col("question")) != "").select(
        "ordinal", row_id(F.col("ID"), F.col("ordinal")).alias("id"), clean(F.col("question")).alias("question"), clean(F.col("answer")).alias("reference_answer"),
        clean(F.col("text_contains_answer_in_the_doc")).alias("passage"), urls(F.col("doc_link")).alias("urls"), clean(F.col("author")).alias("author"),
    )
    t = t.withColumn("probe", probe(F.col("urls"), F.col("passage"), F.col("reference_answer")))
    t = t.withColumn("resolved", F.transform("urls", lambda u: canonical_doc(u, manifest)))
    t = t.withColumn("docs", F.array_distinct(F.transform("resolved", lambda r: r["doc_id"])))
    t = t.withColumn("named", named_doc(F.col("passage"), F.col("docs")))
    t = t.withColumn("docs", F.when(F.col("named").isNotNull(), F.concat(F.array("named"), F.array_remove("docs", F.col("named")))).otherwise(F.col("docs")))
    primary = F.coalesce(F.get("docs", F.lit(0)), F.lit(f"{UNRESOLVED}:empty"))
    t = t.withColumn("cited", gold_citation(F.col("passage"), primary))
    asks = ~F.col("probe.is_probe")
    none = F.array().cast("array<string>")
    confidence = F.when(F.col("named").isNotNull(), "passage-named").when(F.size("docs") > 1, "ambiguous-multi-url").otherwise(F.coalesce(F.get("resolved", F.lit(0))["confidence"], F.lit("unresolved")))
    return t.select(
        "ordinal", "id", "question", asks.alias("is_answerable"), F.when(asks, F.col("docs")).otherwise(none).alias("gold_doc_ids"),
        F.when(asks, F.array_compact(F.array("cited"))).otherwise(F.array_compact(F.array(F.lit(None).cast(t.schema["cited"].dataType)))).alias("gold_citations"),
        "reference_answer", F.when(asks, "factual").otherwise("unanswerable").alias("category"), F.when(asks, F.col("passage")).otherwise("").alias("gold_passage"),
        F.when(asks, F.col("urls")).otherwise(none).alias("source_urls"), F.when(asks, confidence).otherwise("n/a-unanswerable").alias("doc_id_confidence"), "author",
    )


def coverage(questions: DataFrame) -> DataFrame:
    """One row: what the questions can and can't support; probes count apart."""
    asks = F.col("is_answerable")
    resolved = asks & docs_resolved(F.col("gold_doc_ids"))
    first = F.get("gold_citations", F.lit(0))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    empty = asks & (F.coalesce("gold_passage", F.lit("")) == "")
    return questions.agg(
        F.count("*").alias("questions"), count(asks).alias("answerable_questions"), count(~asks).alias("unanswerable_probes"), ids(~asks).alias("unanswerable_probe_ids"),
        count(resolved).alias("doc_ids_resolved"), count(asks & ~resolved).alias("doc_ids_unresolved"), count(asks & first["article_id"].isNotNull()).alias("with_article_gold"),
        count(asks & first["clause_id"].isNotNull()).alias("with_clause_gold"), count(empty).alias("empty_passage"), ids(empty).alias("empty_passage_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(resolved, F.col("gold_doc_ids")))))).alias("distinct_doc_ids"),
    )


def unstable_ids(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Probes whose id comes from the row's number, as their ID cell is blank."""
    blank = rows.filter(F.trim(F.coalesce("ID", F.lit(""))) == "").select("ordinal")
    return questions.filter(~F.col("is_answerable")).join(blank, "ordinal", "left_semi").select("id")


def loader_gate(rows: DataFrame, manifest: dict[str, str] | None = None, allow_unresolved: bool = False) -> DataFrame:
    """One row (unresolved, contradictory, empty_passages, blocking) of a gold CSV's rows; raises if any blocks, unless allowed.

    Unresolved instruments and empty passages count on answerable rows only; contradictory rows
    are those whose marks of a probe disagree.
    """
    asked = rows.filter(F.trim(F.coalesce("question", F.lit(""))) != "")
    marks = asked.agg(F.count_if(probe(urls(F.col("doc_link")), F.col("text_contains_answer_in_the_doc"), F.col("answer"))["anomaly"].isNotNull()).alias("contradictory"))
    held = coverage(questions_from_rows(rows, manifest)).select(F.col("doc_ids_unresolved").alias("unresolved"), F.col("empty_passage").alias("empty_passages"))
    # two frames of one row each
    report = held.join(marks).select("unresolved", "contradictory", "empty_passages", ((F.col("unresolved") > 0) | (F.col("contradictory") > 0) | (F.col("empty_passages") > 0)).alias("blocking"))
    if not allow_unresolved:
        r = report.first()
        require(not r["blocking"], f"{r['unresolved']} unresolved instruments, {r['contradictory']} contradictory rows, {r['empty_passages']} answerable rows without a passage")
    return report
