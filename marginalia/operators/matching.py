"""Passages against documents: coverage, fidelity, repair, and their reports.

Containment has no equality to join on. Passages are few (a benchmark), documents many, so
passages become windows of words, and a document's words are joined to them by hash of a
fixed-size shingle: an equality, broadcast up to a counted size; only pairs that share one
are then tested by contains(). A passage shorter than a shingle is tested by its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.legal import article_id, articles_in
from marginalia.functions.text import bigrams, fold, let, squash, squeeze, window_size, windows
from marginalia.operators.retrieval import broadcast_if_small

#: Shares of windows from which a passage counts as found, quotable, partial.
FRAGMENT, QUOTABLE, PARTIAL, REPAIR = 0.60, 0.70, 0.35, 0.30
MOST_WINDOWS, WINDOW = 24, 8


def containment(probes: Column, haystack: Column) -> Column:
    """The share of probes that occur; 0 without any; blank ones count, and never occur."""
    hits = F.size(F.filter(probes, lambda p: (p != "") & F.contains(haystack, p)))
    return F.when(F.size(probes) > 0, hits / F.size(probes).cast("double")).otherwise(0.0)


def shingle_hashes(text: Column, n: int = 3) -> Column:
    """Hashes of every n neighbouring words; of all words if there are fewer."""
    places = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
    return let(F.split(text, " "), lambda w: F.array_distinct(F.transform(places(w), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))))


def candidates(passages: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    """(passage_id, doc_id) that share n neighbouring words away from the passage's ends.

    Words at a passage's ends may be cut inside the document, so its inner shingles decide.
    A passage of fewer than n + 2 words has none: it is one window for all that follows, so
    only documents that hold it, if without diacritics, are its candidates. Such passages are
    a stated set that all documents are held against.
    """
    w = F.split("p", " ")
    p = passages.select("passage_id", squeeze(F.col("passage")).alias("p")).withColumn("inner", F.when(F.size(w) >= n + 2, F.array_join(F.slice(w, F.lit(2), F.size(w) - 2), " ")))
    long = p.filter("inner is not null").select("passage_id", F.explode(shingle_hashes(F.col("inner"), n)).alias("h"))
    d = docs.select("doc_id", F.explode(shingle_hashes(squeeze(F.col("text")), n)).alias("h"))
    found = d.join(broadcast_if_small(long, 1_000_000), "h").select("passage_id", "doc_id").distinct()
    short = p.filter("inner is null and p <> ''").select("passage_id", fold(F.col("p")).alias("f"))
    if short.isEmpty():
        return found
    held = docs.select("doc_id", fold(squeeze(F.col("text"))).alias("t")).join(broadcast_if_small(short), F.contains("t", F.col("f")))
    return found.unionByName(held.select("passage_id", "doc_id"))


def coverage_tiers(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, tier) for each question: strict, squash or loose, whichever comes first; not_found, probe or no_passage.

    A passage is covered by a chunk that holds it, or that it holds if the chunk has 30
    characters or more. Passages are few: their normal forms are broadcast up to a counted
    size, and each chunk is read once, for the three tiers together.
    """
    blank = F.trim(F.coalesce("gold_passage", F.lit(""))) == ""
    asked = questions.select("id", F.when(~F.col("is_answerable"), "probe").when(blank, "no_passage").alias("out"), "gold_passage")
    forms = lambda c: [squeeze(c).alias("strict"), squash(c).alias("squash"), fold(squeeze(c)).alias("loose")]
    p = asked.filter("out is null").select("id", *[x.alias(f"p{i}") for i, x in enumerate(forms(F.col("gold_passage")))])
    c = chunks.select(*[x.alias(f"c{i}") for i, x in enumerate(forms(F.col("text")))])
    holds = lambda i: (F.col(f"c{i}") != "") & (F.contains(f"c{i}", F.col(f"p{i}")) | ((F.length(f"c{i}") >= 30) & F.contains(f"p{i}", F.col(f"c{i}"))))
    tier = F.when(holds(0), 0).when(holds(1), 1).when(holds(2), 2)
    best = c.join(broadcast_if_small(p), holds(0) | holds(1) | holds(2)).groupBy("id").agg(F.min(tier).alias("tier"))
    names = F.array(F.lit("strict"), F.lit("squash"), F.lit("loose"))
    return asked.join(best, "id", "left").select("id", F.coalesce("out", F.get(names, F.col("tier")), F.lit("not_found")).alias("tier"))


def coverage_report(tiers: DataFrame) -> DataFrame:
    """One row: counts of the tiers, and percentages of the questions that ought to be covered."""
    n = lambda *t: F.count_if(F.col("tier").isin(*t))
    asked = n("strict", "squash", "loose", "not_found")
    pct = lambda x: F.coalesce(F.round(F.try_divide(x * F.lit(100.0), asked), 2), F.lit(0.0))
    return tiers.agg(
        F.count("*").alias("total_questions"), asked.alias("answerable_questions"), n("probe").alias("unanswerable_probes_excluded"), n("no_passage").alias("answerable_without_passage"), n("strict").alias("strict_matches"),
        n("squash").alias("squash_matches"), n("loose").alias("loose_matches"), n("not_found").alias("not_found"), pct(n("strict")).alias("strict_coverage_pct"), pct(n("squash")).alias("squash_coverage_pct"),
        pct(n("loose")).alias("loose_coverage_pct"), pct(n("strict", "squash", "loose")).alias("total_coverage_pct"),
    )


def match_passages(passages: DataFrame, docs: DataFrame, ordinal: str = "doc_id") -> DataFrame:
    """(passage_id, doc_id, tier, ratio): each passage's best document.

    The first document that holds it whole; else the one with most of its windows, the
    first of equals; else, below FRAGMENT, the first with more of them without diacritics.
    """
    p = passages.select("passage_id", squeeze(F.col("passage")).alias("p")).withColumn("probes", windows(F.col("p"), WINDOW, MOST_WINDOWS))
    d = docs.select("doc_id", F.col(ordinal).alias("ord"), squeeze(F.col("text")).alias("t"))
    pairs = candidates(passages, docs)
    folded_pairs = candidates(p.select("passage_id", fold(F.col("p")).alias("passage")), d.select("doc_id", fold(F.col("t")).alias("text")))
    every = pairs.unionByName(folded_pairs).distinct().join(broadcast_if_small(p), "passage_id").join(d, "doc_id")
    scored = every.select(
        "passage_id", "doc_id", "ord", (F.contains("t", F.col("p")) & (F.col("p") != "")).alias("whole"), containment(F.col("probes"), F.col("t")).alias("ratio"),
        containment(F.transform("probes", fold), fold(F.col("t"))).alias("folded"),
    )
    first = lambda cond: F.min(F.when(cond, F.struct("ord", "doc_id")))
    best = scored.groupBy("passage_id").agg(
        first(F.col("whole")).alias("strict"), F.max(F.when(F.col("ratio") > 0, F.struct(F.col("ratio"), (-F.col("ord")).alias("back"), F.col("doc_id")))).alias("most"),
        F.array_sort(F.collect_list(F.when(F.col("folded") >= FRAGMENT, F.struct("ord", "doc_id", "folded")))).alias("damaged"),
    )
    ratio = F.coalesce("most.ratio", F.lit(0.0))
    loose = F.get(F.filter("damaged", lambda x: x["folded"] > ratio), F.lit(0))
    out = lambda doc, tier, r: F.struct(doc.alias("doc_id"), F.lit(tier).alias("tier"), r.alias("ratio"))
    none = F.lit(None).cast("long")
    verdict = F.when(F.col("strict").isNotNull(), out(F.col("strict.doc_id"), "strict", F.lit(1.0))).when(ratio >= FRAGMENT, out(F.col("most.doc_id"), "fragment", ratio))
    verdict = verdict.when(loose.isNotNull(), out(loose["doc_id"], "folded-only", loose["folded"])).when(ratio > 0, out(F.col("most.doc_id"), "fragment", ratio)).otherwise(out(none, "none", F.lit(0.0)))
    verdicts = best.select("passage_id", verdict.alias("v"))
    return p.select("passage_id").join(verdicts, "passage_id", "left").select("passage_id", F.col("v.doc_id").alias("doc_id"), F.coalesce("v.tier", F.lit("none")).alias("tier"), F.round(F.coalesce("v.ratio", F.lit(0.0)), 6).alias("ratio"))


def audit(passages: DataFrame, docs: DataFrame, ordinal: str = "doc_id") -> DataFrame:
    """(passage_id, window, doc_id, ratio, fidelity, article_present): how true to a document each passage is."""
    p = passages.select("passage_id", squeeze(F.col("passage")).alias("p")).filter("p <> ''")
    p = p.withColumn("window", window_size(F.size(F.split("p", " "))))
    probes = F.when(F.col("window") == 3, windows(F.col("p"), 3, MOST_WINDOWS)).when(F.col("window") == 4, windows(F.col("p"), 4, MOST_WINDOWS)).when(F.col("window") == 6, windows(F.col("p"), 6, MOST_WINDOWS)).otherwise(windows(F.col("p"), 8, MOST_WINDOWS))
    p = p.withColumn("probes", probes).withColumn("claimed", article_id(F.col("p")))
    d = docs.select("doc_id", F.col(ordinal).alias("ord"), squeeze(F.col("text")).alias("t"))
    every = candidates(p.select("passage_id", F.col("p").alias("passage")), docs, 2).join(broadcast_if_small(p), "passage_id").join(d, "doc_id")
    scored = every.select("passage_id", "doc_id", "ord", F.contains("t", F.col("p")).alias("whole"), containment(F.col("probes"), F.col("t")).alias("ratio"), F.coalesce(F.array_contains(articles_in(F.col("t")), F.col("claimed")), F.lit(False)).alias("has_article"))
    best = scored.groupBy("passage_id").agg(F.max(F.struct(F.col("whole"), F.col("ratio"), (-F.col("ord")).alias("back"), F.col("doc_id"), F.col("has_article"))).alias("b"))
    ratio = F.coalesce(F.when(F.col("b.whole"), 1.0).otherwise(F.col("b.ratio")), F.lit(0.0))
    fidelity = F.when(F.col("b.whole"), "verbatim").when(ratio >= QUOTABLE, "quotable").when(ratio >= PARTIAL, "partial").otherwise("paraphrase-or-missing")
    return p.join(best, "passage_id", "left").select("passage_id", F.col("window").cast("long").alias("window"), F.when(ratio > 0, F.col("b.doc_id")).alias("doc_id"), F.round(ratio, 3).alias("ratio"), fidelity.alias("fidelity"), F.when(F.col("claimed").isNotNull() & (ratio > 0), F.col("b.has_article")).alias("article_present"))


def overlap(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(passage_id, doc_id, overlap): the share of a passage's word pairs that a document has, for pairs that share one."""
    own = passages.select("passage_id", bigrams(F.col("passage")).alias("g")).filter(F.size("g") > 0)
    p = own.select("passage_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    d = docs.select("doc_id", F.explode(bigrams(F.col("text"))).alias("gram"))
    return d.join(broadcast_if_small(p, 1_000_000), "gram").groupBy("passage_id", "doc_id", "n").agg(F.count("*").alias("hits")).select("passage_id", "doc_id", F.round(F.col("hits") / F.col("n"), 4).alias("overlap"))


def repair_tokens(text: Column) -> Column:
    """Distinct folded words of two letters or digits and more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(fold(F.coalesce(text, F.lit("")))), F.lit("[0-9a-zA-ZÀ-ỹ]{2,}"), F.lit(0)))


def token_recall(summary: Column, article: Column) -> Column:
    s, a = repair_tokens(summary), repair_tokens(article)
    return F.when(F.size(s) > 0, F.size(F.array_intersect(s, a)) / F.size(s).cast("double")).otherwise(0.0)


def article_texts(chunks: DataFrame) -> DataFrame:
    """(doc_id, article_id, text): an article's chunks in order."""
    return chunks.groupBy("doc_id", "article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"))


def repair(questions: DataFrame, chunks: DataFrame, least: float = REPAIR) -> DataFrame:
    """(id, action, doc_id, passage): gold passages replaced by their article's text, where it is the one meant.

    Of the instruments a question cites, in order, the first whose article shares enough
    words. A passage that is its article's text already stays, so a second run changes nothing.
    """
    asked = questions.filter("is_answerable").select("id", "gold_passage", article_id(F.col("gold_passage")).alias("article_id"), F.posexplode(F.filter("gold_doc_ids", lambda d: ~F.startswith(d, F.lit("UNRESOLVED")))).alias("pos", "doc_id"))
    joined = asked.join(article_texts(chunks), ["doc_id", "article_id"], "left").withColumn("recall", F.coalesce(token_recall(F.col("gold_passage"), F.col("text")), F.lit(0.0)))
    per = joined.groupBy("id").agg(F.first("gold_passage").alias("old"), F.min(F.when(F.col("text") == F.col("gold_passage"), F.struct("pos", "doc_id", "text"))).alias("same"), F.min(F.when(F.col("text").isNotNull() & (F.col("recall") >= least), F.struct("pos", "doc_id", "text"))).alias("hit"), F.max(F.col("text").isNotNull()).alias("located"))
    action = F.when(F.col("same").isNotNull(), "already").when(F.col("hit").isNotNull(), "repaired").when(~F.col("located"), "no_article").otherwise("refused")
    return per.select("id", action.alias("action"), F.coalesce("same.doc_id", "hit.doc_id").alias("doc_id"), F.coalesce("same.text", "hit.text", "old").alias("passage"))


def yield_by_document(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """By document: passages it is the best match of, also where there are none."""
    hits = matches.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("passages"), F.count_if(F.col("tier") == "strict").alias("verbatim"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", zero("passages"), zero("verbatim"))


def corrections(rows: DataFrame, patches: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(patched rows, refused patches): a patch (key, expected, value) applies where the cell is as expected or has the value already.

    All or nothing: with any patch refused, rows come back as they are.
    """
    joined = rows.join(patches.select(F.col("key").alias(key), "expected", "value"), key, "left")
    ok = F.col("value").isNull() | (F.col(column) == F.col("expected")) | (F.col(column) == F.col("value"))
    missing = patches.join(rows.select(F.col(key).alias("key")), "key", "left_anti").select("key")
    refused = joined.filter(~ok).select(F.col(key).alias("key")).unionByName(missing)
    if refused.limit(1).count():
        return rows, refused
    return joined.select(*[F.coalesce("value", column).alias(column) if c == column else F.col(c) for c in rows.columns]), refused


def manifest_updates(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """(url, doc_id, change): facts (fragment, doc_id) about manifest (url, doc_id): fill, same, conflict; or add what no address holds.

    Facts are kept by hand.
    """
    hit = manifest.join(broadcast_if_small(facts.select("fragment", F.col("doc_id").alias("fact"))), F.contains("url", F.col("fragment")))
    known_ = F.coalesce("doc_id", F.lit(""))
    change = F.when(known_ == "", "fill").when(known_ == F.col("fact"), "same").otherwise("conflict")
    new = facts.join(manifest.select("url"), F.contains("url", F.col("fragment")), "left_anti").select(F.col("fragment").alias("url"), "doc_id", F.lit("add").alias("change"))
    return hit.select("url", F.when(change == "conflict", F.col("doc_id")).otherwise(F.col("fact")).alias("doc_id"), change.alias("change")).unionByName(new)


def identify_instruments(docs: DataFrame, chars: int = 6000) -> DataFrame:
    """(doc_id, instrument): the instrument a text's opening names most, the first of equals; null without a word for its kind.

    An instrument names itself at its head: chars is the rule's own limit, as later pages cite others.
    """
    head = F.substring("text", 1, chars)
    ids = F.regexp_extract_all(head, F.lit(r"(?U)\b\d{1,3}\s*/\s*\d{4}\s*/\s*[A-ZĐ]{1,12}(?:-[A-ZĐ0-9]{1,12}){0,2}"), F.lit(0))
    kind = head.rlike(r"(?iuU)\b(?:thông\s*tư|nghị\s*định|quyết\s*định|luật|công\s*văn|pháp\s*lệnh)\b")
    t = docs.select("doc_id", kind.alias("kind"), F.posexplode(F.transform(ids, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "^0+(?=\\d)", ""))).alias("pos", "instrument"))
    ranked = t.groupBy("doc_id", "kind", "instrument").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    best = ranked.groupBy("doc_id", "kind").agg(F.max_by("instrument", F.struct("n", (-F.col("pos")).alias("b"))).alias("instrument")).filter("kind").select("doc_id", "instrument")
    return docs.select("doc_id").join(best, "doc_id", "left")


def layer_class(text: Column, ratio: Column) -> Column:
    """What a page's text layer is: none, corrupt or clean."""
    return F.when(F.length(F.trim(text)) < 50, "no-layer").when(ratio < 0.05, "corrupt").otherwise("clean")


