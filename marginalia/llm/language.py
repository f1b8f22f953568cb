"""Language ID by Bayesian evidence fusion.

Four sources of evidence give one posterior over the languages of a model and
"und" (none of them):

* text: naive Bayes over hashed byte trigrams, tempered as trigrams overlap. "und"
  gives each trigram the same probability, so text unlike any language has it win.
* the declared language (a markup's lang attribute, or metadata), by how often each
  declaration goes with each language of the texts.
* the address's suffix, and the host: smoothed hierarchically, a host's prior by its
  suffix's, a suffix's by the whole corpus's.

The last two come from one grouped aggregation of the text posteriors over all rows
by (host, suffix, declared): sums are partial before the shuffle, so a host with a
third of all rows costs one row for each task. Prior tables are broadcast up to a
counted size, else joined by shuffle.

The trigram model is fitted on a bounded sample of labelled rows: about SAMPLE for
each declared language with at least LEAST rows, chosen by a hash of the id and text.
Declarations count by their primary subtag (en for en-GB); what isn't two or three letters,
and und, mul, zxx and mis, declare nothing.

A text's language is the likeliest of the model's if these have SURE of the posterior
together, else "und", and then the text is rejected. A text in two of the languages is
not: it has one of them. A text that is none of them, but is declared to be in a language
with too few rows to be modelled, has that language, and isn't rejected. Of languages that
are equally likely the first by name wins. Null and empty
texts have no text evidence: they are "und". Null declarations and hosts are no
evidence. Texts are scored whole; repeated rows each give a row; an empty table gives
an empty result; extra columns are kept, but for those with an output's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import arrow_map, slices, small_enough, written

#: Bits of a trigram's hash; labelled rows for each language, about; fewest for a language to be modelled.
BITS, SAMPLE, LEAST = 16, 500, 20
#: Share of a trigram's log likelihood that counts; pseudo-counts of the priors; weight of the priors.
TEMPER, HOST_MASS, SUFFIX_MASS, DECLARED_MASS, SURE = 1 / 3, 50.0, 50.0, 5.0, 0.5
UND = "und"
#: Common words of a few languages, so that a model never starts from nothing.
SEEDS = {
    "de": "der die das und ist nicht ein eine einen mit von zu den dem des sich auf für im auch als an es werden aus hat dass sie nach wird bei noch wie über so zum kann nur wenn ihr seine oder aber vor zur bis mehr durch man sind war haben keine schon wir ich ung lich keit heit schaft",
    "en": "the of and to in is that it for was with as on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about into than them can only other time new some could these may then do first any my now such like our over the ing tion ness able",
    "es": "el la los las de que y en un una ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este ir otro ese si me ya ver porque dar cuando él muy sin vez mucho saber qué sobre mi alguno mismo yo también hasta año dos querer entre así primero desde grande eso ni nos llegar ción mente ado idad",
    "fr": "le la les de un une des et est que qui dans pour pas sur au avec ce il elle en ne se du plus par je son ses mais comme ou si leur y dont ils nous vous tout aux être avoir fait cette même sans peut entre aussi après bien où deux ainsi leurs ces été sont très sous donc était encore tion ment eux eau oir",
}


@dataclass(frozen=True)
class Model:
    """Languages (the last is und) and log probabilities: a row for each trigram's hash, a column for each language."""

    languages: tuple[str, ...]
    logs: np.ndarray


def hashed(data: np.ndarray) -> np.ndarray:
    """The hash of the trigram that begins at each byte but the last two."""
    d = data.astype(np.uint32)
    return (((d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def prepared(text: str) -> bytes:
    """Lower case, in UTF-8, with a space at both ends."""
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def lettered(data: np.ndarray) -> np.ndarray:
    """Which trigrams hold a letter and no digit: numbers, marks and codes say nothing."""
    letter, digit = ((data >= 97) & (data <= 122)) | (data >= 128), (data >= 48) & (data <= 57)
    return (letter[:-2] | letter[1:-1] | letter[2:]) & ~(digit[:-2] | digit[1:-1] | digit[2:])


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (language, text)."""
    rows = [*SEEDS.items(), *rows]
    languages = sorted({lang for lang, _ in rows})
    size = 1 << BITS
    counts = np.zeros((size, len(languages)))
    for lang, text in rows:
        data = np.frombuffer(prepared(text), np.uint8)
        keys = hashed(data)
        counts[:, languages.index(lang)] += np.bincount(keys[lettered(data)], minlength=size)
    # the floor is under the flat probability of und, so that unseen trigrams speak for und
    logs = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * size))
    return Model((*languages, UND), np.concatenate([logs, np.full((size, 1), -np.log(size))], axis=1).astype(np.float32))


def log_likelihoods(texts: list[str], model: Model) -> np.ndarray:
    """A row for each text, a column for each language: tempered log likelihoods; zeros where there are no letters."""
    out = np.zeros((len(texts), len(model.languages)))
    for a, b in slices(texts, 500_000):
        encoded = [prepared(t) for t in texts[a:b]]
        data = np.frombuffer(b"".join(encoded) + b"  ", np.uint8)
        keys = hashed(data)
        good = lettered(data)
        ends = np.cumsum([len(e) for e in encoded])
        first = np.concatenate([[0], ends[:-1]])
        # no trigram reaches into the next text
        good[ends - 1] = good[ends - 2] = False
        for k in range(len(model.languages)):
            out[a:b, k] = np.add.reduceat(np.where(good, model.logs[:, k][keys], 0), first) * TEMPER
    return out


def normalised(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def subtag(declared: Column) -> Column:
    """A declaration's primary language subtag in lower case; null if it names no language."""
    first = F.regexp_extract(F.lower(declared), r"^\s*([a-z]{2,3})(?:[-_].*|\s*)$", 1)
    return F.when(~first.isin("", "und", "mul", "zxx", "mis"), first)


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (id, text, declared): counts by language, then a sample by the id's hash."""
    labelled = rows.withColumn("declared", subtag(F.col("declared"))).filter("declared is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("declared").count().filter(F.col("count") >= LEAST).collect()}
    if not counts:
        return fit([])
    rate = F.coalesce(*[F.when(F.col("declared") == lang, min(1.0, sample / n)) for lang, n in sorted(counts.items())])
    chosen = labelled.filter(F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1_000_000)) < rate * 1_000_000)
    return fit(sorted((r[0], r[1] or "") for r in chosen.select("declared", "text").collect()))


def scored(rows: DataFrame, model: Model, drop_text: bool) -> DataFrame:
    """rows with __scores (array of float: log likelihoods)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "text" or not drop_text]
    own = rows.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("__text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("__scores", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            found = log_likelihoods(texts, shared.value)
            flat = pa.array((found - found.max(1, keepdims=True)).astype(np.float32).ravel() if len(texts) else [], pa.float32())
            offsets = pa.array(np.arange(len(texts) + 1) * found.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.ListArray.from_arrays(offsets, flat)], names=[*names, "__scores"])

    return arrow_map(own, run, schema)


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def priors(rows: DataFrame, model: Model) -> tuple[DataFrame, list[float], dict[str, list[float]]]:
    """Of scored rows (host, suffix, declared, __scores): logs of priors by (host, suffix), of the corpus, and of the declarations' likelihoods."""
    n = len(model.languages)
    p = rows.select("host", "suffix", "declared", softmax(F.transform("__scores", lambda x: x.cast("double"))).alias("p"))
    sums = [F.sum(F.get("p", F.lit(k))).alias(f"s{k}") for k in range(n)]
    grouped = written(p.groupBy("host", "suffix", "declared").agg(*sums), "priors")
    add = [F.sum(f"s{k}").alias(f"s{k}") for k in range(n)]
    whole = grouped.agg(*add).first()
    corpus = np.array([whole[k] or 0.0 for k in range(n)])
    base = (corpus + 1) / (corpus.sum() + n)
    declared = {}
    languages = list(model.languages)
    for r in grouped.filter(F.col("declared").isin(languages)).groupBy("declared").agg(*add).collect():
        declared[r[0]] = np.array([r[k + 1] for k in range(n)])
    # how often texts of each language are declared so; a declaration speaks for its own language beforehand
    likely = {d: [float(np.log((declared[d][k] + DECLARED_MASS * ((d == languages[k]) * 0.9 + 0.1 / n)) / (corpus[k] + DECLARED_MASS))) for k in range(n)] for d in declared}
    base_col = F.array(*[F.lit(float(x)) for x in base])
    by_suffix = grouped.groupBy("suffix").agg(*[F.sum(f"s{k}").alias(f"t{k}") for k in range(n)])
    by_host = grouped.groupBy("host", "suffix").agg(*add)
    total = lambda letter: sum((F.col(f"{letter}{k}") for k in range(n)), F.lit(0.0))
    smooth = by_suffix.select("suffix", F.array(*[F.when(F.col("suffix").isNull(), base_col[k]).otherwise((F.col(f"t{k}") + SUFFIX_MASS * base_col[k]) / (total("t") + SUFFIX_MASS)) for k in range(n)]).alias("q"))
    joined = by_host.join(smooth.withColumnRenamed("suffix", "suffix_"), F.col("suffix").eqNullSafe(F.col("suffix_")))
    prior = F.array(*[F.when(F.col("host").isNull(), F.col("q")[k]).otherwise((F.col(f"s{k}") + HOST_MASS * F.col("q")[k]) / (total("s") + HOST_MASS)) for k in range(n)])
    table = joined.select(F.col("host").alias("host_"), F.col("suffix").alias("suffix__"), F.transform(prior, lambda x: F.log(x)).alias("prior"))
    return table, [float(x) for x in np.log(base)], likely


def identify(rows: DataFrame, keep_text: bool = False, model: Model | None = None) -> DataFrame:
    """rows (id, text, declared, host, suffix and others) with language, posterior, text_language, rejected; text goes unless kept."""
    rows = rows.withColumn("text", F.col("text").cast("string")).withColumn("declared", subtag(F.col("declared")))
    model = model or train(rows.select("id", "text", "declared"))
    light = scored(rows.select("host", "suffix", "declared", "text"), model, drop_text=True)
    if not keep_text:
        rows = written(scored(rows, model, drop_text=True), "scores")
        light = rows
    table, base, likely = priors(light, model)
    table = written(table.select(F.col("host_").alias("__host"), F.col("suffix__").alias("__suffix"), F.col("prior").alias("__prior")), "hosts")
    full = scored(rows, model, drop_text=False) if keep_text else rows
    side = F.broadcast(table) if small_enough(table) else table
    joined = full.join(side, F.col("host").eqNullSafe(F.col("__host")) & F.col("suffix").eqNullSafe(F.col("__suffix")), "left")
    n = len(model.languages)
    none = F.array(*[F.lit(0.0)] * n)
    said = F.coalesce(*[F.when(F.col("declared") == d, F.array(*[F.lit(x) for x in logs])) for d, logs in sorted(likely.items())], none)
    prior = F.coalesce("__prior", F.array(*[F.lit(x) for x in base]))
    logs = F.transform(F.arrays_zip(F.col("__scores").alias("a"), prior.alias("b"), said.alias("c")), lambda x: x["a"].cast("double") + x["b"] + x["c"])
    names = F.array(*[F.lit(x) for x in model.languages])
    empty = ~F.exists("__scores", lambda x: x != 0)
    found = joined.withColumn("__post", softmax(logs)).withColumn("__known", F.slice("__post", 1, n - 1))
    told = ~empty & (F.aggregate("__known", F.lit(0.0), lambda a, x: a + x) >= SURE)
    rare = ~empty & F.col("declared").isNotNull() & ~F.array_contains(names, F.col("declared"))
    best = F.element_at(names, F.array_position(F.col("__known"), F.array_max("__known")).cast("int"))
    text_best = F.element_at(names, F.array_position(F.col("__scores"), F.array_max("__scores")).cast("int"))
    language = F.when(told, best).when(rare, F.col("declared")).otherwise(UND)
    found = found.withColumn("language", language).withColumn("text_language", F.when(empty, F.lit(UND)).otherwise(text_best))
    found = found.withColumn("posterior", F.when(told, F.array_max("__known")).when(empty, 0.0).otherwise(F.element_at("__post", -1))).withColumn("rejected", F.col("language") == UND)
    return found.drop("__scores", "__prior", "__host", "__suffix", "__post", "__known")


def of_documents(docs: DataFrame, *more: Column) -> DataFrame:
    """documents as identify() takes them: the lang column declares, the source is the host, there is no address."""
    declared = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    host = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("id"), F.col("text"), declared.alias("declared"), host.alias("host"), F.lit(None).cast("string").alias("suffix"), *more)


def of_pages(pages: DataFrame) -> DataFrame:
    """pages as identify() takes them: visible text, the html element's lang, the address's host and suffix."""
    html = F.coalesce(F.col("html"), F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " "), "&[#A-Za-z0-9]+;?", " ")
    declared = F.lower(F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), F.lit("")))
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return pages.select(F.col("page_id").alias("id"), visible.alias("text"), declared.alias("declared"), host.alias("host"), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """documents without those that are rejected; columns stay as they are.

    Scores are computed twice, once for the priors, as that costs less than a shuffle of the texts.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    kept = identify(of_documents(docs, rest), keep_text=True).filter(~F.col("rejected"))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = of_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("kind", F.lit("document"))
    pages = of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("kind", F.lit("page"))
    found = identify(docs.unionByName(pages))
    at = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select("kind", at("document").alias("doc_id"), at("page").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "rejected")
