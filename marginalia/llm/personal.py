"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

1. Fixed rules give base spans (email, ip, card, phone); these seed entities stay.
2. Each occurrence, of a seed or of any other candidate, induces lexical patterns: the two
   words before it, the words around it, and the label before it (a word with a colon,
   an equals sign, a number sign or an opening bracket), each with the class of what stands
   there. Words count without case, digits and outer marks. Candidates are groups of seven
   or more digits with single separators, names with an @, (at), [at] or "at" and a host, and
   other runs of identifier characters with four or more digits. Classes are an address, four
   numbers with dots, a long number (12 digits and more), a dialled one (of 7 to 15 digits
   with a plus, brackets or separators, or 7 to 11 without) and all others.
3. Patterns and instances (distinct values) form a graph, one edge for each distinct
   pair however many copies there are. A pattern's confidence for a kind is the share
   of its instances' scores, smoothed; an instance's score is 1 for its own kind if it
   is a seed, else the mean confidence of its patterns. ROUNDS rounds alternate.
4. Patterns with CONFIDENCE and SUPPORT distinct seeds discover: an instance that no
   base span touches becomes a span of the pattern's kind.

Sums for a pattern or instance are partial before each shuffle; joins are of written
tables, whose hot keys Spark can split. Only texts with a digit or a sign of an
address are looked at closely. Spans are found in the rows' own order of matches, by a window for each row.

Null and empty texts have no spans; texts are scanned whole; repeated rows each give
a row; rows with a null id are kept; extra columns are ignored. Offsets count code
points, ends are exclusive. Quantifiers are possessive where that changes no match,
so that long runs need neither a deep stack nor quadratic time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: The rules' expressions; a run that can't match is left after one look.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What else may be an identifier: spelled addresses, groups of digits, and runs of identifier characters with a digit.
ADDRESS = r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]|(?: ?(?:\(at\)|\[at\]) ?| at (?=[A-Za-z0-9-]++\.))[A-Za-z0-9-]++)[A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++)*+"
RUNS = r"(?<![0-9A-Za-z._%+@/-])(?:" + ADDRESS + r"|\(?\+?\(?[0-9](?:(?:[ ./-]|\) ?| \()?[0-9]){6,}+(?![0-9A-Za-z._%+@/-]*+[A-Za-z_%@])|(?=[A-Za-z._%+@/-]*+[0-9])[0-9A-Za-z._%+@/-]++)"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ROUNDS, CONFIDENCE, SUPPORT, SMOOTHING = 3, 0.8, 5, 1.0


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """Whether a match of kind's expression is one."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        "card": F.length(digits).between(14, 19) & luhn(digits),
        "phone": F.length(digits).between(10, 15),
        "run": (F.length(digits) >= 4) | match.rlike(r"@|\(at\)|\[at\]| at "),
    }[kind]


def occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Spans of the rules and of other runs: id, print (of the text), kind, start, end, value, left, right."""
    text = F.col("text")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.filter(text.rlike(r"[0-9@]|[(\[]at[)\]]| at [A-Za-z0-9-]++\.")).withColumn("print", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    guard = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+"), "run": F.lit(True)}
    # one generator over the kinds, so that the texts are read once
    kinds = [*RULES, "run"]
    per_kind = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(guard[k], F.regexp_extract_all(text, F.lit(r), F.lit(0))).alias("hits"), F.when(guard[k], F.split(text, r, -1)).alias("gaps")) for k, r in zip(kinds, [*RULES.values(), RUNS], strict=True)])
    parts = rows.select("id", "print", "row", F.explode(F.filter(per_kind, lambda k: F.size(k["hits"]) > 0)).alias("k")).select("id", "print", "row", "k.kind", "k.hits", "k.gaps")
    entry = F.transform("hits", lambda h, i: F.struct(
        i.alias("i"), h.alias("value"), F.length(F.get("gaps", i)).alias("gap"),
        F.right(F.get("gaps", i), F.lit(60)).alias("left"), F.left(F.get("gaps", i + 1), F.lit(40)).alias("right")))
    rowwise = parts.select("id", "print", "row", "kind", F.explode(entry).alias("e")).select("id", "print", "row", "kind", "e.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.col("gap") + F.length("value")).over(before)
    spans = rowwise.withColumn("end", ends).withColumn("start", F.col("end") - F.length("value"))
    good = F.coalesce(*[F.when(F.col("kind") == k, holds(k, F.col("value"))) for k in kinds])
    spans = spans.filter(good)
    # runs that a base span touches aren't candidates
    order = Window.partitionBy("row").orderBy("start", F.col("kind") == "run", "end")
    base = F.col("kind") != "run"
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    spans = spans.withColumn("reach", reach).withColumn("ahead", ahead)
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    return spans.filter(base | free).select("id", "print", "kind", "start", "end", "value", "left", "right")


def patterned(spans: DataFrame) -> DataFrame:
    """spans with the array of their lexical patterns."""
    value, digits = F.col("value"), F.length(F.regexp_replace("value", "[^0-9]", ""))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "0"), r"(?U)(?<!\S)[^\w\s:=#(]+|[^\w\s:=#(]+(?!\S)", "")
    two = plain(F.regexp_extract("left", r"((?:\S+\s+)?\S+)\s*$", 1))
    one = F.regexp_extract(two, r"(\S+)$", 1)
    label = F.regexp_extract(plain(F.regexp_extract("left", r"(\S+(?:\s*[:=#(]+)?)\s*$", 1)), r"(?U)(\w+)\s*[:=#(]+$", 1)
    after = plain(F.regexp_extract("right", r"^\s*(\S+)", 1))
    spaced = value.rlike(r"^\(?\+?[0-9 ()./-]+$")
    shape = F.when(value.rlike(r"@|\(at\)|\[at\]| at "), "address").when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "dotted")
    shape = shape.when(value.rlike("^[0-9][0-9 -]*$") & (digits >= 12), "number").when(spaced & digits.between(7, 15) & (value.rlike("[^0-9]") | (digits <= 11)), "dialled").otherwise("mixed")
    both = F.array(
        F.when(two != "", F.concat(F.lit("after "), two, F.lit(" | "), shape)), F.when((one != "") & (after != ""), F.concat(F.lit("between "), one, F.lit(" _ "), after, F.lit(" | "), shape)),
        F.when(label != "", F.concat(F.lit("label "), label, F.lit(" | "), shape)),
    )
    return spans.withColumn("patterns", F.array_compact(both))


def confident_patterns(spans: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence, seeds) that may discover, from spans with their patterns."""
    edges = written(spans.select(F.explode("patterns").alias("pattern"), "value", F.when(F.col("kind") != "run", F.col("kind")).alias("seed")).distinct(), "edges")
    sizes = written(edges.groupBy("pattern").agg(F.count_distinct("value").alias("n")), "sizes")
    degrees = edges.filter("seed is null").select("pattern", "value").distinct().groupBy("value").agg(F.count("*").alias("degree"))
    seeds = edges.filter("seed is not null").select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    others = edges.filter("seed is null").select("pattern", "value")
    scores = seeds
    for i in range(rounds):
        sums = scores.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count_if(F.col("score") == 1.0).alias("seeds"))
        now = sums.join(sizes, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + SMOOTHING)).alias("confidence"), "seeds")
        now = written(now, "patterns")
        if i + 1 < rounds:
            means = others.join(now.filter("seeds > 0"), "pattern").groupBy("value", "kind").agg(F.sum("confidence").alias("s")).join(degrees, "value").select("value", "kind", F.least(F.lit(0.999), F.col("s") / F.col("degree")).alias("score"))
            scores = seeds.unionByName(others.join(written(means, "scores"), "value").select("pattern", "value", "kind", "score"))
    return now.filter((F.col("confidence") >= confidence) & (F.col("seeds") >= support))


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """A row for each row of df: the id, counts and digest of base spans, and all spans (array of start, kind's number, end)."""
    spans = written(patterned(occurrences(df, id_col, text_col)), "spans")
    base = spans.filter("kind <> 'run'").select("id", "print", "start", "kind", "end", F.lit(True).alias("base"))
    patterns = confident_patterns(spans, rounds, confidence, support)
    runs = spans.filter("kind = 'run'").select("id", "print", "start", "end", F.explode("patterns").alias("pattern"))
    best = runs.join(patterns.withColumnRenamed("kind", "found"), "pattern").groupBy("id", "print", "start", "end").agg(F.max_by("found", F.struct("confidence", "found")).alias("kind"))
    every = base.unionByName(best.select("id", "print", "start", "kind", "end", F.lit(False).alias("base")))
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    # sets, as repeated rows find the same spans
    lists = every.groupBy("id", "print").agg(F.array_sort(F.collect_set(F.struct(F.col("start"), number.alias("kind"), F.col("end"), F.col("base")))).alias("all"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("print"))
    joined = rows.join(lists.withColumnRenamed("id", "id_").withColumnRenamed("print", "print_"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("print") == F.col("print_")), "left")
    own = F.coalesce(F.filter("all", lambda s: s["base"]), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>"))
    count = lambda k: F.size(F.filter(own, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return joined.select(F.col("id").alias(id_col), *counts, F.sha2(spelled(own), 256).alias("base_sha256"), F.coalesce(spelled(F.col("all")), F.lit("")).alias("spans"))


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
