"""Tables over scored answers. Denominators are conditional: what can't be assessed is counted, not averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.legal import clause_matches
from marginalia.provenance import assert_final, publishable, require

#: Kinds of error that make an answer unfaithful in its legal basis.
UNFAITHFUL = ["WRONG_INSTRUMENT", "NON_COVERING_PROVISION", "UNCITED_ASSERTION", "NUMERIC_THRESHOLD_MISMATCH"]
GROUP = ["model_name", "retrieval_mode"]


def mean(value: Column, places: int = 4) -> Column:
    """Of what isn't null; null if nothing is."""
    return F.round(F.avg(value), places)


def share(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole; null if whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole), places)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def f1(p: Column, r: Column) -> Column:
    """Of rounded means; 0 if either is 0 or missing."""
    return F.when((F.coalesce(p, F.lit(0.0)) == 0) | (F.coalesce(r, F.lit(0.0)) == 0), 0.0).otherwise(F.round(2 * p * r / (p + r), 4))


def unfaithful() -> Column:
    return F.arrays_overlap("types", F.array(*[F.lit(t) for t in UNFAITHFUL]))


def export_summary(records: DataFrame) -> DataFrame:
    """By model and mode: means over publishable rows, how many were refused, and how many abstained.

    Rates are rounded, so a count isn't got back from them.
    """
    ok = publishable()
    return records.groupBy(*GROUP).agg(
        count_if(ok).alias("count"), count_if(~ok).alias("refused"), mean(F.when(ok, F.col("citation_precision"))).alias("avg_citation_precision"), mean(F.when(ok, F.col("citation_recall"))).alias("avg_citation_recall"),
        mean(F.when(ok, F.col("correctness_score"))).alias("avg_correctness"), mean(F.when(ok, F.col("hallucinated").cast("double"))).alias("hallucination_rate"), mean(F.when(ok, F.col("abstained").cast("double"))).alias("abstention_rate"),
        count_if(ok & F.col("abstained")).alias("abstained"),
    )


def abstention_aggregates() -> list[Column]:
    """Refusing as a binary decision: of probes it is right, of answerable questions it isn't."""
    ans, abst = F.col("is_answerable"), F.col("abstained")
    tp, fp, tn, fn = count_if(~ans & abst), count_if(ans & abst), count_if(ans & ~abst), count_if(~ans & ~abst)
    return [
        F.count("*").alias("rows"), (tp + fn).alias("probes"), (tn + fp).alias("answerable"), tp.alias("true_positive"), fp.alias("false_abstention"), tn.alias("true_negative"), fn.alias("answered_probe"),
        share(tp + tn, F.count("*")).alias("abstention_accuracy"), share(tp, tp + fn).alias("probe_abstention_rate"), share(fp, tn + fp).alias("false_abstention_rate"),
        share(tp, tp + fp).alias("abstention_precision"), share(tp, tp + fn).alias("abstention_recall"), count_if(F.col("hedged")).alias("hedged_then_answered"),
    ]


def abstention_metrics(records: DataFrame, strict: bool = True, by: list[str] | None = None) -> DataFrame:
    """abstention_aggregates(); strict refuses rows of an unvalidated scorer, else the result says that it has them."""
    if strict:
        assert_final(records)
    out = records.groupBy(*(by or [])).agg(*abstention_aggregates())
    return out if strict else out.withColumn("provenance", F.lit("REFUSED_UNVALIDATED"))


def summarise(records: DataFrame, strict: bool = True) -> DataFrame:
    """By model and mode: every mean over the rows where it can be assessed, with how many those are, and strata."""
    if strict:
        assert_final(records)
    scorable, graded = F.col("citation_scorable"), F.col("correctness_score").isNotNull()
    main = records.groupBy(*GROUP).agg(
        F.count("*").alias("count"), mean(F.when(scorable, F.col("citation_precision"))).alias("citation_precision"), mean(F.when(scorable, F.col("citation_recall"))).alias("citation_recall"),
        count_if(scorable).alias("citation_scorable_rows"), count_if(~scorable).alias("citation_unscorable_rows"), count_if(F.col("gold_doc_unresolved")).alias("gold_doc_unresolved_rows"),
        mean(F.col("hallucinated").cast("double")).alias("hallucination_rate"), mean(F.col("correctness_score")).alias("avg_correctness"), count_if(graded).alias("correctness_rows"), count_if(~graded).alias("correctness_unassessable_rows"),
        mean(F.col("groundedness")).alias("groundedness_mean"), F.count("groundedness").alias("groundedness_assessable_rows"), count_if(F.col("anomaly") != "").alias("answerability_anomalies"), *abstention_aggregates()[7:10],
        count_if(F.col("hedged")).alias("hedged_then_answered"),
    )
    strata = records.withColumn("stratum", F.concat_ws("/", "passage_shape", "overlap_class")).groupBy(*GROUP, "stratum").agg(F.count("*").alias("n"), mean(F.col("groundedness")).alias("mean"))
    maps = strata.groupBy(*GROUP).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stratum", "n")))).alias("gold_passage_strata"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stratum", "mean")))).alias("groundedness_by_stratum"))
    out = main.join(maps, GROUP)
    return out if strict else out.withColumn("provenance", F.lit("REFUSED_UNVALIDATED"))


def table_statistics() -> list[Column]:
    """The statistics of a paper's table over one set of records with gold's first citation as first_gold."""
    ans, abst = F.col("is_answerable"), F.col("abstained")
    scorable = ans & F.col("citation_scorable")
    p, r = mean(F.when(scorable, F.col("citation_precision"))), mean(F.when(scorable, F.col("citation_recall")))
    clause = scorable & F.col("first_gold.clause_id").isNotNull()
    hit = clause & clause_matches(F.col("cited"), F.col("first_gold"))
    return [
        F.count("*").alias("rows"), count_if(ans).alias("answerable"), count_if(~ans).alias("probes"), share(count_if(ans & F.col("hallucinated")), count_if(ans)).alias("hallucination_rate_answerable"),
        mean(F.round("groundedness", 2)).alias("groundedness_mean"), F.count("groundedness").alias("groundedness_assessable_rows"), share(count_if(~ans & abst), count_if(~ans)).alias("probe_abstention_rate"),
        count_if(~ans & abst).alias("probe_abstained"), share(count_if(ans & abst), count_if(ans)).alias("false_abstention_rate"), count_if(ans & abst).alias("false_abstentions"), count_if(F.col("hedged")).alias("hedged_then_answered"),
        p.alias("citation_precision"), r.alias("citation_recall"), f1(p, r).alias("citation_f1"), count_if(scorable).alias("citation_scorable_rows"), (count_if(ans) - count_if(scorable)).alias("citation_unscorable_rows"),
        count_if(clause).alias("clause_gold_rows"), share(count_if(hit), count_if(clause)).alias("clause_accuracy"), count_if(ans & unfaithful()).alias("citation_unfaithfulness_rows"),
    ]


def tables(records: DataFrame) -> DataFrame:
    """By (model, mode), and by mode over all models, in one pass; pooled rows have a null model."""
    return records.groupingSets([["model_name", "retrieval_mode"], ["retrieval_mode"]], "model_name", "retrieval_mode").agg(F.grouping("model_name").cast("int").alias("pooled"), *table_statistics())


def type_histogram(records: DataFrame) -> DataFrame:
    """How often each kind of error comes among answerable rows."""
    return records.filter("is_answerable").select(F.explode(F.array_distinct("types")).alias("type")).groupBy("type").agg(F.count("*").alias("rows"))


def identical_answers(answers: DataFrame, a: str = "rag_bm25", b: str = "rag_dense") -> DataFrame:
    """One row: cells that both modes answered, and how many of them alike."""
    text = lambda mode: F.max(F.when(F.col("retrieval_mode") == mode, F.col("answer_text")))
    cells = answers.filter(F.col("retrieval_mode").isin(a, b)).groupBy("model_name", "question_id").agg(text(a).alias("x"), text(b).alias("y")).filter("x is not null and y is not null")
    return cells.agg(F.count("*").alias("total"), count_if(F.col("x") == F.col("y")).alias("identical"))


def campaign(meta: DataFrame) -> DataFrame:
    """One row about a run: backends, hardware, reasons of ending, first and last time, context."""
    names = lambda c: F.array_sort(F.collect_set(c))
    return meta.agg(
        names("generation_backend").alias("generation_backend"), names("quant_config").alias("quant_config"), names("hf_model_id").alias("hf_model_ids"), count_if(F.col("finish_reason") == "stop").alias("stopped"),
        count_if(F.col("finish_reason") == "length").alias("cut"), count_if(F.col("prompt_exact")).alias("prompt_exact_true"), F.min("generated_at").alias("first_at"), F.max("generated_at").alias("last_at"),
        F.count("rag_context_chars").alias("rows_stamped"), count_if(F.size("rag_context_truncated_ranks") > 0).alias("truncated_rows"), count_if(F.size("rag_context_dropped_ranks") > 0).alias("dropped_rows"),
        mean(F.col("rag_context_chars")).alias("mean_chars"), F.max("rag_context_chars").alias("max_chars"),
    )


def latencies(meta: DataFrame) -> DataFrame:
    return meta.groupBy(*GROUP).agg(mean(F.col("latency_s")).alias("latency_s"), F.count("latency_s").alias("rows"))


def examples(records: DataFrame, per_type: int = 3, order: str = "ordinal") -> DataFrame:
    """Up to per_type unfaithful but partly right answers for each kind of error, each answer once."""
    own = records.filter(F.col("is_answerable") & ~F.col("abstained") & unfaithful() & (F.col("correctness_score") >= 1))
    kinds = F.array_intersect("types", F.array(*[F.lit(t) for t in UNFAITHFUL]))
    each = own.withColumn("type", F.explode(kinds)).withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy(order))).filter(F.col("n") <= per_type)
    return each.groupBy("question_id", *GROUP).agg(F.min("type").alias("type"), F.max("correctness_score").alias("correctness_score"))


def condition(gold_chunk: Column, retrieved: Column, head_visible: Column, truncated: Column, dropped: Column) -> Column:
    """Whether a model saw the gold text: ABSENT, TRUNCATED or INTACT."""
    rank = F.array_position(retrieved, gold_chunk).cast("int")
    return F.when(~F.coalesce(rank > 0, F.lit(False)) | ~head_visible, "ABSENT").when(F.array_contains(truncated, rank) | F.array_contains(dropped, rank), "TRUNCATED").otherwise("INTACT")


def older_condition(gold_chunk: Column, retrieved: Column, head_visible: Column, truncated: Column) -> Column:
    """The same by the older rule, which doesn't look at dropped ranks."""
    return condition(gold_chunk, retrieved, head_visible, truncated, F.array().cast("array<int>"))


def visible_head(gold_text: Column, prompt: Column, chars: int = 40) -> Column:
    from marginalia.functions.text import plain

    return F.contains(plain(prompt), F.substring(plain(gold_text), 1, chars))


def conditioned(records: DataFrame) -> DataFrame:
    """By mode and condition: answers, unfaithful ones, refusals."""
    return records.filter("is_answerable").groupBy("retrieval_mode", "condition").agg(F.count("*").alias("rows"), count_if(unfaithful()).alias("unfaithful"), count_if(F.col("abstained")).alias("refused"))


def two_denominators(records: DataFrame) -> DataFrame:
    """By model and mode: errors of all answerable rows, and of those answered."""
    own = records.filter("is_answerable")
    answered = ~F.col("abstained")
    return own.groupBy(*GROUP).agg(
        F.count("*").alias("answerable"), count_if(F.col("hallucinated")).alias("hallucinated"), mean(F.col("hallucinated").cast("double")).alias("rate_all"), count_if(answered).alias("answered"),
        share(count_if(answered & F.col("hallucinated")), count_if(answered)).alias("rate_answered"),
    )


def gold_presence(records: DataFrame) -> DataFrame:
    """By mode: questions whose gold chunk was retrieved, and whose gold text was in the prompt."""
    question = lambda c: F.count_distinct(F.when(c, F.col("question_id")))
    return records.groupBy("retrieval_mode").agg(question(F.array_contains("retrieved", F.col("gold_chunk"))).alias("retrieved_questions"), question(F.col("condition") != "ABSENT").alias("visible_questions"))


def grid_problems(records: DataFrame, models: DataFrame, modes: DataFrame, questions: DataFrame, backends: dict[str, str], corpus: str) -> DataFrame:
    """One row: cells that are missing, strange or double, and rows with a wrong backend, corpus or no answer."""
    cell = ["model_name", "retrieval_mode", "question_id"]
    expected = models.select("model_name").join(F.broadcast(modes.select("retrieval_mode"))).join(questions.select("question_id"))
    seen = records.groupBy(*cell).agg(F.count("*").alias("n"))
    both = expected.withColumn("e", F.lit(1)).join(seen, cell, "full")
    cells = both.agg(count_if(F.col("n").isNull()).alias("missing"), count_if(F.col("e").isNull()).alias("unknown"), count_if(F.col("n") > 1).alias("doubled"))
    wanted = F.create_map(*[x for k, v in backends.items() for x in (F.lit(k), F.lit(v))])
    rows = records.agg(
        count_if(F.col("retriever_backend") != F.try_element_at(wanted, F.col("retrieval_mode"))).alias("bad_backend"), count_if(F.col("corpus_source") != corpus).alias("bad_corpus"),
        count_if(F.trim(F.coalesce("answer_text", F.lit(""))) == "").alias("empty_answers"),
    )
    return cells.join(rows)


def check_grid(problems: DataFrame) -> None:
    found = {k: v for k, v in problems.first().asDict().items() if v}
    require(not found, f"the grid isn't whole: {found}")


def describe_corpus(chunks: DataFrame) -> DataFrame:
    """By document: chunks, and whether their corpus may be reported."""
    return chunks.groupBy("doc_id", "corpus_source").agg(F.count("*").alias("chunks"), F.count_distinct("article_id").alias("articles")).withColumn("publishable", F.col("corpus_source") == "tier2_full")


def provenance_summary(records: DataFrame) -> DataFrame:
    """By model: the backends and corpora that its rows name, and how many rows are degraded."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return records.groupBy("model_name").agg(names("retriever_backend").alias("backends"), names("corpus_source").alias("corpora"), F.count("*").alias("rows"), count_if(~publishable()).alias("refused_rows"))
