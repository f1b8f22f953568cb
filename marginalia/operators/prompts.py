"""Prompts, the generation grid, cache keys, resuming, and checks of outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.legal import KEYPHRASE, SENTINEL
from marginalia.functions.text import TRUNCATED, VIETNAMESE_WORDS, count_of, hash_prefix, let, normalize_ws, squeeze, vietnamese_letters
from marginalia.provenance import require

PER_PASSAGE, TOTAL, FLOOR = 3500, 7000, 400
#: What a prompt says.
SYSTEM = (
    "Bạn là chuyên gia tư vấn pháp lý chuyên sâu về các quy định ngân hàng, thanh toán điện tử và nghiệp vụ thẻ của Ngân hàng Nhà nước Việt Nam. "
    "Nhiệm vụ của bạn là trả lời chính xác, trung thực dựa trên các văn bản pháp luật hiện hành."
)
RAG = (
    f"{SYSTEM}\n\nDưới đây là các đoạn trích từ quy định pháp luật của Ngân hàng Nhà nước Việt Nam:\n\n",
    "\n\n---\nCâu hỏi: ",
    "\n\nYêu cầu nghiêm ngặt:\n1. Chỉ sử dụng thông tin trong các đoạn trích trên để trả lời.\n2. Phải trích dẫn cụ thể căn cứ pháp lý (Tên văn bản/Thông tư, Điều, Khoản) hỗ trợ cho câu trả lời.\n"
    f'3. Nếu các đoạn trích trên KHÔNG chứa đủ thông tin để trả lời câu hỏi, bạn PHẢI trả lời: "{KEYPHRASE}". Tuyệt đối không tự suy đoán thông tin ngoài văn bản.\n\nTrả lời:',
)
CLOSED = (
    f"{SYSTEM}\n\nCâu hỏi: ",
    "\n\nYêu cầu:\n1. Trả lời chính xác nội dung câu hỏi.\n2. Nêu rõ căn cứ pháp lý nếu biết (Tên văn bản, Điều, Khoản).\n"
    f'3. Nếu bạn không chắc chắn hoặc quy định pháp luật không quy định, hãy trả lời chính xác: "{KEYPHRASE}". Không được suy diễn hoặc tạo ra căn cứ pháp lý không có thật.\n\nTrả lời:',
)
#: Control tokens of chat templates.
MARKUP = [
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|pad_token|>", "<start_of_turn>", "<end_of_turn>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<tool_response>", "<|fim_middle|>",
]


def closed_book(question: Column) -> Column:
    return F.concat(F.lit(CLOSED[0]), question, F.lit(CLOSED[1]))


def rag_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(RAG[0]), context, F.lit(RAG[1]), question, F.lit(RAG[2]))


def pack(passages: Column, per_passage: int = PER_PASSAGE, total: int = TOTAL, floor: int = FLOOR) -> Column:
    """(context, context_chars, truncated_ranks, dropped_ranks) of passages in rank order.

    A fold, as what a passage gets depends on what those before it used: less than the
    floor left, and it and all after it go; else it is cut at what is left or at its own
    limit. Headers and the mark of a cut count as used, but aren't limited.
    """
    kind = "struct<used:int,blocks:array<string>,truncated:array<int>,dropped:array<int>,rank:int>"
    empty = lambda t: F.array().cast(f"array<{t}>")
    start = F.struct(F.lit(0).alias("used"), empty("string").alias("blocks"), empty("int").alias("truncated"), empty("int").alias("dropped"), F.lit(0).alias("rank")).cast(kind)

    def step(s: Column, passage: Column) -> Column:
        return let(F.struct(s.alias("s"), (s["rank"] + 1).alias("rank"), (F.lit(total) - s["used"]).alias("left"), F.length(passage).alias("length")), lambda v: placed(v, passage))

    def placed(v: Column, passage: Column) -> Column:
        s, rank = v["s"], v["rank"]
        allowance = F.least(F.lit(per_passage), v["left"])
        cut = v["length"] > allowance
        trimmed = let(F.substring(passage, F.lit(1), allowance), lambda x: F.when(F.right(x, F.lit(1)).rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)\s+$", "")).otherwise(x))
        body = F.when(cut, F.concat(trimmed, F.lit("\n" + TRUNCATED))).otherwise(passage)
        block = F.concat(F.lit("--- Tài liệu tham khảo ["), rank.cast("string"), F.lit("] ---\n"), body)
        over = (F.size(s["dropped"]) > 0) | (v["left"] < floor)
        with_block = lambda b: F.struct((s["used"] + F.length(b)).alias("used"), F.concat(s["blocks"], F.array(b)).alias("blocks"), F.when(cut, F.concat(s["truncated"], F.array(rank))).otherwise(s["truncated"]).alias("truncated"), s["dropped"].alias("dropped"), rank.alias("rank"))
        return F.when(over, F.struct(s["used"].alias("used"), s["blocks"].alias("blocks"), s["truncated"].alias("truncated"), F.concat(s["dropped"], F.array(rank)).alias("dropped"), rank.alias("rank"))).otherwise(let(block, with_block))

    def finish(s: Column) -> Column:
        return let(F.array_join(s["blocks"], "\n\n"), lambda c: F.struct(c.alias("context"), F.length(c).cast("long").alias("context_chars"), s["truncated"].alias("truncated_ranks"), s["dropped"].alias("dropped_ranks")))

    return F.aggregate(passages, start, step, finish)


def unbounded_context(passages: Column) -> Column:
    """All passages whole, as prompts had them before there was a budget."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("--- Tài liệu tham khảo ["), (i + 1).cast("string"), F.lit("] ---\n"), p)), "\n\n")


def user_turn(prompt: Column) -> Column:
    """A conversation of one user turn."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def prompt_field(prompt: Column, exact: Column) -> Column:
    """What a row keeps of a prompt: the text if it is exact, else a mark and the messages as JSON."""
    return F.when(exact, prompt).otherwise(F.concat(F.lit("[messages] "), F.to_json(user_turn(prompt))))


def grid(models: DataFrame, modes: DataFrame, questions: DataFrame) -> DataFrame:
    """Every (model_name, retrieval_mode, question): three small tables' cells."""
    return models.select("model_name").join(F.broadcast(modes.select("retrieval_mode"))).join(questions)


def question_hash(question: Column, answer: Column, passage: Column) -> Column:
    return hash_prefix(F.concat_ws("|", F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")), F.coalesce(passage, F.lit(""))), 16)


def cache_key(question_id: Column, model: Column, mode: Column, content: Column, corpus: Column) -> Column:
    return hash_prefix(F.concat_ws(":", question_id, model, mode, content, corpus), 24)


def corpus_hash(chunks: DataFrame, fields: tuple[str, ...] = ("chunk_id", "doc_id", "article_id", "clause_id", "text"), exact_nfc: bool = False) -> DataFrame:
    """One row: a hash that doesn't depend on the rows' order.

    The hash is over the sums of parts of the rows' hashes, which are partial in each task,
    and the number of rows: nothing is gathered or sorted, and a repeated row counts.
    """
    clean = normalize_ws if exact_nfc else squeeze
    row = F.concat(F.concat_ws("\x1f", *[clean(F.col(f)) if f == "text" else F.coalesce(F.col(f), F.lit("")) for f in fields]), F.lit("\x1e"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = F.concat_ws(",", F.count("*").cast("string"), *[part(at) for at in range(1, 65, 15)])
    return chunks.select(F.sha2(row, 256).alias("h")).agg(F.sha2(sums, 256).alias("corpus_hash"))


def resume(cells: DataFrame, done: DataFrame, on_conflict: str = "raise") -> DataFrame:
    """Cells (cache_key, backend) that are still to do.

    A key done by the same backend is skipped. One done by another backend raises, or is
    reused, or done again, as on_conflict says.
    """
    conflict = cells.join(done.select("cache_key", F.col("backend").alias("done_by")), "cache_key").filter(F.col("done_by") != F.col("backend"))
    if on_conflict == "raise":
        first = [r[0] for r in conflict.select("cache_key").limit(5).collect()]
        require(not first, f"keys done by another backend: {first}")
    if on_conflict == "regenerate":
        return cells.join(done, ["cache_key", "backend"], "left_anti")
    require(on_conflict in ("raise", "reuse"), f"unknown policy: {on_conflict}")
    return cells.join(done, "cache_key", "left_anti")


def retrieve_once(cells: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cells with the passages of their (question, mode), retrieved once for all models; closed book has none."""
    lists = retrieved.groupBy("question_id", "retrieval_mode").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context"))), lambda x: x["context"]).alias("passages"))
    return cells.join(lists, ["question_id", "retrieval_mode"], "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<string>")))


def generate(rows: DataFrame, model: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """rows with raw_response from an injected model; the one place where Python runs a model."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["raw_response"] = [model(p) for p in part[prompt]]
            yield part

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", raw_response string")


def stub_answer(prompt: Column, probes: list[str], answer: Column) -> Column:
    """A deterministic stand-in for a model: it refuses if a probe's question is in the prompt."""
    asked = F.exists(F.array(*[F.lit(p) for p in probes]), lambda q: F.contains(prompt, q)) if probes else F.lit(False)
    return F.when(asked, SENTINEL).otherwise(answer)


# --- checks of outputs -----------------------------------------------------------
def _tokens(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda x: x != "")


def longest_run(tokens: Column) -> Column:
    """The longest run of one token."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(t == s["last"], s["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(run, s["best"]).alias("best"))

    return F.aggregate(tokens, start, step, lambda s: s["best"])


def repeated_grams(df: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """(key, top_count): how often the commonest run of n tokens comes; counts are partial before the shuffle."""
    t = df.select(key, _tokens(F.col(text)).alias("t")).filter(F.size("t") >= n)
    grams = t.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("t", i, n), " ")))).alias("g"))
    return grams.groupBy(key, "g").count().groupBy(key).agg(F.max("count").alias("top_count"))


def check_outputs(df: DataFrame, key: str, text: str, question: str | None = None, finish_reason: str | None = None) -> DataFrame:
    """(key, findings, ok): an array of (code, severity) for each output; ok if none is blocking. An empty output has no other finding."""
    t, tokens = F.coalesce(F.col(text), F.lit("")), _tokens(F.col(text))
    grams = repeated_grams(df, key, text)
    n = F.size("tokens")
    rows = df.withColumn("tokens", tokens).join(grams, key, "left")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    ratio = F.try_divide(count_of(t, vietnamese_letters()).cast("double"), letters)
    hits = sum((F.contains(F.lower(t), F.lit(w)).cast("int") for w in VIETNAMESE_WORDS), F.lit(0))
    judged = (F.length(F.trim(t)) >= 20) & (letters >= 20) & (ratio < 0.01)
    found = [
        (F.exists(F.array(*[F.lit(m) for m in MARKUP]), lambda m: F.contains(t, m)), "template-markup-in-output", "blocking"),
        (longest_run(F.col("tokens")) >= 12, "repetition-single-token", "blocking"),
        (F.coalesce(F.col("top_count") >= 8, F.lit(False)), "repetition-ngram", "blocking"),
        ((n >= 40) & (F.size(F.array_distinct(F.transform("tokens", F.lower))) / n < 0.30), "vocabulary-collapse", "blocking"),
        (judged & (hits == 0), "not-vietnamese", "blocking"),
        (judged & (hits > 0), "low-diacritic-density", "review"),
    ]
    if question:
        q, a = F.lower(squeeze(F.col(question))), F.lower(squeeze(F.col(text)))
        found.append(((F.length(q) >= 25) & F.contains(a, q) & (F.length(a) < 1.6 * F.length(q)), "echoes-question", "blocking"))
    if finish_reason:
        found.append((F.coalesce(F.col(finish_reason) == "length", F.lit(False)), "hit-max-new-tokens", "review"))
    one = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    every = F.array_compact(F.array(*[F.when(c, one(code, severity)) for c, code, severity in found]))
    findings = F.when(squeeze(t) == "", F.array(one("empty-output", "blocking"))).otherwise(every)
    return rows.select(key, findings.alias("findings")).withColumn("ok", ~F.exists("findings", lambda f: f["severity"] == "blocking"))


def probe_gate(findings: DataFrame) -> DataFrame:
    """findings, if no output is blocked; else raises."""
    bad = [r[0] for r in findings.filter(~F.col("ok")).limit(20).collect()]
    require(not bad, f"{len(bad)} or more outputs are blocked: {bad}")
    return findings


