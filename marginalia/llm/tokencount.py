"""Token counts: batch encoding that returns lengths only.

Batches hold about BATCH_BYTES bytes whatever the number of rows, so memory
doesn't depend on how long texts are. A text longer than LONG is split at safe
boundaries, where no token can span the seam, and its parts are counted in as
many batches as they need; the sum is exact:

* sentencepiece: at a single space between two ASCII letters or digits. The
  space goes and the next part's dummy prefix stands for it. Safe if no piece
  holds a space after another character, which is checked when the model loads.
* byte-level tokenizers: before such a space, where the split pattern always cuts.

Where a model has no such guarantee, or a text no such boundary, it stays whole.
Null and empty texts have 0 tokens and 0 bytes; texts are counted whole;
repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map

VOCABULARY = "piece_bpe_32k.model"
BATCH_BYTES, LONG, LIMIT = 1_000_000, 20_000, 4096
#: A single space between two ASCII letters or digits.
SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def parts(text: str, keep_space: bool, long: int = LONG) -> list[str]:
    """text in parts of about long characters, cut at safe boundaries."""
    out, at = [], 0
    while len(text) - at > long and (m := SAFE.search(text, at + long)):
        out.append(text[at : m.start()])
        at = m.start() if keep_space else m.end()
    out.append(text[at:])
    return out


class Counter:
    """Counts tokens with the library that the vocabulary file is for."""

    def __init__(self, path: str):
        self.keep_space = path.endswith(".json")
        if self.keep_space:
            import json

            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            split = spec.get("pre_tokenizer") or {}
            t.no_truncation()
            t.no_padding()
            self.splits = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and all(" " not in x["content"] and not x["lstrip"] and not x["rstrip"] for x in spec["added_tokens"])
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            s = SentencePieceProcessor(model_file=path)
            pieces = [s.id_to_piece(i) for i in range(s.get_piece_size())]
            alone = s.encode("a", out_type=str) + s.encode("b", out_type=str)
            self.splits = not any("\u2581" in p.lstrip("\u2581") for p in pieces) and s.encode("a b", out_type=str) == alone and len(s.encode("a  b")) > len(alone)
            self.lengths = lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        rows: list[int] = []
        batch: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for row, n in zip(rows, self.lengths(batch) if batch else [], strict=True):
                out[row] += n
            rows.clear()
            batch.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in parts(text, self.keep_space) if self.splits and len(text) > LONG else [text]:
                if size and size + len(part) > BATCH_BYTES:
                    flush()
                rows.append(i)
                batch.append(part)
                size += len(part.encode()) if not part.isascii() else len(part)
        flush()
        return out


_counters: dict[str, Counter] = {}


def counter_at(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The id, n_bytes, n_tokens and over_limit for each row of df; path is on every machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    own = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kind = own.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_at(path)
        for batch in batches:
            n = counter.count([t or "" for t in batch.column(1).to_pylist()])
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(own, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
