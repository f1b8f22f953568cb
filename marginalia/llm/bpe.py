"""BPE encoding and decoding by speculation: propose, verify, repair.

Texts are cut into words by the tokenizer's own split pattern. For each word
not seen before, greedy longest match proposes tokens; a vectorised test then
looks at every adjacent pair of all proposals at once. A pair is compatible if
undoing the merges at the seam never meets a merge that would have come first;
a proposal whose pairs are all compatible is what the merge rules give, as each
proposed token also encodes to itself (checked when the tables are built). Only
words with an incompatible pair are merged exactly, by rank.

The vocabulary is read once, on the driver, from the path given, and its tables
(some 5 MB, bounded by the file) travel in a broadcast. Words are kept between
batches up to CACHE_WORDS, then dropped, so a worker's memory is bounded.

Null and empty texts have no tokens and decode to the empty text; texts are
encoded whole; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import arrow_map, arrow_schema

VOCABULARY = "byte_bpe_50k.json"
CACHE_WORDS, PART_BYTES = 150_000, 1_000_000
#: The split of byte-level BPE, a fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Letters and numbers newer than version 16 of Unicode, which the
#: tokenizers library's split doesn't know yet and treats as other characters.
LATE = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()
LATE_CLASS = "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in LATE)
#: The same split for texts with such characters; slower.
LATE_SPLIT = SPLIT.replace(r"\p{L}+", rf"(?:(?![{LATE_CLASS}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{LATE_CLASS}])\p{{N}})+").replace(r"[^\s\p{L}\p{N}]+", rf"(?:[{LATE_CLASS}]|[^\s\p{{L}}\p{{N}}])+")

#: SPLIT for texts in Latin-1, in the plain re module: its letters, numbers and white space one by one.
LOW_L, LOW_N, LOW_S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LOW_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LOW_L}]+| ?[{LOW_N}]+| ?[^{LOW_S}{LOW_L}{LOW_N}]+|[{LOW_S}]+(?![^{LOW_S}])|[{LOW_S}]+"


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lookup:
    """A map from whole numbers to whole numbers that answers arrays at once: open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            # the first of those that want a free place gets it, the others move on
            _, first = np.unique(at[left], return_index=True)
            first = first[self.keys[at[left[first]]] == -1]
            won = left[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.delete(left, first)
            at[left] = np.where(self.keys[at[left]] != -1, (at[left] + 1) & self.mask, at[left])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 if it isn't there."""
        shape, keys = keys.shape, keys.ravel()
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (found != -1)]
        return out.reshape(shape)


class Tables:
    """A byte-level vocabulary by rank: 0 to 255 are bytes, 256 + i is what merge i makes."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        as_bytes = lambda s: bytes(letters[c] for c in s)
        ids = {as_bytes(k): v for k, v in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [bytes([b]) for b in range(256)]
        rank = {t: i for i, t in enumerate(tokens)}
        self.n = n = 256 + len(merges)
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        for i, (a, b) in enumerate(merges):
            a, b = as_bytes(a), as_bytes(b)
            if a + b in rank:
                raise ValueError("two merges make the same token")
            rank[a + b] = 256 + i
            tokens.append(a + b)
            self.left[256 + i], self.right[256 + i] = rank[a], rank[b]
        self.ids = np.array([ids[t] for t in tokens], np.uint32)
        self.made = Lookup(self.left[256:] * n + self.right[256:], np.arange(256, n))
        # greedy may propose what the merge rules keep whole: a trie of those tokens
        whole = self.kept_whole(tokens)
        nodes, edges, self.token_of = {b"": 0}, [], [-1]
        for i in np.flatnonzero(whole):
            t = tokens[i]
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(nodes)
                    edges.append((nodes[t[: k - 1]] * 256 + t[k - 1], nodes[t[:k]]))
                    self.token_of.append(-1)
            self.token_of[nodes[t]] = int(i)
        self.token_of = np.array(self.token_of, np.int32)
        self.child = Lookup(np.array([k for k, _ in edges], np.int64), np.array([v for _, v in edges], np.int64))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        spelling = {int(i): t for i, t in zip(self.ids, tokens, strict=True)} | {i: t.encode() for t, i in self.special.items()}
        self.speller = Speller(spelling)

    def kept_whole(self, tokens: list[bytes]) -> np.ndarray:
        """Which tokens the merge rules make of their own bytes."""
        done = self.exact(tokens)
        return np.array([len(d) == 1 and d[0] == i for i, d in enumerate(done)])

    def propose(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words of data at once: ranks, word by word, and how many each has."""
        lane, at, stop = np.arange(len(begin)), begin.astype(np.int64), end.astype(np.int64)
        node, best, after = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int32), at.copy()
        lanes, ranks = [], []
        while len(lane):
            step = np.where(at < stop, self.child(node * 256 + data[np.minimum(at, len(data) - 1)]), -1)
            alive = step >= 0
            token = self.token_of[np.maximum(step, 0)]
            hit = alive & (token >= 0)
            best, after = np.where(hit, token, best), np.where(hit, at + 1, after)
            dead = ~alive
            lanes.append(lane[dead])
            ranks.append(best[dead])
            node, at = np.where(alive, step, 0), np.where(alive, at + 1, after)
            go = alive | (at < stop)
            if not go.all():
                lane, at, stop, node, best, after = lane[go], at[go], stop[go], node[go], best[go], after[go]
        lanes = np.concatenate(lanes) if lanes else np.zeros(0, np.int64)
        order = np.argsort(lanes, kind="stable")
        return np.concatenate(ranks)[order].astype(np.int64) if len(lanes) else lanes, np.bincount(lanes, minlength=len(begin))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of ranks whether the merge rules keep the seam between them.

        Undoes merges on either side of the seam, latest first. A merge across
        the seam that comes before the one undone last would have happened.
        """
        n = self.n
        distinct, back = np.unique(a * n + b, return_inverse=True)
        a, b = distinct // n, distinct % n
        good = np.ones(len(distinct), bool)
        live, limit = np.arange(len(distinct)), np.full(len(distinct), n + 1, np.int64)
        while len(live):
            made = self.made(a * n + b)
            broken = (made >= 0) & (made < limit)
            good[live[broken]] = False
            # undo the later of the two merges; a byte can't be undone
            undo_a = ((a > b) & (a >= 256)) | (b < 256)
            done = broken | ((a < 256) & (b < 256))
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return good[back]

    def exact(self, words: list[bytes]) -> list[list[int]]:
        """Ranks for each word by the merge rules: by rank, leftmost first."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        bounds = (0, 8, 12, 16, 24, 32, 64)
        for low, high in zip(bounds, bounds[1:]):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                for i, ranks in zip(part, self.merged([words[i] for i in part], high), strict=True):
                    out[i] = ranks
        for i in np.flatnonzero(sizes > bounds[-1]):
            out[i] = self.merged_long(words[i])
        return out

    def merged(self, words: list[bytes], width: int) -> list[list[int]]:
        """The merge rules on many short words at once, a merge for each word and round."""
        n, none = self.n, np.int64(self.n)
        m = np.full((len(words), width + 2), -1, np.int64)
        sizes = np.array([len(w) for w in words])
        inside = np.arange(width) < sizes[:, None]
        m[:, :width][inside] = np.frombuffer(b"".join(words), np.uint8)

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            made = self.made(np.where((a >= 0) & (b >= 0), a * n + b, -2))
            return np.where(made >= 0, made, none)

        r = rank(m[:, :-1], m[:, 1:])
        lane = np.arange(len(words))
        out = [[]] * len(words)
        columns = np.arange(width + 2)
        while len(lane):
            i = r.argmin(1)
            rows = np.arange(len(lane))
            c = r[rows, i]
            done = c >= none
            if done.any():
                for k, row in zip(lane[done], m[done].tolist(), strict=True):
                    out[k] = row[: row.index(-1)]
                go = ~done
                lane, m, r, i, c = lane[go], m[go], r[go], i[go], c[go]
                if not len(lane):
                    break
                rows = np.arange(len(lane))
            source = np.minimum(columns + (columns > i[:, None]), width + 1)
            m = np.take_along_axis(m, source, 1)
            m[rows, i] = c
            r = np.take_along_axis(r, np.minimum(source[:, :-1], width), 1)
            r[rows, i] = rank(c, m[rows, i + 1])
            before = np.maximum(i - 1, 0)
            r[rows, before] = np.where(i > 0, rank(m[rows, before], c), r[rows, before])
        return out

    def merged_long(self, word: bytes) -> list[int]:
        """The same for one word of any length, with a heap over a linked list."""
        parts = list(word)
        n = len(parts)
        get = self.merge_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i, parts[i], parts[i + 1]) for i in range(n - 1) if (c := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            c, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j], after[i] = c, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (d := get((c, parts[after[i]]))) is not None:
                    heapq.heappush(heap, (d, i, c, parts[after[i]]))
            if before[i] >= 0 and (d := get((parts[before[i]], c))) is not None:
                heapq.heappush(heap, (d, before[i], parts[before[i]], c))
        return [p for p in parts if p >= 0]

    @property
    def merge_of(self) -> dict[tuple[int, int], int]:
        """The merges as a dictionary, made when the first long word comes."""
        if "_merge_of" not in self.__dict__:
            self._merge_of = {(a, b): 256 + i for i, (a, b) in enumerate(zip(self.left[256:].tolist(), self.right[256:].tolist(), strict=True))}
        return self._merge_of

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_merge_of"}

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ranks, word by word, how many each word has, and how many words failed the test."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        flat, counts = self.propose(np.frombuffer(b"".join(words), np.uint8), end - size, end)
        owner = np.repeat(np.arange(len(words)), counts)
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.unique(owner[seam[~self.compatible(flat[seam], flat[seam + 1])]]) if len(seam) else np.zeros(0, np.int64)
        if len(bad):
            repaired = self.exact([words[i] for i in bad])
            good = np.ones(len(words), bool)
            good[bad] = False
            new = counts.copy()
            new[bad] = [len(r) for r in repaired]
            out = np.empty(int(new.sum()), np.int64)
            to = np.repeat(good, new)
            out[to] = flat[np.repeat(good, counts)]
            out[~to] = np.fromiter((t for r in repaired for t in r), np.int64)
            flat, counts = out, new
        return flat, counts, len(bad)


class Speller:
    """The bytes of each id; light, as decoding needs no more."""

    def __init__(self, spelling: dict[int, bytes]):
        top = max(spelling) + 1
        self.size = np.array([len(spelling.get(i, b"")) for i in range(top + 1)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(spelling.get(i, b"") for i in range(top)), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell; an id that isn't in the vocabulary spells nothing."""
        ids = np.minimum(ids.astype(np.int64), len(self.size) - 1)
        n = self.size[ids]
        total = np.cumsum(n)
        return self.blob[np.repeat(self.start[ids] - total + n, n) + np.arange(total[-1] if len(total) else 0)].tobytes()


class Slots(dict):
    """Numbers words as they first come up, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


class Codec:
    """Encodes texts with Tables; keeps words between calls."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.low, self.any, self.slow = re.compile(LOW_SPLIT).findall, regex.compile(SPLIT).findall, regex.compile(LATE_SPLIT).findall
        self.late = re.compile(f"[{LATE_CLASS}]").search
        special = sorted(tables.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.failed = self.seen = 0
        self.clear()

    def clear(self) -> None:
        self.slots = Slots()
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def find(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.slow(text) if self.late(text) else self.any(text)
        return self.low(text)

    def words(self, text: str) -> list:
        if self.cut is None or not any(s in text for s in self.tables.special):
            return self.find(text)
        out: list = []
        for part in self.cut.split(text):
            # a special string's key is no word's
            out += [("special", part)] if part in self.tables.special else self.find(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.slots) > CACHE_WORDS:
            self.clear()
        words: list = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words += self.words(text)
            ends[i + 1] = len(words)
        at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        if new := self.slots.new:
            plain = [w for w in new if type(w) is str]
            ranks, counts, failed = self.tables.encode_words([w.encode() for w in plain])
            self.seen, self.failed = self.seen + len(plain), self.failed + failed
            ids = self.tables.ids[ranks]
            if len(plain) < len(new):
                marks = np.array([type(w) is str for w in new])
                every = np.ones(len(new), np.int64)
                every[marks] = counts
                both = np.empty(int(every.sum()), np.uint32)
                to = np.repeat(marks, every)
                both[to], both[~to] = ids, [self.tables.special[w[1]] for w in new if type(w) is not str]
                ids, counts = both, every
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, counts])
            new.clear()
        starts = np.cumsum(self.sizes) - self.sizes
        n = self.sizes[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(starts[at] - total[:-1], n) + np.arange(total[-1])]
        bounds = total[ends]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(2)
def tables_at(path: str) -> Tables:
    with open(path, "rb") as f:
        return Tables(f.read())


_codecs: dict[str, Codec] = {}


def codec_of(path: str, shared) -> Codec:
    """This process's codec for the vocabulary at path, from a broadcast of its Tables."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(shared.value)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _mapped(df: DataFrame, in_col: str, drop: bool, outs: list[T.StructField], work) -> DataFrame:
    """df with columns outs made from in_col, which goes if drop; work: a list of values, none null, to a list of columns."""
    rest = [f for f in df.schema.fields if f.name != in_col or not drop]
    own = df.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{in_col}`").alias("__in"))
    schema = T.StructType([*rest, *outs])
    kinds = arrow_schema(T.StructType(outs)).types
    empty = b"" if isinstance(own.schema["__in"].dataType, T.BinaryType) else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole.column(len(rest))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            part = (np.cumsum(sizes, dtype=np.int64) // PART_BYTES).tolist()
            at = 0
            while at < len(part):
                to = bisect.bisect_right(part, part[at])
                made = work([empty if x is None else x for x in column.slice(at, to - at).to_pylist()])
                rows = whole.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(rest))), *(pa.array(m, t) for m, t in zip(made, kinds, strict=True))], names=schema.names)
                at = to

    return arrow_map(own, run, schema)


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, drop_text: bool = True) -> DataFrame:
    """df with n_tokens (long) and ids (binary: unsigned 32-bit, little-endian) of text_col."""
    path = path or default_path()
    shared = df.sparkSession.sparkContext.broadcast(tables_at(path))

    def work(texts: list[str]) -> list:
        ids = codec_of(path, shared).encode(texts)
        return [[len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids]]

    return _mapped(df.withColumn(text_col, F.col(f"`{text_col}`").cast("string")), text_col, drop_text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], work)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, drop_ids: bool = True) -> DataFrame:
    """df with decoded (string) from ids_col as encode() writes it; bytes that aren't UTF-8 become U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(tables_at(path or default_path()).speller)

    def work(packed: list[bytes]) -> list:
        return [[shared.value.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in packed]]

    return _mapped(df, ids_col, drop_ids, [T.StructField("decoded", T.StringType())], work)


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None, drop_text: bool = True) -> DataFrame:
    """encode() and decode() in one pass over the texts: n_tokens, ids and decoded, which is made of the ids alone."""
    path = path or default_path()
    shared = df.sparkSession.sparkContext.broadcast(tables_at(path))

    def work(texts: list[str]) -> list:
        codec = codec_of(path, shared)
        ids = codec.encode(texts)
        spell = codec.tables.speller.decode
        return [[len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids], [spell(x).decode("utf-8", "replace") for x in ids]]

    outs = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return _mapped(df.withColumn(text_col, F.col(f"`{text_col}`").cast("string")), text_col, drop_text, outs, work)


def pack(ids: list[int]) -> bytes:
    """A list of ids as encode() writes it."""
    return struct.pack(f"<{len(ids)}I", *ids)


def digests(docs: DataFrame) -> DataFrame:
    """Tokens, their digest and the decoded text's digest for each row of documents."""
    done = round_trip(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
