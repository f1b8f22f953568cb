"""Secret scans: fixed rules, and a character convolutional network over candidates.

The rules give base spans, which stay whatever the network says. The network
scores every candidate (each base span, and each run of 16 or more token
characters that holds a digit and a letter) together with its surrounding
context, and adds runs that no base span touches when their calibrated
probability reaches a threshold. The threshold is the highest one that keeps
RECALL of the held-out labelled findings. A candidate of more than BODY characters is
scored in overlapping pieces of BODY over its whole length, and has the highest score:
a secret behind a long path is seen as one at the start.

The network is trained here, in numpy, on FINDINGS labelled findings made from
a fixed seed (a bounded, documented sample); training takes a few seconds on
the driver, and the weights (some 30 KB) travel inside the function.

Null and empty texts have no spans; texts are scanned whole; repeated rows
each give a row; a row with a null id keeps it; extra columns are ignored.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import arrow_map


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
#: A text that matches none of this has no base span and no candidate.
ANY = r"[0-9]|(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}"
KINDS = ("assign", "access", "hex", "net")
REDACTED = "[SECRET]"

LEFT, BODY, RIGHT = 24, 48, 8
WIDTH = LEFT + BODY + RIGHT
#: From one piece of a long candidate to the next; a secret of up to BODY - STEP characters is whole in one of them.
STEP = 16
EMBED, KERNEL, FILTERS, HIDDEN = 8, 5, 20, 16
PAD, OTHER = 96, 95
#: Labelled findings to train on, and to calibrate on.
FINDINGS, HELD_OUT, RECALL, SEED = 2400, 1200, 0.98, 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed rules, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidate_runs(text: str) -> list[tuple[int, int]]:
    """Runs of token characters with a digit and a letter, without outer dots and dashes."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        a, b = len(run) - len(run.lstrip(".-/=")), len(run.rstrip(".-/"))
        body = run[a:b]
        if len(body) >= 16 and re.search("[0-9]", body) and re.search("[A-Za-z]", body):
            out.append((m.start() + a, m.start() + b))
    return out


def pieces(a: int, b: int) -> list[tuple[int, int]]:
    """The pieces in which the network sees a candidate: all of it, or overlapping parts of BODY."""
    return [(a, b)] if b - a <= BODY else [(i, i + BODY) for i in (*range(a, b - BODY, STEP), b - BODY)]


def windows(texts: list[str], spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes and the mask for (text's number, start, end) of pieces, BODY characters each at most."""
    codes = np.full((len(spans), WIDTH), PAD, np.uint8)
    mask = np.zeros((len(spans), WIDTH), np.float32)
    for row, (t, a, b) in enumerate(spans):
        text = texts[t]
        left, body, right = text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT]
        for at, part in ((LEFT - len(left), left), (LEFT, body), (LEFT + BODY, right)):
            raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
            codes[row, at : at + len(raw)] = np.where((raw >= 32) & (raw < 127), raw - 32, OTHER)
        mask[row, LEFT : LEFT + len(body)] = 1
    return codes, mask


class Net:
    """Embedding, one convolution, max and mean over the candidate and its context, two dense layers."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        normal = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "embed": normal(PAD + 1, EMBED) * 3,
            "conv": normal(KERNEL * (EMBED + 1), FILTERS),
            "conv_b": np.zeros(FILTERS, np.float32),
            "dense": normal(3 * FILTERS, HIDDEN),
            "dense_b": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, 1),
            "out_b": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, codes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        x = np.concatenate([p["embed"][codes], mask[..., None]], axis=2)
        steps = WIDTH - KERNEL + 1
        cols = np.concatenate([x[:, k : k + steps] for k in range(KERNEL)], axis=2)
        h = np.maximum(cols @ p["conv"] + p["conv_b"], 0)
        inside = mask[:, KERNEL // 2 : KERNEL // 2 + steps]
        n = np.maximum(inside.sum(1), 1)[:, None]
        top = (h * inside[..., None]).argmax(1)
        rows, cols_f = np.arange(len(codes))[:, None], np.arange(FILTERS)[None]
        around = (h * (1 - inside[..., None])).argmax(1)
        pooled = np.concatenate([h[rows, top, cols_f] * inside[rows, top], (h * inside[..., None]).sum(1) / n, h[rows, around, cols_f] * (1 - inside[rows, around])], axis=1)
        d = np.maximum(pooled @ p["dense"] + p["dense_b"], 0)
        z = (d @ p["out"] + p["out_b"])[:, 0]
        return z, (codes, cols, h, inside, n, top, around, pooled, d)

    def gradients(self, kept: tuple, dz: np.ndarray) -> dict[str, np.ndarray]:
        codes, cols, h, inside, n, top, around, pooled, d = kept
        p, g = self.p, {}
        g["out"], g["out_b"] = d.T @ dz[:, None], dz.sum(keepdims=True)
        dd = dz[:, None] @ p["out"].T * (d > 0)
        g["dense"], g["dense_b"] = pooled.T @ dd, dd.sum(0)
        dp = dd @ p["dense"].T
        dh = inside[..., None] * (dp[:, None, FILTERS : 2 * FILTERS] / n[:, None])
        rows, cols_f = np.arange(len(codes))[:, None], np.arange(FILTERS)[None]
        dh[rows, top, cols_f] += dp[:, :FILTERS] * inside[rows, top]
        dh[rows, around, cols_f] += dp[:, 2 * FILTERS :] * (1 - inside[rows, around])
        dh *= h > 0
        flat = dh.reshape(-1, FILTERS)
        g["conv"], g["conv_b"] = cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(0)
        dcols = dh @ p["conv"].T
        dx = np.zeros((len(codes), WIDTH, EMBED + 1), np.float32)
        steps = WIDTH - KERNEL + 1
        for k in range(KERNEL):
            dx[:, k : k + steps] += dcols[:, :, k * (EMBED + 1) : (k + 1) * (EMBED + 1)]
        at = codes.ravel()
        g["embed"] = np.stack([np.bincount(at, dx[..., e].ravel(), PAD + 1) for e in range(EMBED)], axis=1)
        return g

    def train(self, codes: np.ndarray, mask: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 4e-3) -> None:
        """Adam on the log loss."""
        r = np.random.default_rng(SEED + 1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                z, kept = self.forward(codes[rows], mask[rows])
                g = self.gradients(kept, ((1 / (1 + np.exp(-z)) - y[rows]) / len(rows)).astype(np.float32))
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def calibrate(self, codes: np.ndarray, mask: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling on held-out findings, then the highest threshold with the wanted recall."""
        z, _ = self.forward(codes, mask)
        a, b = 1.0, 0.0
        for _ in range(200):
            e = 1 / (1 + np.exp(-(a * z + b))) - y
            a, b = a - 0.05 * float((e * z).mean()), b - 0.05 * float(e.mean())
        self.scale, self.shift = a, b
        hits = np.sort((1 / (1 + np.exp(-(a * z + b))))[y == 1])
        self.threshold = float(hits[int((1 - recall) * len(hits))])

    def probability(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = [self.forward(codes[i : i + 512], mask[i : i + 512])[0] for i in range(0, len(codes), 512)]
        return 1 / (1 + np.exp(-(self.scale * np.concatenate(out) + self.shift))) if out else np.zeros(0)


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, label, where the secret starts): n findings, half of them secrets, made from a seed; some stand behind a path."""
    r = random.Random(seed)
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    syllables = "the an er on re en ti es or te of ed is it al ar st nt ion ment che sch ung que eau os ado cion der und lich".split()
    some = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    prose = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    number = lambda a, b: some(string.digits, a, b)

    def secret() -> str:
        while True:
            s = r.choice([
                lambda: some(hexa, 32, 64), lambda: some(alnum, 20, 64), lambda: some(alnum + "+/", 28, 60) + r.choice(["", "=", "=="]),
                lambda: some(alnum + "_-", 20, 48), lambda: "gh" + r.choice("pous") + "_" + some(alnum, 30, 36), lambda: "sk_live_" + some(alnum, 20, 32),
                lambda: "xox" + r.choice("bp") + "-" + number(10, 12) + "-" + some(alnum, 20, 28), lambda: "AIza" + some(alnum + "_-", 35, 35),
                lambda: "eyJ" + some(alnum, 20, 40) + "." + some(alnum + "_-", 30, 60), lambda: some(hexa.upper(), 32, 40), lambda: some(string.ascii_lowercase + string.digits, 20, 40),
            ])()
            if re.search("[0-9]", s) and re.search("[A-Za-z]", s):
                return s

    def harmless() -> str:
        while True:
            s = r.choice([
                lambda: f"{word()}{number(1, 2)}.example.{r.choice(['com', 'org', 'net'])}", lambda: f"www.{word()}.{r.choice(['com', 'org', 'de'])}/{word()}/{number(1, 4)}",
                lambda: f"{word()}_{word()}_{word()}_{number(1, 4)}", lambda: f"{word()}-{word()}-{word()}-{number(1, 4)}.html", lambda: f"20{number(2, 2)}-{number(2, 2)}-{number(2, 2)}T{number(2, 2)}.{number(2, 2)}Z",
                lambda: f"{word()}-{number(1, 2)}.{number(1, 2)}.{number(1, 2)}-{word()}.tar.gz", lambda: f"/{word()}/{word()}/{word()}{number(1, 3)}.py", lambda: f"{word()}{word().title()}{word().title()}{number(1, 2)}",
                lambda: f"{word()}{word()}{word()}{word()}{number(1, 3)}", lambda: f"SN-{number(4, 4)}-{number(4, 4)}-{word()[:2].upper()}", lambda: f"10.{number(4, 4)}/{word()}.{number(4, 6)}", lambda: f"{word()}={number(1, 3)}/{word()}={number(1, 3)}",
                lambda: f"{number(8, 20)}{r.choice('abcxkm')}", lambda: f"{number(1, 3)}_000_000_{word()}", lambda: f"{word().upper()}_{word().upper()}_{number(1, 3)}",
            ])()
            if len(s) >= 16 and re.search("[0-9]", s) and re.search("[A-Za-z]", s):
                return s

    def path() -> str:
        spoken = lambda: "".join(r.choice("b br c ch d dr f fl g h j k l m n p pr qu r s sh st t th tr v w x y z".split()) + r.choice("a e i o u y ai ea ee io ou er on ar ew".split()) for _ in range(r.randint(1, 4))) + r.choice(["", "", "s", "t", "ng", "ry", "ly", "ment"])
        part = lambda: r.choice([word, spoken, spoken, spoken, lambda: f"{spoken()}-{spoken()}", lambda: f"{spoken()}_{spoken()}", lambda: f"{spoken()}{number(1, 2)}.{r.choice(['html', 'txt', 'json', 'csv'])}", lambda: f"{word()}.{spoken()}.com", lambda: f"{word()}-{word()}", lambda: f"{word()}_{number(1, 3)}", lambda: number(1, 6), lambda: f"v{number(1, 1)}", lambda: r.choice(string.ascii_uppercase) + some(string.ascii_uppercase + string.digits, 7, 10), lambda: r.choice(string.ascii_uppercase) + "0" * r.randint(7, 10)])()
        return "/".join(part() for _ in range(r.randint(2, 9))) + "/"

    out = []
    for i in range(n):
        body, label = (secret(), 1) if i % 2 else (harmless(), 0)
        front = path() if r.random() < 0.5 else ""
        body = front + body
        before = prose(2, 8) + r.choice([" ", " ", ": ", ' "', " = ", "=", " (", "\n", " | ", "/"])
        if r.random() < (0.5 if label else 0.1):
            before += r.choice(["key", "auth", "bearer", "credential", "client_id", "private", "access", "pwd"]) + r.choice([": ", "=", ' = "', '": "', " "])
        if not label and r.random() < 0.2:
            before += r.choice([word() + number(1, 2) + "@", "https://", "http://"])
        text = before + body + r.choice([" ", '" ', ". ", ", ", ")", "\n"]) + prose(1, 6)
        out.append((text, len(before), len(before) + len(body), label, len(before) + len(front)))
    return out


def findings_arrays(found: list[tuple[str, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The findings' pieces; one is a secret if it shows 20 characters of one, and harmless if it shows none; others are left out."""
    spans, labels = [], []
    for i, (_, start, end, label, secret) in enumerate(found):
        for a, b in pieces(start, end):
            shown = label * max(0, b - max(a, secret))
            if not 0 < shown < 20:
                spans.append((i, a, b))
                labels.append(min(shown, 1))
    return *windows([f[0] for f in found], spans), np.array(labels, np.float32)


@lru_cache(1)
def trained() -> Net:
    net = Net()
    net.train(*findings_arrays(labelled_findings(FINDINGS, SEED)))
    net.calibrate(*findings_arrays(labelled_findings(HELD_OUT, SEED + 7)))
    return net


def probabilities(texts: list[str], spans: list[tuple[int, int, int, int]], net: Net) -> np.ndarray:
    """For each (text's number, start, end, kind) the highest probability of its pieces."""
    shown = [(row, t, x, y) for row, (t, a, b, _) in enumerate(spans) for x, y in pieces(a, b)]
    best = np.zeros(len(spans))
    for i in range(0, len(shown), 2048):
        part = shown[i : i + 2048]
        np.maximum.at(best, [w[0] for w in part], net.probability(*windows(texts, [w[1:] for w in part])))
    return best


def scan_texts(texts: list[str], net: Net) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]]:
    """For each text its base spans, and the base and added spans with the network's probability."""
    base, wanted = [], []
    for i, text in enumerate(texts):
        found = base_spans(text)
        base.append(found)
        wanted += [(i, a, b, k) for a, k, b in found]
        # found is in order of start: a run meets a base span only if one begins before its end and reaches into it
        ends, at, reach = sorted((a, b) for a, _, b in found), 0, -1
        for a, b in candidate_runs(text):
            while at < len(ends) and ends[at][0] < b:
                reach, at = max(reach, ends[at][1]), at + 1
            if reach <= a:
                wanted.append((i, a, b, 3))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for i in range(0, len(wanted), 2048):
        part = wanted[i : i + 2048]
        for (t, a, b, k), p in zip(part, probabilities(texts, part, net), strict=True):
            if k < 3 or p >= net.threshold:
                out[t].append((a, k, b, float(p)))
    return [(b, sorted(s)) for b, s in zip(base, out, strict=True)]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redact: bool = False) -> DataFrame:
    """A row for each row of df: the id, counts, base_sha256, spans, their highest probability.

    With redact, also column redacted: the text with every span replaced by
    REDACTED (spans that overlap become one). keep names columns to carry.
    """
    net = trained()
    own = df.select(*[F.col(f"`{c}`") for c in (id_col, *keep)], F.col(f"`{text_col}`").cast("string").alias("__text"))
    fields = [f for f in own.schema.fields if f.name != "__text"]
    extra = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, top_probability double" + (", redacted string" if redact else "")
    schema = T.StructType([*fields, *T.StructType.fromDDL(extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, column = batch.num_rows, batch.column(len(fields))
                hit = pc.match_substring_regex(column, ANY).to_pylist()
                rows = [i for i in range(n) if hit[i]]
                texts = column.take(pa.array(rows, pa.int64())).to_pylist()
                results: list = [([], [])] * n
                for i, found in zip(rows, scan_texts(texts, net), strict=True):
                    results[i] = found
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in results] for kind in range(3)]
                columns = [batch.column(i) for i in range(len(fields))]
                columns += [pa.array(c, pa.int64()) for c in counts]
                columns.append(pa.array([hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in results], pa.string()))
                columns.append(pa.array([digest([s[:3] for s in spans]) for _, spans in results], pa.string()))
                columns.append(pa.array([max((s[3] for s in spans), default=None) for _, spans in results], pa.float64()))
                if redact:
                    clean = column.to_pylist()
                    for i in rows:
                        clean[i] = blanked(clean[i], results[i][1])
                    columns.append(pa.array(clean, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + [c.split()[0] for c in extra.split(", ")])

    return arrow_map(own, run, schema)


def blanked(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """text with its spans replaced, overlapping ones together."""
    out, at = [], 0
    for a, _, b, _ in spans:
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """documents with every secret replaced by REDACTED; n_chars follows the text; no row goes.

    A null text stays null. Other columns pass unchanged, whatever their names are.
    """
    names = docs.columns
    # under names of their own, which no output of find_secrets() has
    carried = {c: f"__c{i}" for i, c in enumerate(names) if c != "text"}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in carried.items()], F.col("text").alias("__whole"), F.lit(0).alias("__row"))
    done = find_secrets(own, "__row", "__whole", keep=tuple(carried.values()), redact=True)
    new = {c: F.col(n) for c, n in carried.items()} | {"text": F.col("redacted")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("spans") != "", F.length("redacted").cast("long")).otherwise(F.col(carried["n_chars"]))
    return done.select(*[new[c].alias(c) for c in names])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
