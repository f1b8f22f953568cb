"""Text functions over columns. All are native but nfc(), for which Spark has no function.

Patterns carry (?iuU): without it Java folds only ASCII letters and its \\w and \\b are ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"(?U)[^\W\d_]+"
TRUNCATED = "[...Nội dung bị cắt do vượt giới hạn ngữ cảnh...]"

#: Function words and boilerplate that carry no content; words of negation and duty aren't among them.
STOPWORDS = sorted(set("""
và hoặc hay cũng của trong ngoài trên dưới tại về với cho nhằm để mà thì là
như nếu nhưng tuy do vì nên khi lúc sau trước từ đến vào ra này nọ kia đó đây
ấy các mỗi mọi những một vài nhiều ít rất quá cả chỉ riêng cùng theo căn cứ
gồm bao gồm thuộc gồm cả sau đây nêu trên kể trên dưới đây đối
quy định việc trường hợp nội dung vấn đề liên quan đáp ứng phù hợp tương ứng
""".split()))
#: Words and phrases by which Vietnamese prose is known.
VIETNAMESE_WORDS = ["của", "và", "là", "trong", "không", "được", "các", "một", "hoặc", "tại", "theo", "khi", "nếu", "phải", "việc", "đối với", "ngân hàng", "quy định"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it; inside lambdas nothing else sees to that."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def nfc(text: Column) -> Column:
    """Canonical composition; null stays null."""

    def compose(part: pd.Series) -> pd.Series:
        return part.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(compose, T.StringType())(text)


def squeeze(text: Column) -> Column:
    """White space to single spaces, none at the ends; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def normalize_ws(text: Column) -> Column:
    return squeeze(nfc(text))


def squash(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


@lru_cache(1)
def _folding() -> tuple[str, str]:
    """Letters with marks and what they are without, by their decomposition."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if bare != chr(code) and len(bare) == 1:
            source.append(chr(code))
            target.append(bare)
    return "".join(source) + "đĐ", "".join(target) + "dD"


def fold(text: Column) -> Column:
    """Without diacritics; đ becomes d. A text of ASCII has none."""
    return let(text, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(F.regexp_replace(t, r"\p{M}+", ""), *_folding())))


def plain(text: Column) -> Column:
    """Squeezed and in lower case. (Case folding proper differs for ß and a few others.)"""
    return F.lower(squeeze(text))


def folded(text: Column) -> Column:
    return F.lower(fold(squeeze(text)))


def answer_cell(text: Column) -> Column:
    """An answer for comparison: squeezed, without marks at its end, lower case."""
    return F.lower(F.regexp_replace(squeeze(text), r"(?U)[\s.!?;:,-]+$", ""))


def words(text: Column) -> Column:
    """Runs of letters, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Distinct words in lower case of two letters or more that aren't stopwords."""
    return F.array_distinct(F.filter(F.transform(words(text), F.lower), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS)))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words, joined by a space."""
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return let(F.transform(words(text), F.lower), lambda w: F.array_distinct(pairs(w)))


def windows(text: Column, size: int, most: int) -> Column:
    """Windows of size words, most of them at even steps; the whole text if it is shorter."""

    def cut(v: Column) -> Column:
        count = F.greatest(F.size(v) - size + 1, F.lit(1))
        taken = F.least(count, F.lit(most))
        return F.transform(F.sequence(F.lit(0), taken - 1), lambda i: F.array_join(F.slice(v, F.floor(i * count / taken).cast("int") + 1, size), " "))

    return let(F.split(squeeze(text), " "), cut)


def window_size(n: Column) -> Column:
    """How many words a window has for a passage of n words."""
    return F.when(n < 12, 3).when(n < 25, 4).when(n < 60, 6).otherwise(8)


def urls(text: Column) -> Column:
    """Distinct addresses in order, without a stop at the end."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""https?://[^\s"'<>,;)]+"""), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"\.+$", "")))


def url_basename(url: Column) -> Column:
    """The last part of the path, decoded; empty if there is none."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(F.try_url_decode(F.element_at(F.split(path, "/"), -1)), F.lit(""))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


@lru_cache(1)
def vietnamese_letters() -> str:
    """Letters that only Vietnamese writes so: base letters with its marks, đ, ơ and ư."""
    bases, tones = ["a", "ă", "â", "e", "ê", "i", "o", "ô", "ơ", "u", "ư", "y"], ["", "\u0300", "\u0301", "\u0303", "\u0309", "\u0323"]
    letters = {unicodedata.normalize("NFC", b + t) for b in bases for t in tones} - set("aeiouy") | {"đ"}
    return "".join(sorted(letters | {c.upper() for c in letters}))


def vietnamese_ratio(text: Column) -> Column:
    """Vietnamese letters among them and ASCII ones; 0 without letters."""
    t = F.coalesce(text, F.lit(""))
    marked = count_of(t, vietnamese_letters())
    return F.coalesce(F.try_divide(marked.cast("double"), marked + count_of(t, "a-zA-Z")), F.lit(0.0))


def looks_reversed(text: Column) -> Column:
    """Many very short lines: text whose letters run down the page."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    lengths = F.array_sort(F.transform(lines, F.length))
    median = F.get(lengths, F.floor(F.size(lengths) / 2).cast("int"))
    return (F.size(lines) >= 8) & (F.length(text) >= 400) & (F.coalesce(median, F.lit(99)) <= 6)


def clip(text: Column, limit: Column | int) -> Column:
    """text, cut at limit with a line that says so."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.substring(text, F.lit(1), n), r"(?U)\s+$", ""), F.lit("\n" + TRUNCATED)))


def output_stats(text: Column) -> dict[str, Column]:
    """Numbers by which an output is judged at a glance."""
    t = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.split(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), " "), lambda x: x != "")
    n, letters = F.size(tokens), F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    distinct = F.size(F.array_distinct(F.transform(tokens, F.lower)))
    lowered = F.lower(t)
    return {
        "chars": F.length(t).cast("long"),
        "tokens": n.cast("long"),
        "distinct_ratio": F.coalesce(F.round(F.try_divide(distinct.cast("double"), n), 3), F.lit(0.0)),
        "diacritic_ratio": F.coalesce(F.round(F.try_divide(count_of(t, vietnamese_letters()).cast("double"), letters), 4), F.lit(0.0)),
        "function_words": sum((F.contains(lowered, F.lit(w)).cast("long") for w in VIETNAMESE_WORDS), F.lit(0).cast("long")),
    }


def hash_prefix(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, digits)


def tex_plain(text: Column) -> Column:
    """An abstract without TeX: commands, braces, dollars and comments."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)(?<!\\)%.*$", " ")
    t = F.regexp_replace(t, r"\\(?:cite|ref|label|footnote)[a-z]*\{[^{}]*\}", " ")
    t = F.regexp_replace(t, r"\\(?:emph|textbf|textit|text|textsc|texttt)\{([^{}]*)\}", "$1")
    t = F.regexp_replace(t, r"\\([%&$#_{}])", "$1")
    t = F.regexp_replace(t, r"\\[a-zA-Z]+\*?", " ")
    return squeeze(F.regexp_replace(t, r"[{}$~]", " "))


def as_flag(text: Column) -> Column:
    """1, true and yes, or 0, false and no; anything else is an error."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes"), True).when(t.isin("0", "false", "no"), False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def notes_map(notes: Column) -> Column:
    """key=value pairs between semicolons as a map; the last of equal keys wins."""
    parts = F.filter(F.transform(F.split(F.coalesce(notes, F.lit("")), r";\s*"), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value")))
    last = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda s, p: F.concat(F.filter(s, lambda q: q["key"] != p["key"]), F.array(p)))
    return F.map_from_entries(last)


def notes_text(pairs: dict[str, Column]) -> Column:
    """key=value; key=value of the columns that aren't null."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in pairs.items()])
