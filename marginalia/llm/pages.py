"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at the tags of block elements. A block knows its words,
its link density, those of the block before and after it, and what it stands in: an
element that never holds an article (nav, footer, aside, form and the like), one whose
class or id names a menu, notice, advert, sidebar or comment, and one that marks the
article (article, main). A decision tree, grown here from the small labelled table
PAGES below, says which blocks are article.

Scripts, styles and comments are never text. Character references are decoded once,
white space inside a block becomes one space, blocks are trimmed, empty ones go, and
the rest are joined by an empty line in page order; nothing else is dropped or capped.

Null and empty pages have the empty text. Tags that never close and pages that end in
the middle of a tag or comment are read as browsers read them: an unfinished tag or
comment is markup. Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import arrow_map

#: Fixed values of HTML: elements that begin and end blocks, and those whose content isn't text.
BLOCKS = set("""
address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption
figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav
ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul
""".split())
SILENT = set("script style noscript template svg math iframe object canvas audio video textarea select button datalist noframes noembed xmp head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article, and those that mark one.
OUTSIDE = set("nav footer aside form menu dialog fieldset".split())
INSIDE = set("article main".split())
#: Words of a class, id or role that speak against a block.
AGAINST = re.compile(
    r"(?:^|[-_])(?:ads?|adverts?|advertisement|advertorial|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navbar|navigation|menu|breadcrumbs?|crumbs|toolbar|pagination|pager|sidebar|"
    r"widget|related|recommend(?:ed|ations)?|teaser|footer|foot|topbar|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|comments?|commentlist|disqus|replies|reply|respond|complementary|contentinfo|copyright|disclaimer|skip|toc|tags?)(?:$|[-_0-9])",
    re.I,
)
#: Words that speak against it unless the name also has one that speaks for it (entry-header, legal-text), and those.
UNLESS = re.compile(r"(?:^|[-_])(?:header|masthead|legal|notice|side|aside|search)(?:$|[-_0-9])", re.I)
FOR = re.compile(r"(?:^|[-_])(?:article|post|entry|story|main|content|body|text)(?:$|[-_0-9])", re.I)
TAG = re.compile(r"""<!--(?:>|->|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|=|["'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)|'([^']*)|([^\s>]*))""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'/])hidden(?:$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    outside: bool
    against: bool
    inside: bool
    named: bool
    head: bool
    hidden: bool
    features: list[float] = field(default_factory=list)


@dataclass
class Open:
    """An element that is open, and what holds for all that stands in it."""

    name: str
    outside: bool
    against: bool
    inside: bool
    named: bool
    hidden: bool


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page with text, in order."""
    out: list[Block] = []
    stack = [Open("", False, False, False, False, False)]
    parts: list[str] = []
    linked: list[str] = []
    in_link, head = 0, False
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal head
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            top = stack[-1]
            links = len(entities.unescape("".join(linked)).split())
            out.append(Block(text, len(text.split()), links, top.outside, top.against, top.inside, top.named, head, top.hidden))
        parts.clear()
        linked.clear()

    while at < end:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            parts.append(piece)
            if in_link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
            in_link = 0
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if name == "a":
                in_link = 0
            if any(o.name == name for o in stack):
                while stack.pop().name != name:
                    pass
            head = False if re.fullmatch("h[1-6]", name) else head
            continue
        if name == "a":
            in_link = 1
        if name in SILENT and not m[3].endswith("/"):
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at) if name != "head" else re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
            at = (close.start() if name == "head" and close[0][1] != "/" else close.end()) if close else (end if name != "head" else at)
            continue
        if name in VOID:
            continue
        if re.fullmatch("h[1-6]", name):
            head = True
        if name in BLOCKS and name not in ("p", "li", "td", "th", "tr", "dt", "dd", "option", "html", "body", "h1", "h2", "h3", "h4", "h5", "h6") or name in ("span", "p", "li", "body") and m[3].strip():
            top = stack[-1]
            told = " ".join(" ".join(x for x in a[1:] if x) for a in ATTRIBUTE.findall(m[3])).split() if m[3] else []
            named = any(map(FOR.search, told))
            bad = any(AGAINST.search(t) or (UNLESS.search(t) and not FOR.search(t)) for t in told)
            inside = top.inside or name in INSIDE
            outside = top.outside or name in OUTSIDE or (name == "header" and not top.inside)
            against = top.against or (bad and name not in INSIDE and name != "body")
            stack.append(Open(name, outside, against, inside, top.named or named, top.hidden or bool(m[3] and HIDDEN.search(m[3]))))
    flush()
    return out


def describe(blocks: list[Block]) -> list[list[float]]:
    """The features of each block: its own, and words and link density of its neighbours."""
    density = [b.linked / b.words if b.words else 0.0 for b in blocks]
    any_inside = any(b.inside for b in blocks)
    out = []
    for i, b in enumerate(blocks):
        before, after = i - 1, i + 1
        out.append([
            float(b.words), density[i],
            float(blocks[before].words) if before >= 0 else 0.0, density[before] if before >= 0 else 0.0,
            float(blocks[after].words) if after < len(blocks) else 0.0, density[after] if after < len(blocks) else 0.0,
            float(b.outside), float(b.against), float(b.inside), float(any_inside and not b.inside), float(b.named), float(b.head), float(b.hidden),
        ])
    return out


#: The small labelled table: pages whose blocks are marked, + for article and - for the rest, in order of their text.
LONG = "Several sentences of plain prose stand here, one after another, as articles have them. They go on for a while, without any links, and end with a full stop."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport today</a></li></ul>'
LINK = '<a href="/l">Nine words of a long link to another page</a>'
PAGES = [
    (f'<nav>{MENU}</nav><div class="ad">Buy one now and get another one for nothing at all.</div><article><h1>A title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></article><footer>&copy; somebody</footer>', "----++++-"),
    (f'<nav>{MENU}</nav><article><h1>Another title of an article</h1><p>Yes.</p><p><b>No.<br></p><p>{LONG}</p></article><footer>{LONG}</footer>', "---++++-"),
    (f'<header><h1>Name of the site</h1>{MENU}</header><main><h2>Title</h2><p>{LONG}</p><p>See <a href="/x">this page</a> for more about it, and that one too.</p></main><aside><p>{LONG}</p></aside>', "----+++-"),
    (f'<div id="menu">{MENU}</div><div class="content"><h1>What happened</h1><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p>{MENU}</div><div id="footer">All rights reserved</div>', "---+++-----"),
    (f'<div class="cookie-notice"><p>We use cookies, and would like you to agree to them all before you go on.</p></div><div class="post"><h1>Post</h1><p>{LONG}</p></div><div class="comments"><h3>Comments</h3><p>{LONG}</p><p>I agree.</p></div>', "-++---"),
    (f'<article><header><h1>Title in a header</h1><p>By somebody</p></header><p>{LONG}</p><ul><li>First point of a list</li><li>Second point</li></ul><section class="comments"><p>{LONG}</p></section></article>', "+++++-"),
    (f'<article><p>{LONG}</p><form><p>Leave your address here</p></form><div class="ad">{LONG}</div><p>{LONG}</p><div class="related">{MENU}</div></article>', "+--+---"),
    (f'<body>{MENU}<h1>A page without any marks</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{MENU}<p><a href="/i">Imprint</a></p></body>', "---++++----"),
    (f'<table><tr><td>{MENU}</td><td><p>{LONG}</p><p>{LONG}</p></td></tr></table><p><a href="/t">Terms</a> <a href="/p">Privacy</a></p>', "---++-"),
    (f'<div><p>{LONG}</p><p>{LONG}</p></div><div><a href="/1">One more article that you may like</a></div><div><a href="/2">Yet another one of those</a></div><p><a href="/3">More</a></p>', "++---"),
    (f'<main><div hidden><p>{LONG}</p></div><h1>Shown</h1><p>{LONG}</p><blockquote>Quoted words.</blockquote><pre>x = 1</pre><table><tr><td>1</td><td>cell</td></tr></table></main><footer><p>{LONG}</p></footer>', "-++++++-"),
    (f'<div class="article-body"><p>{LONG}</p><p>A line.</p><p>{LONG}</p></div><div class="newsletter"><p>{LONG}</p></div><div class="share"><a href="/s">Share</a></div>', "+++--"),
    (f'<article><p>{LONG}</p><p><a href="/y">See this</a></p><p>x</p></article><footer><a href="/f">Foot</a></footer>', "+++-"),
    (f'<div><a href="/1">One link here</a></div><div>Topics</div><div><a href="/2">Another link</a></div><h2>Title of it</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>', "---++++"),
    (f'<div><a href="/1">One link here</a></div><div>Browse all of our topics by name</div><div><a href="/2">Another link</a></div><p>{LONG}</p><div><a href="/3">Next</a></div><div>Follow us</div><div><a href="/4">There</a></div>', "---+---"),
    ("<article><p>x</p></article>", "+"), ("<nav><a href=/>Home</a></nav><article><p>Two words</p></article>", "-+"), ("<p>a<p>b", "++"), ("Bare words", "+"),
    (f'<article><h1>T</h1><p>One.</p></article><div class="related"><p>{LONG}</p></div><footer>f</footer>', "++--"),
    (f'<p>{LONG}</p>', "+"), ("<p>Only a few words here.</p>", "+"), ("<div>One line</div><div>and one more line of it</div>", "++"),
    (f'<article><p>{LONG}</p><p><a href="/z">A line that is a link as a whole</a></p><p>{LONG}</p></article><p>{LONG}</p>', "+++-"),
    (f'<article><div class="notice"><p>{LONG}</p></div><p>One word</p><p>Two</p><p>Three words more.</p></article><div class="banner">Sale</div>', "-+++-"),
    (f'<nav><ul><li>{LINK}</li><li>{LINK}</li><li><a href="/n">Home</a></li></ul></nav><article><h1>Title</h1><p>{LONG}</p><p>{LINK}</p><p>Two words.</p></article>', "---++++"),
    (f'<article><h1>Title</h1><p>{LONG}</p></article><aside class="related"><h3>More of it</h3><p>{LINK}</p><p>{LINK}</p></aside><footer><p>{LINK}</p><p>{LONG}</p></footer>', "++-----"),
    (f'<main><h1>Title</h1><p>{LONG}</p><p>{LINK}</p><div class="related"><p>{LINK}</p><p>{LINK}</p></div></main><div class="sidebar"><p>{LINK}</p></div>', "+++---"),
    (f'<div class="menu"><p>{LINK}</p><p>{LINK}</p></div><p>{LONG}</p><p>{LONG}</p><div id="footer"><p>{LINK}</p></div>', "--++-"),
    (f'<article><div class="entry-header"><h1>Title</h1><p>By somebody</p></div><div class="legal-text"><p>{LONG}</p></div><p>{LINK}</p></article><div class="legal">{LONG}</div>', "++++-"),
    (f'<div><p>{LINK}</p><p>{LINK}</p><p>{LINK}</p></div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div><p>{LINK}</p><p>{LINK}</p></div>', "---+++--"),
    (f'<form><p>{LONG}</p></form><dialog><p>{LONG}</p></dialog><article><p>Short one.</p><p>{LONG}</p></article><div class="share"><p>{LINK}</p></div>', "--++-"),
    (f'<main><article><h1>T</h1><p>x</p></article></main><div class="popup">{LONG}</div><section id="comments"><article><p>{LONG}</p></article></section>', "++--"),
]


def grown(rows: list[list[float]], labels: list[int], depth: int = 8) -> tuple | float:
    """A tree as (feature, threshold, at most, above), or a share of labels; cuts by Gini impurity, the first best one."""
    share = sum(labels) / len(labels)
    if depth == 0 or share in (0, 1):
        return share
    best = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            left = [y for r, y in zip(rows, labels, strict=True) if r[f] <= cut]
            a, b, n, m = sum(left), sum(labels) - sum(left), len(left), len(labels) - len(left)
            impurity = a * (n - a) / n + b * (m - b) / m
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None or best[0] >= share * (1 - share) * len(labels) - 1e-12:
        return share
    _, f, cut = best
    sides = [[(r, y) for r, y in zip(rows, labels, strict=True) if (r[f] <= cut) == low] for low in (True, False)]
    return (f, cut, *(grown([r for r, _ in side], [y for _, y in side], depth - 1) for side in sides))


@lru_cache(1)
def tree() -> tuple | float:
    rows, labels = [], []
    for page, marks in PAGES:
        blocks = blocks_of(page)
        if len(blocks) != len(marks):
            raise ValueError(f"{len(blocks)} blocks, {len(marks)} marks: {page}")
        rows += describe(blocks)
        labels += [int(m == "+") for m in marks]
    return grown(rows, labels)


def is_article(features: list[float], node: tuple | float) -> bool:
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node >= 0.5


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    blocks, grown_tree = blocks_of(page or ""), tree()
    return "\n\n".join(b.text for b, f in zip(blocks, describe(blocks), strict=True) if is_article(f, grown_tree))


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep, text and n_chars (code points) for each row of df."""
    own = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return arrow_map(own, run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
