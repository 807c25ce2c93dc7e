"""HTML main text by the maximum-scoring subsequence, with weights learned from labelled pages.

A page is read as a sequence of tokens: tags, and words with the container they stand in. Containers are what may hold text
of one kind: a tag with its classes (div.ad, nav, footer, ...). Weights are log-odds of being content, learned from pages that
label their content themselves, by exactly one <article> (or <main>) element: TRAIN_PAGES of them in the mean, picked by a
hash. Words weigh their container's log-odds, at most 1 and as a rule positive; tags weigh theirs, but never more than
-TAG. Tokens seen in no labelled page weigh a prior: 1 for words, -TAG for tags; words in containers whose name or class says
that they are no content (BOILERPLATE, NAMED; never html, body, main or what is around the only article) weigh ASIDE. One linear scan finds the contiguous region of the largest sum; blocks
in it are the text, but for those in containers of negative weight inside it.

White space inside a block is one space, blocks are joined by line feeds, character references are decoded; scripts, styles,
comments and markup never count. Null or empty html, or a page without a positive word: "". Null page_id or url stays; repeated
rows each get a result; of equal sums the first, then the shorter region wins. Where no page is labelled, all weights are
priors. An empty table gives no rows; other columns are ignored. Weights are at most KEYS rows, whatever the tables hold.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

TRAIN_PAGES = 2000
KEYS = 10_000
TAG = 0.2
SMOOTH = 1.0
ASIDE = -0.02  # a word that is no content by its container's name; little, as it may stand amid content

# fixed values: names of HTML
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "head", "html", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "title"}
BOILERPLATE = frozenset("nav header footer aside form button select option dialog menu head title".split())
# a whole class name, with what describes a part of it: "share-buttons", but neither "share-price" nor "has-sidebar"
NAMED = re.compile(r"(?:^|\s)(?:[\w]+(?:__|--))?(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus\w*|footer|header|login|masthead|menu|modal|nav\w*|newsletter|notice|pager|pagination|popup|promo\w*|related|repl(?:y|ies)|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:[_-]+(?:\d+|area|bar|block|body|box|buttons?|container|content|form|group|icons?|inner|item|left|links?|list|main|outer|panel|posts?|right|section|slot|text|thread|top|unit|wrap(?:per)?))*(?=\s|$)", re.I)
CONTENT = frozenset({"article", "main"})
ROOTS = frozenset({"html", "body", "main"})  # hold the article, whatever their classes say
LONG_KEY = 80

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")


def _key(tag: str, attributes: str) -> tuple[str, bool]:
    """(tag with classes, whether it says that it is no content)."""
    names = " ".join(sorted(a or b or c for a, b, c in _CLASS.findall(attributes))).lower() if "=" in attributes else ""
    aside = tag in BOILERPLATE or bool(names and tag not in ROOTS and NAMED.search(names))
    # long keys are told apart by a checksum
    short = names if len(names) <= LONG_KEY else f"{names[:LONG_KEY]}#{zlib.crc32(names.encode('utf-8', 'surrogatepass')):08x}"
    return (f"{tag}.{short}" if short else tag), aside


def tokens(page: str) -> Iterator[tuple[str, str, int, str, bool]]:
    """(kind, key, words, text, in boilerplate): kind is "tag", or "text" with the container's key."""
    # of each open element: tag, key, whether it or one around it is boilerplate, the key of the nearest container
    stack: list[tuple[str, str, bool, str]] = []
    sole = len(re.findall(r"<article[\s>]", page, re.I)) == 1
    open_: Counter[str] = Counter()

    def drop(n: int) -> None:
        open_.subtract(t for t, *_ in stack[n:])
        del stack[n:]

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not text.isspace():
            yield "text", stack[-1][3] if stack else "", len(text.split()), text, bool(stack) and stack[-1][2]
        elif text:
            yield "text", "", 0, text, False
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            key = f"/{tag}"
            if open_[tag] > 0:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                key = f"/{stack[i][1]}"
                drop(i)
            yield "tag", key, 0, "", False
            continue
        key, boilerplate = _key(tag, m[3])
        if tag in CLOSES_P and open_["p"] > 0:
            # an open paragraph ends here, unless another block has begun in it
            i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS)
            if stack[i][0] == "p":
                drop(i)
        yield "tag", key, 0, "", boilerplate
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            container = key if tag in BLOCKS and tag != "p" else stack[-1][3] if stack else ""
            # what is around the main element or the only article can't make it an aside
            inherits = bool(stack) and stack[-1][2] and tag != "main" and not (sole and tag == "article")
            stack.append((tag, key, boilerplate or inherits, container))
            open_[tag] += 1


class Weights:
    """Log-odds of tokens, from counts (kind:key -> inside, outside)."""

    def __init__(self, counts: dict[str, tuple[float, float]]):
        self.text = {k[5:]: max(-2.0, min(1.0, math.log((i + SMOOTH) / (o + SMOOTH)))) for k, (i, o) in counts.items() if k.startswith("text:")}
        self.tag = {k[4:]: max(-1000.0, min(-TAG, math.log((i + SMOOTH / 10) / (o + SMOOTH / 10)))) for k, (i, o) in counts.items() if k.startswith("tag:")}

    def of_text(self, key: str, boilerplate: bool) -> float:
        return ASIDE if boilerplate else self.text.get(key, 1.0)

    def of_tag(self, key: str) -> float:
        return self.tag.get(key, -TAG)


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous region of the largest positive sum; of equal ones the first to end; (0, 0) if there is none."""
    best, total, start = (0.0, 0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best[0]:
            best = (total, start, i + 1)
    return best[1:]


def extract(page: str | None, weights: Weights) -> str:
    """The text of the page's best contiguous region."""
    seen = list(tokens(page or ""))
    first, end = best_region([weights.of_tag(key) * (10 if key.lstrip("/").split(".")[0] in CONTENT and key in weights.tag else 1) if kind == "tag" else words * weights.of_text(key, boilerplate) for kind, key, words, _, boilerplate in seen])
    out, block = [], []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(block))).strip()
        if text:
            out.append(text)
        block.clear()

    for kind, key, words, text, boilerplate in seen[first:end]:
        if kind == "tag":
            name = key.lstrip("/").split(".")[0]
            if name in BLOCKS:
                close()
            elif name == "br":
                block.append(" ")
        elif not words:
            block.append(" ")
        elif weights.of_text(key, boilerplate) > 0:
            block.append(text)
    close()
    return "\n".join(out)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens inside and outside the one element that a page marks as its content."""
    counts: dict[str, list[int]] = {}
    for batch in pieces(batches, "html"):
        for page in batch.column(0).to_pylist():
            seen = list(tokens(page))
            for name in ("article", "main"):
                opens = [i for i, x in enumerate(seen) if x[0] == "tag" and x[1].split(".")[0] == name]
                closes = [i for i, x in enumerate(seen) if x[0] == "tag" and x[1].split(".")[0] == f"/{name}"]
                if len(opens) == len(closes) == 1 and opens[0] < closes[0]:
                    for i, (kind, key, words, _, boilerplate) in enumerate(seen):
                        if kind == "tag" or (words and not boilerplate):
                            inside = opens[0] < i < closes[0]
                            counts.setdefault(f"{kind}:{key}", [0, 0])[0 if inside else 1] += words or 1
                    break
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["key", "inside", "outside"])


def learn(pages: DataFrame) -> Weights:
    n = pages.count()
    some = pages.select(F.col("html").cast("string")).filter(F.col("html").isNotNull() & (F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(min(1.0, TRAIN_PAGES / max(n, 1)) * (1 << 30))))
    counts = some.mapInArrow(_labels, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(KEYS).collect()
    return Weights({r.key: (r.inside, r.outside) for r in rows})


def _extract(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = [extract(p, weights.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    weights = pages.sparkSession.sparkContext.broadcast(weights or learn(pages))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract(weights), "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html": op9_html}
