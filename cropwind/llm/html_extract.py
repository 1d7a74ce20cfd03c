"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element is a binary variable, content or not. A logistic score of its tag, names, links
and text is its own potential; parent and child are tied by a 2x2 table, one for elements that open a
page region and one for all others. Sum-product messages go up the tree and down again, which gives
the exact marginal of every node. Text belongs to its nearest block element and is taken if that
node's marginal is at least one half.

The weights are trained from labelled pages: pages whose document is known. A block counts as content
if it stands in the document. The prior of the weights (Gaussian, around ``PRIOR``) speaks for
elements that no labelled page has; without labelled pages the prior alone is used.

Defined results: a null or empty page has an empty text; broken markup is read as far as it goes; rows
are independent, so repeats get equal texts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are fitted on: a bounded sample, by hash of the page's number.
TRAIN_PAGES = 240
#: Longest page in the sample.
TRAIN_CHARS = 60_000
#: A labelled page must share this much of its text with its document.
MIN_LABELLED = 0.4
#: Below this length a text must be a whole line of the document: short ones are found by chance.
CHANCE_CHARS = 25
PRIOR_STRENGTH = 100.0
STEPS = 300

#: Elements that flow inside a block, that are empty, and whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg canvas math select textarea button title head audio video map".split())
#: An open element on the left ends when one on the right begins.
ENDS = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tr td th tbody thead tfoot ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
#: Groups of tags that share a weight.
GROUPS = {
    "text": "p pre blockquote", "heading": "h1 h2 h3 h4 h5 h6", "item": "li dd dt", "list": "ul ol dl menu dir", "article": "article main", "nav": "nav",
    "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset legend", "table": "table tbody thead tfoot tr td th caption", "figure": "figure figcaption details summary",
    "page": "html body",
}
#: Name parts of page furniture and of articles.
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus "
    "discussion feedback footer form gdpr header hidden legal login masthead menu meta metadata modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar tracking widget".split()
)
GOOD_NAMES = frozenset("article articlebody body content entry main post story text prose markdown".split())
FEATURES = [*GROUPS, "other", "bad", "good", "links", "short", "medium", "long", "sentence", "inner", "bias"]
#: Where the weights are drawn to; others are drawn to 0. A region's name outweighs the prose inside it,
#: and a page as a whole is content, so what no furniture holds is kept.
PRIOR = {"nav": -25.0, "footer": -25.0, "aside": -25.0, "form": -25.0, "header": -25.0, "bad": -25.0, "article": 4.0, "good": 2.0, "text": 0.6, "heading": 0.5, "links": -2.5, "long": 0.4, "short": -0.3, "sentence": 0.3, "page": 6.0, "bias": 0.5}
#: Counts that stand for tables seen before the first page: [parent][child], for regions and for other elements.
REGION_COUNTS = ((40.0, 20.0), (12.0, 20.0))
PLAIN_COUNTS = ((60.0, 3.0), (2.0, 60.0))
REGIONS = frozenset("article main nav header footer aside dialog form section".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_GROUP_OF = {tag: name for name, tags in GROUPS.items() for tag in tags.split()}


@dataclass
class Page:
    """Block elements in page order (a parent before its children) and runs of text."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    #: (node, text, characters inside links)
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def parsed(source: str) -> Page:
    page, stack = Page(), [0]
    text: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(source)

    def flush() -> None:
        nonlocal linked
        if text:
            run = " ".join(html.unescape("".join(text)).split())
            if run:
                page.runs.append((stack[-1], run, min(linked, len(run))))
            text.clear()
        linked = 0

    while at < n:
        found = _TOKEN.search(source, at)
        piece = source[at : found.start() if found else n]
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not found:
            break
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, closing, rest = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if tag in SILENT and not closing:
            if tag in ("head", "title", "iframe", "noscript", "template"):
                flush()
            if not rest.endswith("/") or tag in ("script", "style"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else (n if tag in ("script", "style", "textarea", "title") else at)
        elif tag == "a":
            in_link = not closing
        elif tag in ("br", "hr", "img", "wbr", "input"):
            if tag == "hr":
                flush()
            elif tag != "wbr":
                text.append(" ")
        elif tag in INLINE or tag in EMPTY:
            continue
        elif closing:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == tag:
                    del stack[depth:]
                    break
        else:
            flush()
            in_link = False
            while len(stack) > 1 and tag in ENDS.get(page.tag[stack[-1]], ()):
                stack.pop()
            if tag in ("html", "body") and not page.runs:
                page.names[0] += " " + rest
                if tag == "html":
                    continue
            page.tag.append(tag)
            page.parent.append(stack[-1])
            page.names.append(rest)
            stack.append(len(page.tag) - 1)
    flush()
    return page


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    own, chars, links, sentence = [0] * n, [0] * n, [0] * n, [0.0] * n
    for node, text, linked in page.runs:
        own[node] += len(text)
        chars[node] += len(text)
        links[node] += linked
        if text[-1] in ".!?…" or ". " in text:
            sentence[node] = 1.0
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        chars[up] += chars[node]
        links[up] += links[node]
    place = {name: i for i, name in enumerate(FEATURES)}
    out, article = np.zeros((n, len(FEATURES))), [False] * n
    for node in range(n):
        row = out[node]
        group = _GROUP_OF.get(page.tag[node], "other")
        article[node] = group == "article" or node > 0 and article[page.parent[node]]
        # The head of an article is no page header, whatever its names are.
        headline = group == "header" and article[node]
        row[place["other" if headline else group]] = 1.0
        bad, good = (False, False) if headline else named(page.names[node])
        row[place["bad"]], row[place["good"]] = bad, good and not bad
        if chars[node] and links[node] > 0.5 * chars[node]:
            row[place["links"]] = 1.0
        if own[node]:
            row[place["short" if own[node] < 30 else "medium" if own[node] < 120 else "long"]] = 1.0
            row[place["sentence"]] = sentence[node]
        else:
            row[place["inner"]] = 1.0
        row[place["bias"]] = 1.0
    return out


def named(attributes: str) -> tuple[bool, bool]:
    """Whether an element's names are those of page furniture, of an article."""
    if not attributes.strip():
        return False, False
    parts = {p.lower() for m in _NAMES.finditer(attributes) for p in _PARTS.findall(m[2] or m[3] or m[4] or "")}
    return bool(parts & BAD_NAMES) or bool(_HIDDEN.search(attributes)), bool(parts & GOOD_NAMES)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    #: log potentials [region or not][parent][child]
    ties: np.ndarray


def _log_ties(counts: np.ndarray) -> np.ndarray:
    """log P(child | parent) - log P(child): what the parent adds to the child's own score."""
    given = counts / counts.sum(axis=2, keepdims=True)
    alone = counts.sum(axis=1) / counts.sum(axis=(1, 2))[:, None]
    return np.log(given) - np.log(alone)[:, None, :]


def is_region(page: Page, node: int) -> bool:
    return page.tag[node] in REGIONS or any(named(page.names[node]))


def marginals(page: Page, model: Model) -> list[float]:
    """P(content) of every node, by messages to the root and back; exact, as the graph is a tree."""
    score = (features(page) @ model.weights).tolist()
    n = len(score)
    ties = [model.ties[1 if is_region(page, i) else 0].tolist() for i in range(n)]
    # below[i]: log-odds of node i's own potential and its children's messages; sent[i]: message to its parent.
    below, sent = list(score), [0.0] * n
    for i in range(n - 1, 0, -1):
        t, b = ties[i], below[i]
        sent[i] = _log_sum(t[1][0], t[1][1] + b) - _log_sum(t[0][0], t[0][1] + b)
        below[page.parent[i]] += sent[i]
    belief = list(below)
    for i in range(1, n):
        t, up = ties[i], belief[page.parent[i]] - sent[i]
        belief[i] = below[i] + _log_sum(t[0][1], t[1][1] + up) - _log_sum(t[0][0], t[1][0] + up)
    return [1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, x)))) for x in belief]


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def text_of(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = parsed(source)
    if not page.runs:
        return ""
    p = marginals(page, model)
    return "\n".join(text for node, text, _ in page.runs if p[node] >= 0.5)


def labelled_nodes(page: Page, document: str) -> tuple[np.ndarray, float]:
    """1, 0 or -1 (no text) for each node, and the share of the page's text that is in the document."""
    n = len(page.tag)
    whole = " ".join(document.split())
    lines = {" ".join(line.split()) for line in document.split("\n")}
    chars, hits = [0] * n, [0] * n
    for node, text, _ in page.runs:
        chars[node] += len(text)
        hits[node] += len(text) * (text in lines or len(text) >= CHANCE_CHARS and text in whole)
    for node in range(n - 1, 0, -1):
        chars[page.parent[node]] += chars[node]
        hits[page.parent[node]] += hits[node]
    y = np.array([-1 if not c else int(2 * h >= c) for c, h in zip(chars, hits, strict=True)])
    return y, hits[0] / chars[0] if chars[0] else 0.0


def fitted(examples: list[tuple[str, str]]) -> Model:
    """Weights at the posterior mode by gradient steps, ties from counts; examples are (html, document)."""
    prior = np.array([PRIOR.get(f, 0.0) for f in FEATURES])
    counts = np.array([PLAIN_COUNTS, REGION_COUNTS])
    xs, ys = [], []
    for source, document in examples:
        page = parsed(source)
        y, share = labelled_nodes(page, document)
        if share < MIN_LABELLED:
            continue
        xs.append(features(page)[y >= 0])
        ys.append(y[y >= 0])
        for i in range(1, len(y)):
            if y[i] >= 0:
                counts[int(is_region(page, i)), y[page.parent[i]], y[i]] += 1
    weights = prior.copy()
    if xs:
        x, y = np.concatenate(xs), np.concatenate(ys)
        rate = 4.0 / (0.25 * np.linalg.eigvalsh(x.T @ x / len(y))[-1] * 4 + PRIOR_STRENGTH / len(y))
        for _ in range(STEPS):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -60, 60)))
            weights -= 0.25 * rate * (x.T @ (p - y) / len(y) + PRIOR_STRENGTH * (weights - prior) / len(y))
    return Model(weights, _log_ties(counts))


def train(pages: DataFrame, documents: DataFrame, sample: int = TRAIN_PAGES) -> Model:
    """A model from pages whose path ends in the number of their document."""
    number = F.regexp_extract(F.col("url"), r"/(\d{1,18})(?:/|\.html?)?(?:[?#].*)?$", 1).try_cast("long")
    usable = pages.select("page_id", number.alias("doc_id"), F.char_length("html").alias("n")).where(f"doc_id IS NOT NULL AND n <= {TRAIN_CHARS}")
    # At most ``sample`` rows, so they go to every executor and then to the driver.
    chosen = usable.select("page_id", "doc_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    found = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id")
    texts = documents.select("doc_id", "text").where(f"char_length(text) <= {TRAIN_CHARS}")
    rows = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").limit(2 * sample).collect()
    known = {r.doc_id: r.text for r in rows}
    return fitted([(r.html, known[r.doc_id]) for r in found.orderBy("page_id").limit(2 * sample).collect() if r.doc_id in known])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                texts = [text_of(source, model) for source in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
