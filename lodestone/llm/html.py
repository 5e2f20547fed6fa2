"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a lenient DOM."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map
from lodestone.llm.html_samples import sample_pages

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and those of them that reach to the page's end where their end tag is missing.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
TO_THE_END = frozenset("script style".split())
#: Elements whose content isn't part of the text, and those of them that a block's start tag ends.
UNSEEN = frozenset("noscript template svg object canvas select annotation annotation-xml".split())
BROKEN_OFF = ("select", "svg")
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of the same kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr"), "thead": ("tbody",), "tfoot": ("tbody", "thead", "tr")}
#: An implied end doesn't reach beyond these.
BARRIER = frozenset("ul ol dl table article section div body nav aside main header footer form html".split())

TAGS = "article main nav header footer aside form table ul ol li section figure figcaption blockquote pre h1 h2 h3 h4 p a button label address dl div td details dialog fieldset".split()
#: Parts of class names, ids and roles, by what they tell.
NAMES: dict[str, str] = {
    "menu": r"nav|menu|breadcrumb|topbar|toolbar|pagination|pager",
    "head": r"head|masthead|banner|branding|logo",
    "foot": r"foot|copyright|colophon|contentinfo|legal",
    "side": r"side|widget|related|recommend|complementary|popular|trending|tags?(?![a-z])|more-",
    "advert": r"(?<![a-z])ads?(?![a-z])|advert|sponsor|promo|outbrain|taboola|adslot|teaser",
    "notice": r"cookie|consent|gdpr|notice|alert|modal|popup|overlay|paywall|toast|warning",
    "comment": r"comment|repl(?:y|ies)|respon[ds]|disqus|kommentar|reviews?(?![a-z])|discussion|guestbook",
    "form": r"form|subscri|newsletter|login|signup|search|contact",
    "share": r"shar(?:e|ing)|social|follow",
    "body": r"content|article|post(?![a-z]*er)|entry|story|body|main|text|prose",
    "hidden": r"hidden|sr-only|display: ?none|visually",
    "meta": r"byline|author|meta|date|caption|credit",
}
_NAMES = [re.compile(p) for p in NAMES.values()]
_TAG_BIT = {t: 1 << k for k, t in enumerate(TAGS)}
_NAME_BIT = [1 << (len(TAGS) + k) for k in range(len(NAMES))]
BITS = len(TAGS) + len(NAMES)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
_SENTENCE = re.compile(r"[.!?…。][\"'”’)»]*$")
_LEGAL = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie", re.I)
_BARS = re.compile(r"[|·•»›]")
_DIGIT = re.compile(r"\d")

_named: dict[str, int] = {}


def _name_bits(attributes: str) -> int:
    """Bits of what an element's names tell; kept for the attribute strings that repeat."""
    bits = _named.get(attributes)
    if bits is None:
        bits = 0
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or "").strip("\"'")
            value = value.lower()
            if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
                value = "hidden"
            if kind == "style" and "none" not in value:
                continue
            if kind == "role":
                value = {"navigation": "nav", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "dialog": "modal"}.get(value, value)
            for bit, pattern in zip(_NAME_BIT, _NAMES, strict=True):
                if pattern.search(value):
                    bits |= bit
        if len(_named) > 20_000:
            _named.clear()
        _named[attributes] = bits
    return bits


@dataclass
class Blocks:
    """Leaf blocks of a page in order: text, ancestor bits, innermost block tag's bit, characters inside links."""

    text: list[str] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def leaf_blocks(page: str) -> Blocks:
    """Splits a page at its block elements.  Scripts, styles, comments and the like are gone, references decoded, white
    space within a block is one space.  Missing end tags end where the next one implies it.

    An element whose content isn't shown ends with its parent at the latest, and one without any end tag further on
    hides nothing; of raw elements only a script or a style without one takes the rest of the page.
    """
    out, stack, open_ = Blocks(), [], {}
    unclosed: set[str] = set()
    parts: list[str] = []
    linked = 0
    bits, own, links, unseen = 0, 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.text.append(text)
                out.bits.append(bits)
                out.own.append(own)
                out.linked.append(linked)
            parts, linked = [], 0

    def pop() -> None:
        nonlocal bits, own, links, unseen
        tag, bits, own, links, unseen = stack.pop()
        open_[tag] -= 1

    def closing(tag: str) -> re.Match | None:
        """The next end tag, unless another element of the kind begins before it; that there is none is looked up once."""
        found = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
        if not found:
            unclosed.add(tag)
        elif tag not in TO_THE_END and re.compile(rf"<{tag}[\s/>]", re.I).search(page, at, found.start()):
            return None
        return found

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        lo = m.start() if m else end
        if lo > at and not unseen:
            parts.append(page[at:lo])
            if links:
                linked += lo - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in RAW and not m[3].endswith("/"):
                close = closing(tag)
                at = close.end() if close else end if tag in TO_THE_END else at
                continue
            if tag in UNSEEN and (m[3].endswith("/") or not closing(tag)):
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    parts.append(" " if tag in ("br", "wbr", "img", "input") else "")
                continue
            if tag in BLOCK:
                for other in BROKEN_OFF:
                    while open_.get(other) and tag not in ("option", "optgroup", "hr"):
                        pop()
                flush()
                if open_.get("p") and not unseen and tag not in ("button", "label"):
                    while open_["p"]:
                        pop()
                for other in CLOSES.get(tag, ()) if not unseen else ():
                    if open_.get(other):
                        for k in range(len(stack) - 1, -1, -1):
                            name = stack[k][0]
                            if name == other:
                                while len(stack) > k:
                                    pop()
                                break
                            if name in BARRIER:
                                break
            if m[3].endswith("/") and tag not in BLOCK:
                continue
            if tag == "select":
                flush()
            stack.append((tag, bits, own, links, unseen))
            open_[tag] = open_.get(tag, 0) + 1
            bits |= _TAG_BIT.get(tag, 0) | (_name_bits(m[3]) if m[3] else 0)
            if tag in BLOCK:
                own = _TAG_BIT.get(tag, 0)
            links += tag == "a"
            unseen += tag in UNSEEN
        elif open_.get(tag):
            if tag in BLOCK:
                flush()
            while open_[tag]:
                name = stack[-1][0]
                pop()
                if name == tag:
                    break
        elif tag in BLOCK:
            flush()
    flush()
    return out


_LENGTHS = np.array([15, 30, 60, 100, 160, 260, 400])
_SHAPES = ("ends like a sentence", "legal", "bars", "mostly capitalised", "has digits", "commas", "linked a little", "linked a lot", "all linked", "first", "second", "last", "same tag as before", "same tag as after", "long unlinked before", "long unlinked after", "short before", "short after", "link before", "link after")
_ARTICLE = _TAG_BIT["article"] | _TAG_BIT["main"] | _NAME_BIT[list(NAMES).index("body")]
#: Columns of the feature matrix: bias, ancestors, ancestors within an article, own tag, length, shapes.
WIDTH = 1 + BITS + BITS + len(TAGS) + len(_LENGTHS) + 1 + len(_SHAPES)


def features(pages: list[Blocks]) -> tuple[np.ndarray, np.ndarray]:
    """Binary features of all blocks of some pages, and where each page begins."""
    counts = np.array([len(p.text) for p in pages])
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = int(starts[-1])
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out, starts
    text = [t for p in pages for t in p.text]
    bits = np.array([b for p in pages for b in p.bits], np.int64)
    own = np.array([b for p in pages for b in p.own], np.int64)
    size = np.array([len(t) for t in text])
    share = np.array([k for p in pages for k in p.linked]) / np.maximum(size, 1)
    at = 1
    out[:, 0] = 1
    unpacked = (bits[:, None] >> np.arange(BITS)) & 1
    out[:, at : at + BITS] = unpacked
    at += BITS
    out[:, at : at + BITS] = unpacked * ((bits & _ARTICLE) != 0)[:, None]
    at += BITS
    out[:, at : at + len(TAGS)] = (own[:, None] >> np.arange(len(TAGS))) & 1
    at += len(TAGS)
    out[np.arange(n), at + np.searchsorted(_LENGTHS, size)] = 1
    at += len(_LENGTHS) + 1
    page = np.repeat(np.arange(len(pages)), counts)
    first, last = np.concatenate([[True], page[1:] != page[:-1]]), np.concatenate([page[1:] != page[:-1], [True]])

    def before(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[False], x[:-1]]) & ~first

    def after(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[1:], [False]]) & ~last

    words = [t.split() for t in text]
    plain, short, link = (size > 80) & (share < 0.3), size < 30, share > 0.6
    shapes = [
        np.array([bool(_SENTENCE.search(t[-8:])) for t in text]), np.array([bool(_LEGAL.search(t)) for t in text]), np.array([bool(_BARS.search(t)) for t in text]),
        np.array([sum(w[0].isupper() for w in ws) > 0.6 * len(ws) for ws in words]), np.array([bool(_DIGIT.search(t)) for t in text]), np.array(["," in t for t in text]),
        (share > 0) & (share <= 0.3), (share > 0.3) & (share <= 0.8), share > 0.8, first, before(first), last,
        before(np.append(own[1:] == own[:-1], False)), after(np.insert(own[1:] == own[:-1], 0, False)), before(plain), after(plain), before(short), after(short), before(link), after(link),
    ]
    out[:, at:] = np.stack(shapes, 1)
    return out, starts


@dataclass
class ChainModel:
    """State weights (features by label) and transition weights (label by label); label 1 is main text."""

    state: np.ndarray
    step: np.ndarray


def viterbi(score: np.ndarray, step: np.ndarray) -> list[int]:
    """The labels whose states and transitions add up to most."""
    (s00, s01), (s10, s11) = step.tolist()
    back: list[tuple[int, int]] = []
    a, b = 0.0, 0.0
    for k, (x, y) in enumerate(score.tolist()):
        if not k:
            a, b = x, y
            continue
        stay, come = a + s00, b + s10
        go, keep = a + s01, b + s11
        back.append((int(come > stay), int(keep >= go)))
        a, b = max(stay, come) + x, max(go, keep) + y
    label = [int(b > a)] if len(score) else []
    for pair in reversed(back):
        label.append(pair[label[-1]])
    return label[::-1]


_models: dict[tuple[int, int], ChainModel] = {}


def train(pages: int = 500, seed: int = 5, steps: int = 150, l2: float = 2e-4) -> ChainModel:
    """Fits the chain on labelled sample pages by the gradient of their conditional log likelihood (forward-backward)."""
    if (pages, seed) in _models:
        return _models[pages, seed]
    blocks, labels = [], []
    for page, main in sample_pages(pages, seed):
        found = leaf_blocks(page)
        if found.text:
            blocks.append(found)
            labels.append([int(t in main) for t in found.text])
    order = sorted(range(len(blocks)), key=lambda k: -len(labels[k]))  # longest first, so those still open come first
    blocks, labels = [blocks[k] for k in order], [labels[k] for k in order]
    x, starts = features(blocks)
    y = np.concatenate(labels)
    rows, length = len(blocks), np.diff(starts)
    most = int(length.max())
    page = np.repeat(np.arange(rows), length)
    place = np.arange(len(y)) - starts[page]
    open_ = [int((length > t).sum()) for t in range(most)]
    target = np.eye(2)[y]
    pair = np.zeros((2, 2))
    inner = place > 0
    np.add.at(pair, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    state, step = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    m = v = np.zeros(WIDTH * 2 + 4)
    for k in range(1, steps + 1):
        score = np.zeros((rows, most, 2))
        score[page, place] = x @ state
        fore, aft = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = score[:, 0]
        for t in range(1, most):
            on, was = slice(0, open_[t]), fore[: open_[t], t - 1]
            fore[on, t] = score[on, t] + np.logaddexp(was[:, :1] + step[0], was[:, 1:] + step[1])
        for t in range(most - 2, -1, -1):
            here = score[: open_[t + 1], t + 1] + aft[: open_[t + 1], t + 1]
            aft[: open_[t + 1], t] = np.logaddexp(step[:, 0] + here[:, :1], step[:, 1] + here[:, 1:])
        end = fore[np.arange(rows), length - 1]
        total = np.logaddexp(end[:, 0], end[:, 1])
        belief = np.exp(fore[page, place] + aft[page, place] - total[page, None])
        joint = np.zeros((2, 2))
        for t in range(1, most):
            on = slice(0, open_[t])
            log = fore[on, t - 1][:, :, None] + step[None] + (score[on, t] + aft[on, t])[:, None, :] - total[on][:, None, None]
            joint += np.exp(log).sum(0)
        gradient = np.concatenate([(x.T @ (belief - target)).ravel(), (joint - pair).ravel()]) / len(y) + l2 * np.concatenate([state.ravel(), step.ravel()])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.08 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        state, step = state - move[: WIDTH * 2].reshape(WIDTH, 2), step - move[WIDTH * 2 :].reshape(2, 2)
    _models[pages, seed] = ChainModel(state, step)
    return _models[pages, seed]


def main_texts(pages: list[str | None], model: ChainModel) -> list[str]:
    """The main text of each page: its blocks of label 1, one to a line."""
    blocks = [leaf_blocks(p or "") for p in pages]
    x, starts = features(blocks)
    score = x.astype(np.float64) @ model.state
    out = []
    for page, lo, hi in zip(blocks, starts[:-1], starts[1:], strict=True):
        out.append("\n".join(t for t, label in zip(page.text, viterbi(score[lo:hi], model.step), strict=True) if label))
    return out


def extract_main_text(pages: DataFrame, model: ChainModel | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).  No shuffle; whole pages.

    A null or empty page, or one without main text, has an empty text; repeated rows give repeated results.  The broadcast model has WIDTH * 2 + 4 numbers.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text: list[str] = []
            for lo in range(0, batch.num_rows, 200):
                text += main_texts(batch.column(2).slice(lo, 200).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return arrow_map(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html")), work, f"page_id {types[key]}, url {types[url]}, text string, n_chars long")
