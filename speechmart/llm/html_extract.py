"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Every block is described
by its ancestors' tags and name words and by its text; a two-state chain (article or other), trained
on labelled pages, is decoded by Viterbi over all blocks of the page. The training pages come from
``labelled_pages``, a seeded generator of page layouts with known labels; they are a fixed, small set
and independent of the tables.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by one newline in page order. A line break tag counts as white space. Scripts and styles are
dropped as such, whatever is in them; all other elements' texts are judged by the chain. Null and empty
pages give an empty text; broken markup is read as far as it goes, in work linear in the page; nothing is
cut off; of equally likely states the block counts as no article; repeated rows give repeated results; an
empty table gives an empty result; columns other than the three named are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices

#: Tags that end a leaf block where they open or close.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol optgroup option p pre section"
    " select summary table tbody td textarea tfoot th thead title tr ul video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Contents that are no text of the page.
RAW = frozenset("script style".split())
#: A new start of the first kind ends an open element of the second.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSES_P = BLOCK - {"button", "label", "option", "optgroup", "body", "html", "head", "title"}
#: Elements that such a start does not look beyond.
_SCOPE = frozenset("table ul ol div article section aside nav form body main footer header".split())
_STRUCTURE = frozenset(f"tag={t}" for t in ("article", "main", "aside", "nav", "footer", "header", "form", "section", "title"))
_INSIDE = frozenset(("tag=article", "tag=main", "name=main", "name=content", "name=article", "name=post", "name=entry", "name=story"))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)|[^<]+|<", re.S)
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` has its closing bracket; the page's end if it has none.

    A quote holds brackets only as the first character of a value, and only if it is closed.
    """
    n = len(page)
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        at = m.end()
        if page[before] == "=" and (close := page.find(m[0], at)) >= 0:
            at = close + 1
    return n


class Names:
    """A name among the ancestors of a block, behind those of the elements further out; each name stands once.

    Blocks share these chains, so that a deep page takes no more room than its tags.
    """

    __slots__ = ("outer", "name", "near", "inside", "inward", "score")

    def __init__(self, outer: Names | None, name: str) -> None:
        self.outer, self.name = outer, name
        self.near = name if name.startswith("name=") or name in _STRUCTURE else outer.near if outer else ""
        self.inside = name in _INSIDE or bool(outer and outer.inside)
        self.inward = "article" in name or "main" in name or bool(outer and outer.inward)
        self.score: tuple | None = None

    def __iter__(self) -> Iterator[str]:
        at: Names | None = self
        while at is not None:
            yield at.name
            at = at.outer


class Open:
    """The open elements, with what is asked of them kept up to date."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []
        #: Per element the chain up to it and the names that it brought.
        self.chains: list[tuple[Names | None, list[str]]] = []
        self.held: set[str] = set()

    @property
    def names(self) -> Names | None:
        return self.chains[-1][0] if self.chains else None

    def push(self, tag: str, names: list[str]) -> None:
        chain, brought = self.names, []
        for name in names:
            if name not in self.held:
                self.held.add(name)
                brought.append(name)
                chain = Names(chain, name)
        at = len(self.tags)
        self.tags.append(tag)
        self.chains.append((chain, brought))
        self.places.setdefault(tag, []).append(at)
        if tag in _SCOPE:
            self.scopes.append(at)
        if tag in BLOCK:
            self.blocks.append(at)

    def close(self, tags: tuple[str, ...], within_scope: bool) -> None:
        """Ends the innermost element of these tags and all in it, unless a scope stands between."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if at < 0 or within_scope and self.scopes and self.scopes[-1] > at:
            return
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.held.difference_update(self.chains.pop()[1])
            self.places[tag].pop()
            for held in (self.scopes, self.blocks):
                if held and held[-1] == len(self.tags):
                    held.pop()

    def inside(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def leaf(self) -> str | None:
        """The innermost block-level tag, empty without one; None where nothing is open."""
        return None if not self.tags else self.tags[self.blocks[-1]] if self.blocks else ""


#: Text of a leaf block, its ancestors' names, its innermost block-level tag, characters inside links.
Block = tuple[str, "Names | None", "str | None", int]


def leaf_blocks(page: str) -> list[Block]:
    """Every leaf block in page order, in work linear in the page."""
    out: list[Block] = []
    opened, text, link = Open(), [], 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal link
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                out.append((whole, opened.names, opened.leaf(), link))
        link = 0

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if opened.inside("a"):
                    link += len(piece)
            continue
        tag, end = tag.lower(), _tag_end(page, at)
        attributes, at = page[at:end], min(n, end + 1)
        if m[1]:
            if tag in BLOCK:
                flush()
            opened.close((tag,), False)
            if tag == "br":
                text.append(" ")
            continue
        if tag in RAW:  # a slash does not end it
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = found.end() if found else n
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P:
                opened.close(("p",), True)
            if tag in _ENDS:
                opened.close(_ENDS[tag], True)
        if tag == "br":
            text.append(" ")
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        names = [f"tag={tag}"] if tag in BLOCK or tag == "a" else []
        if attributes:
            for found in _NAMES.finditer(attributes):
                names += [f"name={w}" for w in _WORD.findall((found[1] or found[2] or found[3] or "").lower())]
            if _HIDDEN.search(attributes):
                names.append("hidden")
        opened.push(tag, names)
    flush()
    return out


class Features:
    """Feature names of a block: its own, and the shared chain of its ancestors'."""

    __slots__ = ("own", "chain")

    def __init__(self, own: list[str], chain: Names | None) -> None:
        self.own, self.chain = own, chain

    def __iter__(self) -> Iterator[str]:
        yield from self.own
        if self.chain is not None:
            yield from self.chain


def block_features(blocks: list[Block]) -> list[Features]:
    """Features of every block, with a glance at its place in the page."""
    out = []
    for k, (text, names, leaf, link) in enumerate(blocks):
        words = text.count(" ") + 1
        size = 0 if words < 3 else 1 if words < 8 else 2 if words < 25 else 3
        f = ["bias", f"size={size}"]
        if leaf is not None:
            f.append(f"leaf={leaf}")
        f.append("first" if k == 0 else "last" if k == len(blocks) - 1 else "middle")
        f.append(f"links={min(3, 4 * link // max(1, len(text)))}")
        f.append("stop" if text[-1] in ".!?…\"”»" else "open")
        if "©" in text or "All rights reserved" in text:
            f.append("copyright")
        if not (names and names.inward) and leaf not in ("article", "main"):
            f.append("outside")
        f.append(f"near={names.near if names else ''}")
        if names and names.inside:
            f.append("inside")
        out.append(Features(f, names))
    return out


class Crf:
    """Two-state linear chain: weights per feature and state, and between states."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.emit = np.zeros((0, 2))
        self.step = np.zeros((2, 2))

    def scores(self, features: list[Features] | list[list[str]]) -> np.ndarray:
        """Summed weights per block and state; unknown features count nothing. A chain's sum is made once for all its blocks."""
        weights = {name: tuple(self.emit[i].tolist()) for name, i in self.index.items()}
        none = (0.0, 0.0)

        def chained(chain: Names | None) -> tuple[float, float]:
            todo = []
            while chain is not None and chain.score is None:
                todo.append(chain)
                chain = chain.outer
            total = none if chain is None else chain.score
            for link in reversed(todo):
                w = weights.get(link.name, none)
                total = link.score = total[0] + w[0], total[1] + w[1]
            return total

        out = []
        for f in features:
            own, (x, y) = (f.own, chained(f.chain)) if isinstance(f, Features) else (f, none)
            for w in own:
                a, b = weights.get(w, none)
                x, y = x + a, y + b
            out.append((x, y))
        return np.array(out).reshape(-1, 2)

    def fit(self, pages: list[tuple[list[Features] | list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Crf:
        """Maximises the conditional likelihood by AdaGrad over the pages."""
        for features, _ in pages:
            for f in features:
                for name in f:
                    self.index.setdefault(name, len(self.index))
        self.emit = np.zeros((len(self.index), 2))
        seen_e, seen_s = np.full_like(self.emit, 1e-3), np.full_like(self.step, 1e-3)
        rng = random.Random(5)
        coded = [([[self.index[n] for n in f] for f in features], labels) for features, labels in pages if features]
        for _ in range(epochs):
            rng.shuffle(coded)
            for rows, labels in coded:
                e = np.array([self.emit[r].sum(axis=0) for r in rows])
                node, edge = self._marginals(e)
                node[np.arange(len(rows)), labels] -= 1
                for a, b in zip(labels, labels[1:], strict=False):
                    edge[a, b] -= 1
                g = np.zeros_like(self.emit)
                for r, d in zip(rows, node, strict=True):
                    g[r] += d
                g += decay * self.emit
                seen_e += g * g
                seen_s += edge * edge
                self.emit -= rate * g / np.sqrt(seen_e)
                self.step -= rate * edge / np.sqrt(seen_s)
        return self

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(e)
        fore, back = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = e[0]
        for k in range(1, n):
            fore[k] = e[k] + np.logaddexp(*(fore[k - 1][:, None] + self.step))
        for k in range(n - 2, -1, -1):
            back[k] = np.logaddexp(*(self.step + (e[k + 1] + back[k + 1])[None, :]).T)
        z = np.logaddexp(*fore[-1])
        edge = np.zeros((2, 2))
        for k in range(n - 1):
            edge += np.exp(fore[k][:, None] + self.step + (e[k + 1] + back[k + 1])[None, :] - z)
        return np.exp(fore + back - z), edge

    def decode(self, features: list[Features] | list[list[str]]) -> list[int]:
        """The best state of every block, by Viterbi."""
        if not features:
            return []
        e = self.scores(features).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = e[0]
        came: list[tuple[int, int]] = []
        for x, y in e[1:]:
            from_a, from_b = int(b + s10 > a + s00), int(b + s11 > a + s01)
            a, b = x + max(a + s00, b + s10), y + max(a + s01, b + s11)
            came.append((from_a, from_b))
        at = int(b > a)
        out = [at]
        for pair in reversed(came):
            at = pair[at]
            out.append(at)
        return out[::-1]


#: Marks article text in generated pages; a private-use character.
_MARK = "\ue000"


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Generated pages as leaf blocks with labels, 1 for the article."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        blocks = leaf_blocks(_page(rng))
        labels = [int(_MARK in b[0]) for b in blocks]
        out.append(([(b[0].replace(_MARK, ""), *b[1:]) for b in blocks], labels))
    return out


def _words(rng: random.Random, low: int, high: int) -> str:
    parts = "ka to mi ren sol ul est nar ive der lo qua pen tri sa mor el ni".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))


def _sentence(rng: random.Random, low: int = 1, high: int = 30) -> str:
    return _words(rng, low, high).capitalize() + rng.choice([".", ".", ".", "!", "?", "", " &amp;", "***"])


def _page(rng: random.Random) -> str:
    pick_one, chance = rng.choice, rng.random

    def main(low: int, high: int) -> str:
        return _MARK + _sentence(rng, low, high)

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{_words(rng, 1, 1)}">{_words(rng, 1, 2)}</a></li>' for _ in range(k))

    def paragraph() -> str:
        text = " ".join(main(1, 40) for _ in range(rng.randint(1, 5)))
        kind = chance()
        if kind < 0.1:
            return f"<p><b>{text}<br>"
        if kind < 0.15:
            return f"<p>{text} <a href='/x'>{_words(rng, 1, 3)}</a> {_words(rng, 1, 5)}.</p>"
        if kind < 0.2:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.25:
            return "<ul>" + "".join(f"<li>{main(2, 12)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>"
        if kind < 0.28:
            return f"<h2>{main(1, 5)}</h2><p>{text}</p>"
        if kind < 0.31:
            return f"<div>{text}</div>"
        if kind < 0.33:
            return f"<table><tr><td>{main(1, 4)}</td><td>{main(1, 4)}</td></tr></table>"
        return f"<p>{text}</p>" if chance() < 0.9 else f"<p>{text}"

    def advert() -> str:
        name = pick_one(["ad", "ads", "advert", "advertisement", "promo", "sponsored", "ad-banner", "banner", "ad-slot"])
        tag = pick_one(["div", "div", "aside", "section", "p"])
        return f'<{tag} class="{name}">{_sentence(rng)}</{tag}>'

    def notice() -> str:
        name = pick_one(["cookie", "cookie-notice", "notice", "alert", "consent", "gdpr-banner", "popup", "newsletter", "subscribe", "modal", "message", "warning", "paywall"])
        tag = pick_one(["div", "div", "section", "aside"])
        return f'<{tag} {pick_one(["class", "id"])}="{name}"><p>{_sentence(rng)}</p>' + pick_one(["", "<button>OK</button>"]) + f"</{tag}>"

    def sidebar() -> str:
        name = pick_one(["sidebar", "related", "widget", "side", "recommended", "more", "popular", "trending", "share", "social", "tags", "author-bio", "breadcrumb"])
        body = pick_one([f"<h3>{_words(rng, 1, 3)}</h3><ul>{links(3)}</ul>", f"<p>{_sentence(rng)}</p>", f"<h3>{_words(rng, 1, 3)}</h3><p>{_sentence(rng)}</p>"])
        return pick_one([f"<aside>{body}</aside>", f'<aside class="{name}">{body}</aside>', f'<div class="{name}">{body}</div>', f'<div id="{name}">{body}</div>', f'<section class="{name}">{body}</section>'])

    def comments() -> str:
        one = pick_one(["comment", "reply", "user-comment", "review"])
        body = "".join(f'<div class="{one}"><p>{_sentence(rng)}</p></div>' if chance() < 0.6 else f"<li><p>{_sentence(rng)}</p></li>" for _ in range(rng.randint(1, 4)))
        name = pick_one(["comments", "comment-list", "discussion", "disqus-thread", "responses", "replies"])
        tag = pick_one(["section", "div", "ol"])
        return f'<{tag} {pick_one(["class", "id"])}="{name}">' + pick_one(["", f"<h3>{_words(rng, 1, 2)}</h3>"]) + body + f"</{tag}>"

    def form() -> str:
        return f'<form action="/s"><label>{_words(rng, 1, 3)}</label><input name=q>' + pick_one(["", f"<p>{_sentence(rng)}</p>", f"<select><option>{_words(rng, 1, 1)}<option>{_words(rng, 1, 1)}</select>"]) + f"<button>{_words(rng, 1, 2)}</button></form>"

    def menu() -> str:
        k = rng.randint(2, 8)
        return pick_one([f"<nav><ul>{links(k)}</ul></nav>", f"<nav>{links(k)}</nav>", f'<div class="{pick_one(["menu", "nav", "navbar", "navigation", "topnav"])}"><ul>{links(k)}</ul></div>', f'<ul class="{pick_one(["menu", "nav"])}">{links(k)}</ul>', f'<div role="navigation">{links(k)}</div>'])

    def header() -> str:
        body = pick_one([f"<h1>{_words(rng, 1, 3)}</h1>", f"<p>{_sentence(rng, 1, 8)}</p>", f"<div>{_words(rng, 1, 3)}</div>", menu()])
        return pick_one([f"<header>{body}</header>", f'<div id="{pick_one(["header", "masthead", "top", "branding"])}">{body}</div>', f'<header class="site-header">{body}</header>'])

    def footer() -> str:
        body = pick_one([f"&copy; {_words(rng, 1, 2)} &middot; {_sentence(rng)}", f"<p>{_sentence(rng)}</p>", f"<ul>{links(3)}</ul><p>&copy; 2020 {_words(rng, 1, 2)}</p>"])
        return pick_one([f"<footer>{body}</footer>", f"<footer>{body}</footer>", f'<div class="{pick_one(["footer", "site-footer", "copyright", "legal"])}">{body}</div>'])

    inner = [f"<h1>{main(1, 12)}</h1>"] if chance() < 0.85 else []
    if inner and chance() < 0.1:
        inner = [f"<header>{inner[0]}</header>"]
    for _ in range(rng.randint(1, 12)):
        inner.append(paragraph())
        if chance() < 0.08:
            inner.append(pick_one([advert, sidebar, notice, form, comments])())
    if chance() < 0.1:
        inner.append(comments())
    name = pick_one(["content", "post", "entry", "article", "story", "post-content", "entry-content", "article-body", "main", "main-content", "text"])
    body = "".join(inner)
    tag = pick_one(["article", "article", "article", "main", "div", "section"])
    attrs = f' class="{name}"' if tag in ("div", "section") or chance() < 0.3 else ""
    if tag == "div" and chance() < 0.3:  # a container whose name tells nothing, or none
        attrs = pick_one(["", f' class="{_words(rng, 1, 1)}"'])
    article = f"<{tag}{attrs}>{body}</{tag}>"
    if chance() < 0.25:
        outer = pick_one(["main", "div"])
        more = pick_one(["", advert(), sidebar(), comments()])
        article = f'<{outer} id="{pick_one(["main", "content", "page", "wrapper"])}">{article}{more}</{outer}>'
    before = [f() for f in (header, menu, notice, advert, form, sidebar) if chance() < 0.45]
    after = [f() for f in (comments, sidebar, form, notice, advert, menu) if chance() < 0.35]
    rng.shuffle(after)
    head = f"<!DOCTYPE html><html><head><title>{_sentence(rng)}</title><style>p{{}}</style></head><body>"
    return head + "".join(before) + article + "".join(after) + (footer() if chance() < 0.85 else "") + pick_one(["", "</body></html>"])


_TRAINED: list[Crf] = []


def trained() -> Crf:
    """The model fitted on the labelled pages, once per driver process."""
    if not _TRAINED:
        _TRAINED.append(Crf().fit([(block_features(b), y) for b, y in labelled_pages()]))
    return _TRAINED[0]


def main_text(page: str | None, model: Crf) -> str:
    """The article's blocks of one page, joined by newlines."""
    blocks = leaf_blocks(page or "")
    states = model.decode(block_features(blocks))
    return "\n".join(b[0] for b, s in zip(blocks, states, strict=True) if s)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    d = pick(pages, [id_col, url_col, html_col])
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [main_text(p, model.value) for p in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, url_col, "text", "n_chars"])

    kinds = [d.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return d.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
