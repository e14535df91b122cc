"""Main text of web pages: gradient-boosted trees over DOM-node features, then hierarchical decoding.

Every block element is scored from its tag, attribute words, depth, siblings and the density of its subtree. The
decoding keeps the set of nodes with the largest sum of scores in which a kept node's ancestors are all kept, so no
text survives inside a node that is dropped. The trees are trained here, on pages that this module writes itself
from a seed, with every part known to be article or not; no page of the input is learned from.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, workers
from .html_tree import Page

_TAGS = (("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button"), ("article", "main"), ("section", "div", "center"), ("p",), tuple(f"h{i}" for i in range(1, 7)), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("html", "body", "#page"))
_TAG = {t: i for i, ts in enumerate(_TAGS) for t in ts}
#: Words in class, id and role, by what they tell.
_WORDS = (
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs skip toolbar topbar".split(),
    "header masthead banner logo branding hero".split(),
    "footer copyright legal bottom colophon imprint".split(),
    "sidebar aside side rail widget widgets related recommended recommendations popular trending more archive tags tagcloud".split(),
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense outbrain taboola".split(),
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall disclaimer privacy".split(),
    "comment comments disqus reply replies respond discussion thread reader readers feedback".split(),
    "form search login signup subscribe subscription newsletter share sharing social follow buttons contact".split(),
    "article content post entry story main body text prose page".split(),
)
_WORD = {w: i for i, ws in enumerate(_WORDS) for w in ws}
_N_TAG, _N_WORD = len(_TAGS) + 1, len(_WORDS)
N_FEATURES = _N_TAG + 3 * _N_WORD + 18


def features(page: Page) -> np.ndarray:
    """A row for each node of the page."""
    n = len(page.tag)
    parent = page.parent
    sub = [page.chars[:], page.link_chars[:], page.words[:], page.marks[:], page.inputs[:], page.inner[:], [1] * n, [t == "p" for t in page.tag]]
    children, place = [0] * n, [0] * n
    for i in range(1, n):
        place[i] = children[parent[i]]
        children[parent[i]] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for s in sub:
            s[p] += s[i]
    chars, links, words, marks, inputs, inner, nodes, paras = (np.array(s, dtype=float) for s in sub)
    par = np.array([0, *parent[1:]])
    own = np.array(page.chars, dtype=float)
    kids, spot = np.array(children, dtype=float), np.array(place, dtype=float)
    tag = np.array([_TAG.get(t, _N_TAG - 1) for t in page.tag])
    said = np.zeros((n, _N_WORD))
    for i, ws in enumerate(page.attrs):
        for w in ws:
            if w in _WORD:
                said[i, _WORD[w]] = 1
    above = np.zeros((n, _N_WORD))  # of all ancestors
    for i in range(1, n):
        above[i] = np.maximum(above[parent[i]], said[parent[i]]) if parent[i] else said[0]
    below = said.copy()
    for i in range(n - 1, 0, -1):
        np.maximum(below[parent[i]], below[i], out=below[parent[i]])
    whole = max(chars[0], 1.0)
    alike = np.bincount(par * _N_TAG + tag, minlength=n * _N_TAG)[par * _N_TAG + tag]
    x = np.empty((n, N_FEATURES), np.float32)
    x[:, :_N_TAG] = tag[:, None] == np.arange(_N_TAG)
    at = _N_TAG
    for block in (said, above, below):
        x[:, at : at + _N_WORD] = block
        at += _N_WORD
    for col in (
        np.array(page.depth), tag[par], np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), words / nodes, chars / (nodes + inner), marks / np.maximum(words, 1), chars / np.maximum(words, 1), chars / whole,
        np.array(page.start) / whole, np.array(page.end) / whole, kids, spot, alike / np.maximum(kids[par], 1), np.log1p(paras), inputs, chars / np.maximum(chars[par], 1),
    ):
        x[:, at] = col
        at += 1
    return x


@dataclass
class Trees:
    """Trees of one depth as full binary arrays: split feature, split value, and the leaves' values."""

    feature: np.ndarray
    value: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for f, v, leaf in zip(self.feature, self.value, self.leaf):
            k = np.zeros(len(x), np.int64)
            for _ in range(depth):
                k = 2 * k + 1 + (x[rows, f[k]] > v[k])
            out += leaf[k - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Logistic gradient boosting on histograms of quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    n, m = binned.shape
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(n, base)
    inner = (1 << depth) - 1
    feature, value, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        k = np.zeros(n, np.int64)
        for d in range(depth):
            first, many = (1 << d) - 1, 1 << d
            key = ((k - first)[:, None] * m + np.arange(m)) * bins + binned
            gs, hs = (np.bincount(key.ravel(), weights=np.repeat(w, m), minlength=many * m * bins).reshape(many, m, bins).cumsum(axis=2) for w in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < 2) | (ht - hs < 2)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for j, b in enumerate(best):
                if gain[j].ravel()[b] > 1e-6:
                    feat, cut = divmod(int(b), bins)
                    if cut < len(cuts[feat]):
                        feature[t, first + j], value[t, first + j] = feat, cuts[feat][cut]
            k = 2 * k + 1 + (x[np.arange(n), feature[t, k]] > value[t, k])
        k -= inner
        leaf[t] = rate * np.bincount(k, weights=g, minlength=inner + 1) / (np.bincount(k, weights=h, minlength=inner + 1) + ridge)
        f += leaf[t][k]
    return Trees(feature, value.astype(np.float32), leaf, base)


# Training pages


def _letters(rng: np.random.Generator) -> str:
    """Random letters that words are cut from."""
    return "".join(rng.choice(list("aaabcdeeefghiiijklmnnooopprrsssttuuvwyéüß"), 50_000))


def _page(rng: np.random.Generator, letters: str) -> str:
    """A page whose article parts carry the attribute data-keep and whose other parts carry data-drop."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    chance = lambda p: rng.random() < p

    def word() -> str:
        at = int(rng.integers(len(letters) - 12))
        return letters[at : at + int(rng.integers(1, 12))]

    noisy = chance(0.1)

    def said(least: int, most: int) -> str:
        out = [word() for _ in range(rng.integers(least, most + 1))]
        out[0] = out[0].capitalize()
        if noisy:
            out = [w + pick("%%%", "***", "###", "$$$", "&amp;&amp;") for w in out]
        return " ".join(w + pick("", "", "", "", "", ",", "") for w in out).rstrip(",") + pick(".", ".", ".", "", "!")

    def named(*names: str) -> str:
        if chance(0.15):
            return ""
        return f' {pick("class", "class", "id")}="{pick("", "", "site-", "js-", "page_")}{pick(*names)}{pick("", "", "-1", " box", "-wrap")}"'

    def link(least: int = 1, most: int = 3) -> str:
        return f'<a href="/{word()}">{said(least, most).rstrip(".!")}</a>'

    def links(n: int) -> str:
        return f'<ul>{"".join(f"<li>{link()}</li>" for _ in range(n))}</ul>' if chance(0.7) else pick(" | ", " ").join(link() for _ in range(n))

    def drop(tag: str, attrs: str, inside: str) -> str:
        return f"<{tag}{attrs} data-drop>{inside}</{tag}>"

    def advert() -> str:
        return drop(pick("div", "div", "aside", "section"), f' class="{pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "ad banner", "advertisement")}"', pick(said(3, 20), link(3, 9), f"<p>{said(4, 25)}</p>", f"<span>Ad</span> {said(3, 12)}"))

    def nav() -> str:
        return drop(*pick(("nav", named("nav", "menu", "main-nav")), ("div", f' class="{pick("menu", "navbar", "nav", "navigation", "breadcrumbs")}"'), ("nav", "")), links(rng.integers(2, 10)))

    def notice() -> str:
        return drop(pick("div", "section", "aside"), f' {pick("class", "id")}="{pick("cookie-notice", "cookie", "consent", "notice", "gdpr-banner", "alert", "popup", "privacy-notice")}"', f"<p>{said(6, 40)}</p>" + pick("", "<button>OK</button>", link()) if chance(0.7) else said(6, 30))

    def form() -> str:
        return drop("form", named("search", "newsletter", "signup", "login"), pick("", f"<p>{said(3, 14)}</p>", f"<label>{said(1, 3)}</label>") + '<input name="q">' + pick("<button>Go</button>", f"<button>{said(1, 2)}</button>", '<input type="submit">'))

    def aside() -> str:
        head = f"<h{pick(2, 3, 4)}>{said(1, 4)}</h3>" if chance(0.6) else ""
        return drop(*pick(("aside", named("sidebar", "related", "rail")), ("aside", ""), ("div", f' class="{pick("sidebar", "related", "widget", "recommended", "popular-posts")}"')), head + pick(links(rng.integers(2, 8)), f"<p>{said(5, 30)}</p>", f"<p>{said(5, 20)}</p>{links(3)}"))

    def header() -> str:
        inside = pick(f"<h1>{said(1, 3)}</h1>", f"<div>{said(1, 4)}</div>", f"<p>{said(2, 8)}</p>", link(), said(1, 5)) + (links(rng.integers(2, 6)) if chance(0.5) else "")
        return drop(*pick(("header", ""), ("header", named("site-header", "masthead")), ("div", f' {pick("class", "id")}="{pick("header", "masthead", "top-banner")}"')), inside)

    def footer() -> str:
        inside = pick(f"&copy; {word()}.example &middot; {said(2, 20)}", f"<p>{said(3, 25)}</p>", links(rng.integers(2, 7)), f"<p>&copy; {said(2, 9)}</p>{links(3)}", said(2, 16))
        return drop(*pick(("footer", ""), ("footer", named("footer", "legal")), ("div", f' {pick("class", "id")}="{pick("footer", "copyright", "bottom", "legal")}"')), inside)

    def comments() -> str:
        each = lambda: pick(f'<div class="comment"><b>{word()}</b><p>{said(3, 60)}</p></div>', f"<li><p>{said(3, 50)}</p></li>", f"<p>{said(3, 40)}</p>")
        head = f"<h{pick(2, 3)}>{pick('Comments', said(1, 3))}</h3>" if chance(0.6) else ""
        return drop(pick("section", "div", "ul", "ol"), f' {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "reader-comments", "replies", "disqus")}"', head + "".join(each() for _ in range(rng.integers(1, 7))))

    def share() -> str:
        return drop("div", f' class="{pick("share", "social", "share-buttons", "follow")}"', pick(links(3), "<button>Share</button>", said(1, 5)))

    def para() -> str:
        text = said(1, pick(6, 30, 90, 150))
        if chance(0.15):
            text += " " + link(1, 4) + " " + said(2, 20)
        if chance(0.15):
            text = f"<b>{text}" + pick("</b>", "<br>", "</b> " + said(1, 20))
        return f"<p data-keep>{text}" + pick("</p>", "</p>", "</p>", "")

    def part() -> str:
        kind = rng.random()
        if kind < 0.8:
            return para()
        if kind < 0.87:
            return f"<h{pick(2, 3, 4)} data-keep>{said(1, 8)}</h2>".replace("</h2>", "") + "</h2></h3></h4>"
        if kind < 0.92:
            return "<ul data-keep>" + "".join(f"<li>{said(1, 25)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote data-keep>{pick(said(3, 40), f'<p>{said(3, 40)}</p>')}</blockquote>"
        if kind < 0.97:
            return f"<table data-keep>{''.join(f'<tr><td>{said(1, 4)}</td><td>{said(1, 6)}</td></tr>' for _ in range(3))}</table>"
        return f"<figure data-keep><img src=x><figcaption>{said(2, 14)}</figcaption></figure>"

    count = int(pick(0, 1, 1, 2, 3, 5, 9, 16, 25))
    body = [part() for _ in range(count)]
    if chance(0.85):
        body.insert(0, f"<h1 data-keep>{said(1, 12)}</h1>")
    if not body:
        body = [para()]
    for extra, p in ((advert, 0.2), (share, 0.12), (aside, 0.06), (form, 0.06), (nav, 0.03)):
        if chance(p):
            body.insert(rng.integers(0, len(body) + 1), extra())
    if chance(0.12):
        body.append(comments())
    if chance(0.15):
        body = [f"<header data-keep>{body[0]}{f'<p>{said(2, 8)}</p>' if chance(0.4) else ''}</header>", *body[1:]] if "<h1" in body[0] else body
    inside = "".join(body)
    if chance(0.2):
        inside = f"<div{named('content', 'entry-content', 'text')} data-keep>{inside}</div>"
    tag, attrs = pick(("article", ""), ("article", ""), ("article", named("post", "entry", "story")), ("main", ""), ("div", f' class="{pick("content", "post-body", "entry-content", "article", "story", "main-text")}"'), ("div", f' id="{pick("content", "main", "article")}"'), ("section", ""), ("div", ""))
    main = f"<{tag}{attrs} data-keep>{inside}</{tag}>"
    if chance(0.25):
        main = f"<main data-keep>{main}{aside() if chance(0.4) else ''}</main>"
    before = [x() for x, p in ((notice, 0.25), (header, 0.4), (nav, 0.75), (advert, 0.45), (form, 0.15), (aside, 0.1)) if chance(p)]
    after = [x() for x, p in ((comments, 0.3), (aside, 0.3), (advert, 0.2), (share, 0.12), (form, 0.12), (notice, 0.12), (footer, 0.8)) if chance(p)]
    page = "".join([*before, main, *after])
    for _ in range(rng.integers(0, 3)):
        page = f"<div{named('wrap', 'container', 'page', 'layout')} data-keep>{page}</div>"
    if chance(0.15):
        return page
    return f"<!DOCTYPE html><html data-keep><head><title>{said(2, 8)}</title></head><body data-keep>{page}</body></html>"


def _labelled(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels: what carries data-keep or data-drop, and below it what carries neither."""
    page = Page(html.replace(" data-keep", ' role="qqkeep"').replace(" data-drop", ' role="qqdrop"'))
    label = []
    for i, words in enumerate(page.attrs):
        label.append(1 if "qqkeep" in words else 0 if "qqdrop" in words else (label[page.parent[i]] if i else 1))
        if i and label[page.parent[i]] == 0:
            label[i] = 0
    page.attrs = [tuple(w for w in ws if w not in ("qqkeep", "qqdrop")) for ws in page.attrs]
    return features(page), np.array(label)


@functools.cache
def trained(pages: int = 1200, seed: int = 11) -> Trees:
    rng = np.random.default_rng(seed)
    letters = _letters(rng)
    made = [_labelled(_page(rng, letters)) for _ in range(pages)]
    return boost(np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made]).astype(float))


def decode(parent: list[int], score: np.ndarray) -> list[bool]:
    """The nodes to keep: the largest sum of scores with every kept node's parent kept. Ties drop."""
    gain = score.tolist()
    for i in range(len(parent) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = [gain[0] > 0]
    for i in range(1, len(parent)):
        keep.append(keep[parent[i]] and gain[i] > 0)
    return keep


def main_texts(htmls: list[str | None], trees: Trees, *, bound: float = 4.0) -> list[str]:
    """The main text of each page; empty for null, or where nothing is kept. Scores count up to bound either way."""
    pages = [Page(h) if h else None for h in htmls]
    real = [p for p in pages if p is not None]
    if not real:
        return [""] * len(htmls)
    scores = np.clip(trees.score(np.concatenate([features(p) for p in real])), -bound, bound)
    out, at = [], 0
    for p in pages:
        if p is None:
            out.append("")
            continue
        keep = decode(p.parent, scores[at : at + len(p.tag)])
        at += len(p.tag)
        out.append("\n".join(text for node, text in p.blocks if keep[node]))
    return out


def extracted(pages: DataFrame, *, html: str = "html", trees: Trees | None = None, at_once: int = 200) -> DataFrame:
    """pages with text; html itself is left out. A pass without a shuffle; the model is a few tens of KB.

    Nulls: a null page has an empty text. Cut-off tags, unclosed elements and bare "<" are read as browsers do; no block is
    dropped or cut for its length. Repeated rows have the same text. A column named text is replaced.
    Nodes whose scores tie at nothing are dropped. An empty table gives an empty one.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trees or trained())
    names = [c for c in pages.columns if c not in (html, "text")]
    spots, at = [pages.columns.index(c) for c in names], pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                text = pa.array(main_texts(part.column(at).to_pylist(), sent.value), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in spots), text], names=[*names, "text"])

    return pages.mapInArrow(workers.task(run), pages.select(*names).withColumn("text", F.lit("")).schema)


def op3_html(spark, sf_dir: str) -> DataFrame:
    pages = scratch.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).withColumn("n_chars", F.length("text").cast("bigint"))
