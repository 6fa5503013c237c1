"""Operator 5: main text of a page by boosted trees over its DOM nodes.

A page is parsed into elements; every element is a row of features (size and density of
its subtree, words in its class, id and role, depth, siblings, links, punctuation).
Gradient-boosted trees give each element the probability that it holds main text.  Hierarchical
decoding then takes the most probable set of kept elements in which no kept element
has a dropped ancestor; scripts, styles, forms and the like, and elements with the ``hidden``
attribute, are never text; "hidden" in a class or id is a feature as other words are.

There are no labelled pages, so the trees learn from weak labels: in at most about
``TRAIN_PAGES`` distinct pages of the table, those of the least hashes, what stands in ``article``/``main``
(or nothing but plain blocks) is text, and what stands in ``nav``, ``footer``, ``aside``,
forms or blocks named as boilerplate is not; and in generated pages that hold the same
paragraphs in varied markup, with notices, adverts, side columns and comments.  Pages of
more than ``TRAIN_PAGE_CHARS`` characters are extracted, but not learnt from; the generated
pages need no sample, so only an empty table has no trees.  The driver holds that bounded
sample only.

Pages are independent: extraction is a map, without a shuffle.

Defined cases: a null or empty page, or one without kept text, gives an empty text;
unclosed and misnested tags close as browsers close them; repeated rows and null ids are
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 200
TRAIN_PAGE_CHARS = 200_000
TREES, DEPTH, BINS, RATE = 40, 4, 24, 0.25

# Fixed values of HTML: names of elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("script style noscript template svg math iframe object embed applet canvas head title "
                  "textarea select button option input form audio video map xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav "
                  "ol p pre search section summary table tbody td tfoot th thead tr ul caption head "
                  "title script style noscript template".split())
#: An opening tag of the key closes these open elements first (up to a scope's edge).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"},
          "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
         "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*>""",
                 re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: The name of an attribute, with its value: words within values are no names.
ATTRIBUTE_NAME = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")

TAGS = ("body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "nav",
        "header", "footer", "aside", "table", "td", "blockquote", "pre", "a", "span", "b", "figure")
BAD_WORDS = frozenset("ad ads advert advertisement sponsor promo banner nav menu menubar breadcrumb sidebar "
                      "side aside footer foot header masthead cookie consent notice gdpr popup modal overlay "
                      "share social related recommend comment comments reply respond disqus form subscribe "
                      "newsletter login signup widget toolbar pagination pager tags copyright legal "
                      "navigation contentinfo complementary search".split())
GOOD_WORDS = frozenset("article content main post entry body text story page hentry".split())
NUMBERS = ("depth", "chars", "words", "tags", "density", "link_share", "punctuation", "long_blocks",
           "paragraphs", "list_items", "siblings", "place", "same_tag", "sibling_chars", "page_share",
           "before", "bad", "good", "bad_above", "good_above", "depth_below", "mean_block", "digits",
           "links", "marks", "hidden_word", "hidden_word_above")


class Page:
    """Elements of a page in order: tag, parent, attribute words, and its text blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.names = ["#page"], [-1], [frozenset()]
        self.hidden = [False]                         # has it the attribute of that name
        self.blocks: list[tuple[int, str]] = []       # (element the text stands in, raw text)
        self.breaks: list[bool] = []                  # does a new block begin here
        self._parse(source)

    def _parse(self, source: str) -> None:
        open_, at, fresh = [0], 0, True
        lower = None
        size = len(source)
        while at < size:
            m = TAG.search(source, at)
            stop = m.start() if m else size
            if stop > at:
                self.blocks.append((open_[-1], source[at:stop]))
                self.breaks.append(fresh)
                fresh = False
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                if name in BLOCK:
                    fresh = True
                if name == "p" and not any(self.tag[e] == "p" for e in open_):
                    continue
                for k in range(len(open_) - 1, 0, -1):
                    other = self.tag[open_[k]]
                    if other == name:
                        del open_[k:]
                        break
                    if name not in BLOCK and other in BLOCK:
                        break                          # a stray inline end tag closes no block
                continue
            if name == "br":
                self.blocks.append((open_[-1], " "))
                self.breaks.append(fresh)
                continue
            if name in BLOCK:
                fresh = True
                for k in range(len(open_) - 1, 0, -1):
                    other = self.tag[open_[k]]
                    if other == "p":
                        del open_[k:]
                        break
                    if other in BLOCK:
                        break
            if name in CLOSES:
                for k in range(len(open_) - 1, 0, -1):
                    other = self.tag[open_[k]]
                    if other in SCOPE[name]:
                        break
                    if other in CLOSES[name]:
                        del open_[k:]
                        if name not in ("tr", "tbody", "tfoot"):
                            break
            words, hidden = frozenset(), False
            if m.group(3):
                found = ATTRIBUTE.findall(m.group(3))
                if found:
                    words = frozenset(w for _, v in found for w in WORD.findall(v.lower()))
                attributes = m.group(3).lower()
                hidden = "hidden" in attributes and "hidden" in ATTRIBUTE_NAME.findall(attributes)
            self.tag.append(name)
            self.parent.append(open_[-1])
            self.names.append(words)
            self.hidden.append(hidden)
            if name in RAW:
                if lower is None:
                    lower = source.lower()
                    if len(lower) != size:             # a letter whose lower case is longer
                        lower = re.sub("[A-Z]", lambda c: c.group().lower(), source)
                end = lower.find("</" + name, at)
                end = size if end < 0 else end
                close = source.find(">", end)
                at = size if close < 0 else close + 1
                fresh = fresh or name in BLOCK
            elif name not in VOID and not m.group(3).endswith("/") or name in BLOCK and name not in VOID:
                open_.append(len(self.tag) - 1)

    def never(self) -> np.ndarray:
        """Elements that hold no text whatever the trees say, with all below them."""
        out = np.zeros(len(self.tag), bool)
        for e in range(1, len(self.tag)):
            out[e] = out[self.parent[e]] or self.tag[e] in NEVER or self.hidden[e]
        return out

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        chars, words, marks, digits, links = (np.zeros(n) for _ in range(5))
        blocks, long_blocks, before = np.zeros(n), np.zeros(n), np.full(n, -1.0)
        anchor, depth = np.zeros(n, bool), np.zeros(n)
        for e in range(1, n):
            anchor[e] = anchor[parent[e]] or self.tag[e] == "a"
            depth[e] = depth[parent[e]] + 1
        total = 0
        for e, text in self.blocks:
            own = len(text) if not text.isspace() else 0
            if before[e] < 0:
                before[e] = total
            if own:
                total += own
                chars[e] += own
                words[e] += text.count(" ") + 1
                marks[e] += text.count(".") + text.count(",")
                digits[e] += "©" in text or "&copy;" in text
                links[e] += own if anchor[e] else 0
                blocks[e] += 1
                long_blocks[e] += own > 80
        tags, paragraphs, items, anchors = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
        below, bad, good = np.zeros(n), np.zeros(n), np.zeros(n)
        above_bad, above_good = np.zeros(n), np.zeros(n)
        veiled, above_veiled = np.zeros(n), np.zeros(n)
        kids: list[list[int]] = [[] for _ in range(n)]
        for e in range(1, n):
            kids[parent[e]].append(e)
            bad[e] = len(self.names[e] & BAD_WORDS) + (self.tag[e] in BAD_WORDS)
            good[e] = len(self.names[e] & GOOD_WORDS) + (self.tag[e] in GOOD_WORDS and self.tag[e] != "body")
            above_bad[e] = above_bad[parent[e]] + bad[e]
            above_good[e] = above_good[parent[e]] + good[e]
            veiled[e] = "hidden" in self.names[e]
            above_veiled[e] = above_veiled[parent[e]] + veiled[e]
            paragraphs[e], items[e], anchors[e] = self.tag[e] == "p", self.tag[e] == "li", self.tag[e] == "a"
        for e in range(n - 1, 0, -1):
            p = parent[e]
            for a in (chars, words, marks, digits, links, blocks, long_blocks, tags, paragraphs, items, anchors):
                a[p] += a[e]
            below[p] = max(below[p], below[e] + 1)
            if before[p] < 0 or 0 <= before[e] < before[p]:
                before[p] = before[e]
        siblings, place, same, near = (np.zeros(n) for _ in range(4))
        for own in kids:
            if own:
                kinds = [self.tag[e] for e in own]
                count = {k: kinds.count(k) for k in set(kinds)} if len(own) < 64 else None
                if count is None:
                    count = {}
                    for k in kinds:
                        count[k] = count.get(k, 0) + 1
                mean = float(chars[own].mean())
                for k, e in enumerate(own):
                    siblings[e], place[e] = len(own), k / len(own)
                    same[e], near[e] = count[kinds[k]] / len(own), mean
        whole = max(1.0, total)
        cols = {
            "depth": depth, "chars": np.log1p(chars), "words": np.log1p(words), "tags": np.log1p(tags),
            "density": np.log1p(chars / tags), "link_share": links / np.maximum(chars, 1),
            "punctuation": marks / np.maximum(words, 1), "long_blocks": long_blocks, "paragraphs": paragraphs,
            "list_items": items, "siblings": siblings, "place": place, "same_tag": same,
            "sibling_chars": np.log1p(near), "page_share": chars / whole,
            "before": np.maximum(before, 0) / whole, "bad": bad, "good": good, "bad_above": above_bad,
            "good_above": above_good, "depth_below": below,
            "mean_block": np.log1p(chars / np.maximum(blocks, 1)), "digits": digits,
            "links": np.log1p(anchors), "marks": np.log1p(marks), "hidden_word": veiled,
            "hidden_word_above": above_veiled}
        kind = np.zeros((n, 2 * len(TAGS)))
        for e in range(n):
            if self.tag[e] in TAGS:
                kind[e, TAGS.index(self.tag[e])] = 1
            if e and self.tag[parent[e]] in TAGS:
                kind[e, len(TAGS) + TAGS.index(self.tag[parent[e]])] = 1
        return np.concatenate([np.stack([cols[c] for c in NUMBERS], axis=1), kind], axis=1).astype(np.float32)

    def decode(self, probability: np.ndarray) -> np.ndarray:
        """Most probable kept set without a kept element below a dropped one."""
        n = len(self.tag)
        p = np.clip(probability, 1e-6, 1 - 1e-6)
        p[self.never()] = 1e-12
        drop, keep = np.log1p(-p), np.log(p)
        for e in range(n - 1, 0, -1):
            keep[self.parent[e]] += max(keep[e], drop[e])
            drop[self.parent[e]] += drop[e]
        kept = np.zeros(n, bool)
        kept[0] = True                                 # the page itself holds both kinds
        for e in range(1, n):
            kept[e] = kept[self.parent[e]] and keep[e] > drop[e]
        return kept

    def text(self, kept: np.ndarray) -> str:
        """Blocks of the kept elements, one line each."""
        lines, current = [], []
        for (e, raw), fresh in zip(self.blocks, self.breaks, strict=True):
            if fresh and current:
                lines.append("".join(current))
                current = []
            if kept[e]:
                current.append(raw)
        lines.append("".join(current))
        clean = (" ".join(html_lib.unescape(line).split()) for line in lines)
        return "\n".join(line for line in clean if line)


class Boosted:
    """Gradient-boosted regression trees on binned features, logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        codes = self._codes(x)
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        margin = np.full(len(y), self.base)
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            feature, cut, value = self._grow(codes, y - p, p * (1 - p))
            self.trees.append((feature, cut, value))
            margin += value[self._leaf(codes, feature, cut)]
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)],
                        axis=1).astype(np.int32)

    def _grow(self, codes, grad, hess):
        """A tree of fixed depth, level by level; nodes are numbered as in a heap."""
        inner = (1 << DEPTH) - 1
        feature, cut = np.zeros(inner, np.int32), np.full(inner, BINS, np.int32)
        node = np.zeros(len(codes), np.int64)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            best = np.zeros(width)
            for j in range(codes.shape[1]):
                cell = (node - first) * (BINS + 1) + codes[:, j]
                g = np.bincount(cell, grad, width * (BINS + 1)).reshape(width, -1)
                h = np.bincount(cell, hess, width * (BINS + 1)).reshape(width, -1)
                gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                gt, ht = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None]
                gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first:first + width][better] = j
                cut[first:first + width][better] = at[better]
            node = 2 * node + 1 + (codes[np.arange(len(codes)), feature[node]] > cut[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, grad, 1 << DEPTH) / (np.bincount(leaf, hess, 1 << DEPTH) + 1)
        return feature, cut, value

    def _leaf(self, codes, feature, cut):
        node = np.zeros(len(codes), np.int64)
        row = np.arange(len(codes))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (codes[row, feature[node]] > cut[node])
        return node - ((1 << DEPTH) - 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        margin = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            margin += value[self._leaf(codes, feature, cut)]
        return 1 / (1 + np.exp(-margin))


def weak_labels(page: Page) -> np.ndarray | None:
    """1 for elements with main text, 0 for boilerplate; None if the page shows neither."""
    n = len(page.tag)
    inside, bad = np.zeros(n, bool), page.never()
    for e in range(1, n):
        bad[e] |= bad[page.parent[e]] or page.tag[e] in ("nav", "footer", "aside", "header") or bool(
            page.names[e] & BAD_WORDS and not page.names[e] & GOOD_WORDS)
        inside[e] = inside[page.parent[e]] or page.tag[e] in ("article", "main") or bool(
            page.names[e] & {"article", "content", "post", "entry"} and not page.names[e] & BAD_WORDS)
    label = inside & ~bad
    if not label.any():
        return None
    for e in range(n - 1, 0, -1):
        if label[e]:
            label[page.parent[e]] = True               # what holds main text is kept, too
    return label


def made_pages(paragraphs: list[str], count: int, seed: int = 3) -> list[tuple[str, set[str]]]:
    """Pages in varied markup around the given paragraphs: (html, kept paragraphs)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]               # noqa: E731

    def some(lo: int, hi: int) -> list[str]:
        return [pick(paragraphs) for _ in range(int(rng.integers(lo, hi + 1)))]

    def short() -> str:
        return " ".join(pick(paragraphs).split()[:int(rng.integers(1, 9))])

    def boiler() -> str:
        listed = "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(int(rng.integers(3, 9))))
        name = pick(sorted(BAD_WORDS))
        text = pick(paragraphs)[:int(rng.integers(30, 400))]
        return pick([
            f"<nav><ul>{listed}</ul></nav>", f'<div class="{name}">{text}</div>',
            f'<div id="{name}"><ul>{listed}</ul></div>', f"<aside><h3>{short()}</h3><p>{text}</p></aside>",
            f"<header><a href='/'>{short()}</a><p>{short()}</p></header>",
            f"<footer>&copy; {short()} <a href='/x'>{short()}</a></footer>",
            f'<section class="comments"><h3>{short()}</h3><div class="comment"><p>{text}</p></div>'
            f'<div class="comment"><p>{pick(paragraphs)[:300]}</p></div></section>',
            f'<div class="{name}-box"><p>{text}</p><a href="/y">{short()}</a></div>',
            f'<div role="{pick(["navigation", "complementary", "contentinfo"])}"><p>{text}</p></div>',
            f"<form><p>{short()}</p><input name=q><button>{short()}</button></form>",
            f"<ul>{listed}</ul>", f"<p><a href='/z'>{short()}</a> | <a href='/w'>{short()}</a></p>"])

    out = []
    for _ in range(count):
        body = some(2, 12)
        head = pick(["h1", "h2"])
        parts = [f"<{head}>{short()}</{head}>"]
        for p in body:
            parts.append(pick([f"<p>{p}</p>", f"<p>{p}</p>", f"<p><b>{short()}</b> {p}", f"<div>{p}</div>",
                               f"<blockquote><p>{p}</p></blockquote>", f"<ul><li>{p}</li><li>{short()}</li></ul>",
                               f"<table><tr><td>{p}</td><td>{short()}</td></tr></table>"]))
            if rng.random() < 0.12:
                parts.append("<!--b-->" + boiler())
        open_, close = pick([("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"),
                             ('<div class="content">', "</div>"), ('<div id="main">', "</div>"),
                             ('<section class="post-body">', "</section>"), ("<section>", "</section>"),
                             ('<div class="wrap"><div class="entry">', "</div></div>")])
        page = "".join(boiler() for _ in range(int(rng.integers(1, 4))))
        page += open_ + "<!--m-->" + "".join(parts) + "<!--/m-->" + close
        page += "".join(boiler() for _ in range(int(rng.integers(1, 5))))
        out.append(f"<html><head><title>{short()}</title></head><body>{page}</body></html>")
    return out


def _made_labels(source: str) -> tuple[Page, np.ndarray]:
    """Elements of a made page: main text stands between the marks, boilerplate after <!--b-->."""
    marked = source.replace("<!--m-->", '<span class="zmain">').replace("<!--/m-->", "</span>")
    page = Page(re.sub(r"<!--b--><(\w+)", r'<\1 class="zboiler" data-x', marked))
    inside, bad = np.zeros(len(page.tag), bool), page.never()
    for e in range(1, len(page.tag)):
        inside[e] = inside[page.parent[e]] or "zmain" in page.names[e]
        bad[e] |= bad[page.parent[e]] or "zboiler" in page.names[e]
    label = inside & ~bad
    for e in range(len(page.tag) - 1, 0, -1):
        if label[e]:
            label[page.parent[e]] = True
    return page, label


def train(pages: DataFrame, bound: int = TRAIN_PAGES, html_col: str = "html") -> Boosted | None:
    """Trees from a bounded sample of pages and from made ones; None for an empty table."""
    if pages.isEmpty():
        return None
    source = F.col(html_col).cast("string")
    usable = pages.select(source.alias("html")).filter(
        F.length("html").between(1, TRAIN_PAGE_CHARS)).withColumn("hash", F.xxhash64("html"))
    least = [r["hash"] for r in usable.select("hash").distinct().orderBy("hash").limit(bound).collect()]
    chosen = sorted(r["html"] for r in usable.filter(F.col("hash").isin(least)).select("html")
                    .dropDuplicates().collect()) if least else []
    rows, labels, paragraphs = [], [], []
    for source in chosen:
        page = Page(source)
        label = weak_labels(page)
        if label is not None:
            rows.append(page.features())
            labels.append(label)
            paragraphs += [html_lib.escape(x) for x in page.text(label).split("\n") if len(x) > 20][:20]
    if not paragraphs:
        paragraphs = ["No page of the sample has main text that its markup names, so this line stands in."]
    for source in made_pages(paragraphs, 2 * bound):
        plain = Page(source)
        marked, label = _made_labels(source)
        keep = np.array(["zmain" not in w for w in marked.names])
        if keep.sum() == len(plain.tag):               # the marks changed nothing else
            rows.append(plain.features())
            labels.append(label[keep])
    return Boosted().fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def extract_pages(model: Boosted, sources: list[str | None]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    x = np.concatenate([p.features() for p in pages]) if pages else np.zeros((0, 1))
    p = model.probability(x) if len(x) else x
    out, at = [], 0
    for page in pages:
        n = len(page.tag)
        out.append(page.text(page.decode(p[at:at + n].copy())))
        at += n
    return out


def _extract(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = extract_pages(model, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"),
                                                  pa.array(texts, pa.string())],
                                                 names=["page_id", "url", "text"])
    return run


def extract(pages: DataFrame, model: Boosted | None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    if model is None:                                  # nothing to learn from: every page is empty
        return rows.select("page_id", "url", F.lit("").alias("text"))
    return rows.mapInArrow(_extract(model), "page_id bigint, url string, text string")


def contract(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
