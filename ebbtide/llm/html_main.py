"""Main text of web pages by a linear-chain conditional random field.

A page is a sequence of leaf blocks; each is part of the article or not. The field scores a
labelling by weights of block features (ancestor tags, words of their class, id and role,
length, links, punctuation, place, words of short blocks, what the neighbours look like) and
of neighbouring labels. It is trained by the gradient of the conditional likelihood on
labelled pages, and the best labelling is found by Viterbi's algorithm.

Labelled pages come from two places, both bounded: pages of the table that say themselves
where their article is (an article or main element), and pages laid out here with texts of
those, in many layouts, with menus, notices, adverts, sidebars, forms, comments and footers
around and inside articles that often have no telling tag. Extraction reads every page whole.

Null or empty html gives an empty text. Repeated rows give repeated results. Without any page
to learn from the layouts use a few words of their own. No pages: no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ebbtide.llm.html_blocks import Block, blocks
from ebbtide.llm.scratch import stored
from pyspark.sql import Column, DataFrame, functions as F

BITS = 15
#: Pages of the table that are looked at for training, and pages laid out.
SAMPLE, LAYOUTS = 300, 900
#: Blocks of a training page; extraction has no limit.
LONGEST = 80
ROUNDS, RATE, PENALTY = 120, 0.15, 0.0005
SHORT = 10
APART = frozenset("nav aside form footer header".split())


@dataclass
class Field:
    """Weight of each feature for being in the article; of the first label; of label pairs."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


@lru_cache(maxsize=20_000)
def _path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[int, ...]:
    names = {f"in {tag}" for tag, _ in path}
    names |= {f"marked {token}" for _, tokens in path for token in tokens}
    names |= {f"{tag} marked {token}" for tag, tokens in path for token in tokens}
    # What marks the innermost marked element says most about the block.
    names |= next(({f"nearest mark {t}" for t in tokens} for _, tokens in reversed(path) if tokens), set())
    inner = [tag for tag, _ in path[-2:]]
    names |= {"at " + "/".join(inner[-1:]), "at " + "/".join(inner), f"depth {min(len(path), 12)}"}
    if not any(tokens for _, tokens in path):
        names.add("unmarked")
    return tuple(sorted(_number(n) for n in names))


def _shape(block: Block) -> tuple[int, int, bool]:
    words = block.text.count(" ") + 1
    return (min(words.bit_length(), 8), min(4 * block.linked // len(block.text), 4),
            block.text[-1] in ".!?…\"”»")


def features(page: list[Block]) -> list[list[int]]:
    """Numbers of the features of each block."""
    shapes, found = [_shape(b) for b in page], []
    for i, (block, (words, links, ends)) in enumerate(zip(page, shapes)):
        before = shapes[i - 1] if i else ("none",) * 3
        after = shapes[i + 1] if i + 1 < len(page) else ("none",) * 3
        text = block.text
        names = [f"words {words}", f"links {links}", f"ends {ends}",
                 f"words {words} links {links} ends {ends}",
                 f"before {before[0]} {before[1]}", f"after {after[0]} {after[1]}",
                 f"place {4 * i // len(page)}", f"commas {min(text.count(','), 4)}"]
        if "©" in text[:200]:
            names.append("copyright")
        if words <= 3:
            names.append(f"titled {text.istitle()}")
            names += [f"word {w}" for w in text.lower().split()[:SHORT]]
        path = tuple((f.tag, f.tokens) for f in block.path)
        found.append([*_path_features(path), *map(_number, names)])
    return found


def labels(page: list[Block]) -> np.ndarray | None:
    """1 for blocks of the article, by marks (data-main) or by an article or main element;
    None if the page says nothing."""
    marked = [next((f.main for f in reversed(b.path) if f.main is not None), None) for b in page]
    if any(m is not None for m in marked):
        return np.array([m == "1" for m in marked], dtype=np.int64)
    found = []
    for block in page:
        tags = [f.tag for f in block.path]
        at = max((i for i, t in enumerate(tags) if t in ("article", "main")), default=None)
        found.append(at is not None and not APART & set(tags[at:]))
    return np.array(found, dtype=np.int64) if any(found) else None


def _emissions(weights: np.ndarray, listed: list[list[int]]) -> np.ndarray:
    sizes = [len(f) for f in listed]
    flat = np.fromiter((x for f in listed for x in f), dtype=np.int64, count=sum(sizes))
    return np.bincount(np.repeat(np.arange(len(listed)), sizes), weights[flat], len(listed))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(emission: np.ndarray, truth: np.ndarray, real: np.ndarray, start: np.ndarray,
               step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood of the true labels, and its gradient by emission, start and step.

    Rows are pages, padded; ``real`` tells blocks from padding. Emissions are for label 1.
    """
    pages, wide = emission.shape
    score = np.stack([np.zeros_like(emission), emission], axis=2)
    forward = np.zeros((pages, wide, 2))
    forward[:, 0] = start + score[:, 0]
    for t in range(1, wide):
        go = _log_sum(forward[:, t - 1, :, None] + step, 1) + score[:, t]
        forward[:, t] = np.where(real[:, t, None], go, forward[:, t - 1])
    total = _log_sum(forward[:, -1], 1)
    backward = np.zeros((pages, wide, 2))
    pair = np.zeros((2, 2))
    for t in range(wide - 1, 0, -1):
        ahead = score[:, t] + backward[:, t]
        both = forward[:, t - 1, :, None] + step + ahead[:, None, :] - total[:, None, None]
        pair -= (np.exp(both) * real[:, t, None, None]).sum(axis=0)
        backward[:, t - 1] = np.where(real[:, t, None], _log_sum(step + ahead[:, None, :], 2), 0.0)
        # Padding hands on what lies behind the last block: nothing.
    chance = np.exp(forward + backward - total[:, None, None])
    chance = np.where(real[:, :, None], chance, 0)
    first = np.eye(2)[truth[:, 0]]
    later = real[:, 1:]
    np.add.at(pair, (truth[:, :-1][later], truth[:, 1:][later]), 1)
    value = (np.where(real, emission * truth, 0).sum() + start[truth[:, 0]].sum()
             + step[truth[:, :-1][later], truth[:, 1:][later]].sum() - total.sum())
    return (float(value), np.where(real, truth - chance[:, :, 1], 0),
            (first - chance[:, 0]).sum(axis=0), pair)


def train(pages: list[tuple[list[list[int]], np.ndarray]]) -> Field:
    """The field fitted to labelled pages, by gradient steps of adapted size (Adam)."""
    pages = [(f[:LONGEST], y[:LONGEST]) for f, y in pages if len(f)]
    wide = max(len(f) for f, _ in pages)
    truth, real = np.zeros((len(pages), wide), np.int64), np.zeros((len(pages), wide), bool)
    row, feature = [], []
    for i, (listed, y) in enumerate(pages):
        truth[i, :len(y)], real[i, :len(y)] = y, True
        for j, f in enumerate(listed):
            row += [i * wide + j] * len(f)
            feature += f
    row, feature = np.array(row), np.array(feature)
    size = 1 << BITS
    w, m, v = (np.zeros(size + 6) for _ in range(3))
    for turn in range(1, ROUNDS + 1):
        emission = np.bincount(row, w[feature], truth.size).reshape(truth.shape)
        _, by_block, by_start, by_step = likelihood(
            emission, truth, real, w[size:size + 2], w[size + 2:].reshape(2, 2))
        gradient = np.concatenate([np.bincount(feature, by_block.ravel()[row], size),
                                   by_start, by_step.ravel()]) / len(pages) - PENALTY * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w = w + RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    return Field(w[:size], w[size:size + 2], w[size + 2:].reshape(2, 2))


def decode(field: Field, emission: list[float]) -> list[int]:
    """The most likely labels, by Viterbi's algorithm."""
    if not emission:
        return []
    (s00, s01), (s10, s11) = field.step.tolist()
    no, yes = float(field.start[0]), float(field.start[1]) + emission[0]
    back = []
    for e in emission[1:]:
        a, b, c, d = no + s00, yes + s10, no + s01, yes + s11
        back.append((int(b > a), int(d > c)))
        no, yes = max(a, b), max(c, d) + e
    label = int(yes > no)
    found = [label]
    for step in reversed(back):
        label = step[label]
        found.append(label)
    return found[::-1]


def main_text(field: Field, page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    found = blocks(page)
    if not found:
        return ""
    chosen = decode(field, _emissions(field.weights, features(found)).tolist())
    return "\n\n".join(b.text for b, label in zip(found, chosen) if label)


def fit(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS) -> Field:
    """The field, from a bounded sample of the pages and layouts with their texts."""
    some = stored(pages.select(pages["page_id"].alias("page_id"), pages["html"].alias("html"))
                  .where("html IS NOT NULL").orderBy(F.xxhash64("page_id", "html")).limit(sample),
                  "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [blocks(h) for b in batches for h in b.column(0).to_pylist()]
        given = [(p, y) for p in read if (y := labels(p)) is not None]
        texts = [b.text for p, y in given for b, label in zip(p, y) if label]
        made = [blocks(h) for h in labelled_pages(texts, layouts)]
        field = train([(features(p), y) for p, y in given] + [(features(p), labels(p)) for p in made])
        flat = np.concatenate([field.weights, field.start, field.step.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()])], names=["weights"])

    # One task learns from so many pages, whatever the size of the table.
    weights = np.array(some.select("html").repartition(1).mapInArrow(
        run, "weights array<double>").first()["weights"])
    size = 1 << BITS
    return Field(weights[:size], weights[size:size + 2], weights[size + 2:].reshape(2, 2))


def extraction(page: Column, field: Field) -> Column:
    """A text column from a column of html."""
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(field, p.as_py()) for p in pages], pa.string())

    return run(page)


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per page."""
    field = fit(pages)
    found = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"),
                         extraction(pages["html"], field).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


# --- labelled layouts ------------------------------------------------------------------

WORDS = "one two three four five six seven eight nine ten and so on with more of it".split()
# What sites call their parts.
MENUS = ["menu", "navbar", "nav-links", "breadcrumbs", "main-menu", "site-nav", "topbar", "toc",
         "pagination", "skip-links"]
HEADERS = ["header", "site-header", "masthead", "logo", "brand", "tagline", "page-header"]
NOTICES = ["cookie-banner", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal",
           "paywall", "announcement"]
ADVERTS = ["ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "ad-slot",
           "sponsor", "partner"]
SIDES = ["sidebar", "widget", "related", "trending", "most-read", "recommended", "rail", "side",
         "author-bio", "see-also"]
SHARES = ["share", "social", "share-buttons", "tools", "tags", "follow-us"]
FORMS = ["newsletter", "subscribe", "search", "login", "signup", "contact-form"]
COMMENTS = ["comments", "comment-list", "comment", "reader-comments", "responses", "disqus",
            "replies", "discussion", "respond", "feedback"]
FOOTERS = ["footer", "site-footer", "copyright", "legal", "bottom", "colophon", "imprint"]
ARTICLES = ["content", "post", "entry-content", "article-body", "story", "post-content", "text",
            "page-content", "main", "article", "entry", "story-body", "main-content", "body-text"]
WRAPPERS = ["wrapper", "container", "page", "site", "row", "col", "layout", "inner", "outer", "app"]
SMALL = ["Home", "About us", "Contact", "Read more", "Log in", "Subscribe", "Search", "Share",
         "Reply", "Accept", "Comments", "Leave a comment", "Related", "Privacy policy", "Next",
         "Menu", "Advertisement", "Follow us", "Sign up", "Tags"]


class _Layout:
    """One labelled page: data-main says for each part whether it is the article's."""

    def __init__(self, texts: list[str], draw: random.Random):
        self.texts, self.draw = texts, draw

    def words(self, low: int, high: int) -> str:
        some = self.draw.choice(self.texts).split() if self.texts else self.draw.choices(WORDS, k=90)
        n = self.draw.randint(low, high)
        at = self.draw.randrange(max(1, len(some) - n))
        found = some[at:at + n] or ["word"]
        while len(found) < low:
            found = found + found
        text = " ".join(found).replace("&", "&amp;").replace("<", "&lt;")
        return text + ("." if n > 12 and self.draw.random() < 0.8 else "")

    def small(self) -> str:
        return self.draw.choice(SMALL) if self.draw.random() < 0.5 else self.words(1, 4)

    def link(self) -> str:
        return f'<a href="/{self.draw.randrange(999)}">{self.small()}</a>'

    def marks(self, names: list[str], chance: float = 1.0) -> str:
        if self.draw.random() > chance:
            return ""
        kind = self.draw.choice(["class", "class", "id"])
        more = f" {self.draw.choice(WRAPPERS)}" if self.draw.random() < 0.2 else ""
        return f' {kind}="{self.draw.choice(names)}{more}"'

    def off(self, tag: str, names: list[str], inside: str, chance: float = 0.9) -> str:
        return f'<{tag}{self.marks(names, chance)} data-main="0">{inside}</{tag}>'

    def links(self) -> str:
        rows = [self.link() for _ in range(self.draw.randint(3, 9))]
        if self.draw.random() < 0.7:
            return "<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>"
        return self.draw.choice([" | ", " "]).join(rows)

    def menu(self) -> str:
        plain = self.draw.random() < 0.5
        return self.off("nav", MENUS, self.links(), 0.4) if plain else self.off(
            self.draw.choice(["div", "ul"]), MENUS, self.links())

    def header(self) -> str:
        inside = f"<div>{self.words(1, 4)}</div>" + (
            f"<p>{self.words(3, 10)}</p>" if self.draw.random() < 0.5 else "") + (
            self.menu() if self.draw.random() < 0.4 else "")
        return self.off(*self.draw.choice([("header", HEADERS, inside, 0.5), ("div", HEADERS, inside)]))

    def notice(self) -> str:
        role = self.draw.choice(["", ' role="alert"', ' role="dialog"'])
        inside = f"<p>{self.words(5, 40)}</p><button>{self.small()}</button>"
        return f'<div{self.marks(NOTICES)}{role} data-main="0">{inside}</div>'

    def advert(self) -> str:
        inside = self.words(2, 30)
        return self.off(self.draw.choice(["div", "div", "aside", "section"]), ADVERTS,
                        inside if self.draw.random() < 0.6 else f"<p>{inside}</p>")

    def side(self) -> str:
        inside = f"<h3>{self.small()}</h3>" + self.draw.choice(
            [self.links(), f"<p>{self.words(5, 50)}</p>", self.links() + f"<p>{self.words(5, 30)}</p>"])
        return self.off(*self.draw.choice([("aside", SIDES, inside, 0.5), ("div", SIDES, inside),
                                           ("section", SIDES, inside)]))

    def share(self) -> str:
        return self.off("div", SHARES, " ".join(self.link() for _ in range(self.draw.randint(2, 5))))

    def form(self) -> str:
        inside = f"<h3>{self.small()}</h3><p>{self.words(3, 25)}</p><label>{self.small()}</label>" \
            f"<input name=q><select><option>{self.small()}<option>{self.small()}</select>" \
            f"<textarea>{self.small()}</textarea><button>{self.small()}</button>"
        return self.off("form", FORMS, inside, 0.6)

    def comments(self) -> str:
        rows = []
        for _ in range(self.draw.randint(1, 6)):
            says = f"<p>{self.words(4, 70)}</p>" if self.draw.random() < 0.8 else self.words(4, 60)
            who = self.draw.choice(["", f"<b>{self.words(1, 2)}</b>", f"<h4>{self.words(1, 3)}</h4>",
                                    f'<div class="author">{self.words(1, 2)}</div>'])
            tag = self.draw.choice(["div", "li", "article", "p"] if "<" not in who + says else
                                   ["div", "li", "article"])
            rows.append(f'<{tag}{self.marks(["comment", "reply", "response"], 0.7)}>{who}{says}</{tag}>')
        inside = self.draw.choice(["", f"<h3>{self.small()}</h3>"]) + "".join(rows) + (
            self.form() if self.draw.random() < 0.3 else "")
        return self.off(self.draw.choice(["section", "div", "ol", "aside"]), COMMENTS, inside, 1.0)

    def footer(self) -> str:
        inside = self.draw.choice([f"&copy; {self.words(1, 3)} &middot; {self.words(3, 25)}",
                                   f"<p>{self.words(3, 40)}</p>" + self.links(),
                                   f"<p>&copy; {self.words(2, 12)}</p>", self.links()])
        return self.off(*self.draw.choice([("footer", FOOTERS, inside, 0.3), ("div", FOOTERS, inside)]))

    def paragraph(self) -> str:
        draw, roll = self.draw, self.draw.random()
        if roll < 0.6:
            text = self.words(*draw.choice([(1, 6), (8, 40), (30, 90)]))
            if draw.random() < 0.2:
                text = f"{text} {self.link()} {self.words(2, 20)}"
            return draw.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>",
                                f"<div>{text}</div>"])
        if roll < 0.7:
            tag = draw.choice(["h2", "h3", "h4"])
            return f"<{tag}>{self.words(1, 8)}</{tag}>"
        if roll < 0.8:
            return "<ul>" + "".join(f"<li>{self.words(1, 25)}" for _ in range(draw.randint(2, 6))) + "</ul>"
        if roll < 0.86:
            return f"<blockquote><p>{self.words(5, 40)}</p></blockquote>"
        if roll < 0.9:
            return f"<pre>{self.words(5, 30)}</pre>"
        if roll < 0.95:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 5)}<td>{self.words(1, 8)}"
                                       for _ in range(draw.randint(1, 4))) + "</table>"
        return f"<figure><img src=x><figcaption>{self.words(3, 20)}</figcaption></figure>"

    def article(self) -> str:
        draw = self.draw
        title = f"<h1>{self.words(1, 12)}</h1>" if draw.random() < 0.85 else ""
        if title and draw.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [title]
        for _ in range(draw.choice([1, 2, 4, 7, 12])):
            parts.append(self.paragraph())
            if draw.random() < 0.15:
                parts.append(draw.choice([self.advert, self.share, self.form, self.side, self.notice])())
        inside = "".join(parts)
        kind = draw.randrange(6)
        if kind <= 1:
            return f'<article{self.marks(ARTICLES, 0.3)} data-main="1">{inside}</article>'
        if kind == 2:
            return f'<main{self.marks(ARTICLES, 0.3)} data-main="1">{inside}</main>'
        if kind == 3:
            return f'<main><article data-main="1">{inside}</article></main>'
        tag = draw.choice(["div", "div", "section"])
        return f'<{tag}{self.marks(ARTICLES, 0.85)} data-main="1">{inside}</{tag}>'

    def page(self) -> str:
        draw = self.draw
        some = lambda part, chance: part() if draw.random() < chance else ""
        before = [some(self.notice, 0.25), some(self.header, 0.5), some(self.menu, 0.7),
                  some(self.advert, 0.4), some(self.side, 0.2), some(self.form, 0.1)]
        after = [some(self.share, 0.2), some(self.comments, 0.35), some(self.side, 0.3),
                 some(self.advert, 0.3), some(self.form, 0.2), some(self.notice, 0.1)]
        draw.shuffle(after)
        body = "".join([*before, self.article(), *after, some(self.footer, 0.8)])
        if draw.random() < 0.3:
            body = f"<div{self.marks(WRAPPERS, 0.8)}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{body}" + (
            "</body></html>" if draw.random() < 0.8 else "")


def labelled_pages(texts: list[str], n: int, seed: int = 11) -> list[str]:
    """Pages with articles and other parts made of the texts, marked by data-main."""
    texts = [t for t in texts if len(t.split()) >= 12]
    return [_Layout(texts, random.Random(seed * 100_003 + i)).page() for i in range(n)]
