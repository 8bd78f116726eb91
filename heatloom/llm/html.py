"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes a row of leaf blocks: runs of text between tags that start or end a block. A block's features are
its ancestors' tags, words of their class and id, and the form of its text. The chain has two states (main text or
not); its weights are fitted on labelled pages, and Viterbi decodes a page. The labelled pages
are generated from a seed: layouts vary in tags, class names, nesting and order, and each block's label is known.
Their number is the bounded sample on which the classifier is fitted.

Defined results: null, empty or text-free html gives an empty text; broken markup is read as far as it goes, open tags end with
the page; other columns pass through (text and n_chars are replaced).
"""

from __future__ import annotations

import bisect
import random
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unpacked, whole_row

#: Labelled pages on which the field is fitted.
TRAINING_PAGES = 500

# The HTML standard's block, void and unseen elements.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head iframe noscript object script style svg template title".split())
#: What a head can hold; any other start tag ends it, as its end tag may be left out.
IN_HEAD = set("base link meta noscript script style template title".split())
#: A start tag ends open elements of these names, up to an element that holds them.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Above:
    """What a block inherits from its ancestors; an element without new features shares its parent's."""

    __slots__ = ("blocky", "features")

    def __init__(self, blocky: tuple[str, ...], features: frozenset[str]) -> None:
        self.blocky, self.features = blocky, features

    def inside(self, tag: str, names: list[str], known) -> Above:
        new = {f"name:{n}" for n in names} | ({f"in:{tag}"} if tag not in ("html", "body") else set())
        new = {n for n in new if n not in self.features and (known is None or n in known)}
        blocky = (*self.blocky, tag)[-2:] if tag in BLOCK and tag not in ("html", "body") else self.blocky
        if not new and blocky == self.blocky:
            return self
        return Above(blocky, self.features | new if new else self.features)


class Blocks(HTMLParser):
    """Collects leaf blocks: text, link characters and what their ancestors give them. Open elements are found by name, so
    that a page of any depth takes time in proportion to its length."""

    def __init__(self, known=None) -> None:
        super().__init__(convert_charrefs=True)
        self.known = known
        self.open: list[str] = []
        self.above = [Above((), frozenset())]
        self.places: dict[str, list[int]] = {}  # of each open name, in order
        self.blocks: list[int] = []  # places of open blocks
        self.firm: list[int] = []  # of those but paragraphs
        self.unseen = self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.found: list[tuple[str, float, Above]] = []

    def end_block(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.found.append((text, min(1.0, self.linked / len(text)), self.above[-1]))
        self.text, self.linked = [], 0

    def push(self, tag: str, names: list[str]) -> None:
        i = len(self.open)
        self.open.append(tag)
        self.above.append(self.above[-1].inside(tag, names, self.known))
        self.places.setdefault(tag, []).append(i)
        if tag in BLOCK:
            self.blocks.append(i)
            if tag != "p":
                self.firm.append(i)
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def pop(self, n: int) -> None:
        while len(self.open) > n:
            tag = self.open.pop()
            self.above.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                if tag != "p":
                    self.firm.pop()
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a name, or -1."""
        return self.places[tag][-1] if self.places.get(tag) else -1

    def end_head(self) -> None:
        if self.open and self.open[-1] == "head":
            self.pop(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCK:
            self.end_block()
            if tag == "body" and self.places.get("head"):
                self.pop(self.places["head"][0])
            # open paragraphs, and elements that this one follows, end up to the element that holds it
            held = max((self.last(t) for t in HOLDS[tag]), default=-1) if tag in ENDS else self.firm[-1] if self.firm else -1
            ended = [own[k] for t in {"p", *ENDS.get(tag, ())} if (own := self.places.get(t)) and (k := bisect.bisect_right(own, held)) < len(own)]
            if ended:
                self.pop(min(ended))
        elif tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            self.push(tag, [w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in NAME.findall(v)])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag == "svg":  # of the unseen elements only this one can close itself
            self.pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_block()
        i = self.last(tag)
        if i >= 0 and (tag in BLOCK or tag in UNSEEN or not self.blocks or i > self.blocks[-1]):
            self.pop(i)

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if not self.unseen:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaf_blocks(html: str | None, known=None) -> list[tuple[str, float, Above]]:
    """Blocks of a page. known: features that are of use; others need not be kept."""
    page = Blocks(known)
    page.feed(html or "")
    page.close()
    page.end_block()
    return page.found


def features(blocks: list) -> list[list[str]]:
    out = []
    for text, linked, above in blocks:
        own = {"bias", f"leaf:{above.blocky[-1] if above.blocky else '-'}", f"pair:{'>'.join(above.blocky)}", f"words:{min(8, len(text.split()).bit_length())}", f"linked:{int(4 * linked)}"}
        own |= above.features
        own.add(f"ends:{text[-1] if text[-1] in '.!?:;' else 'x'}")
        own.add(f"stops:{min(3, sum(text.count(c) for c in '.!?'))}")
        if "©" in text:
            own.add("copyright")
        own.add("first" if not out else "later")
        out.append(sorted(own))
    return out


# --- labelled pages ---

SYLLABLES = "an the on ti re er in ed st ou nd ha to en ly of th ing ion ent que les der und ier cho par con ado ver mit ge ra mi lo sa".split()
MAIN_NAMES = ["content", "post", "entry", "story", "article-body", "main-content", "postContent", "text", "page-content", "body-text", "single", "blog-post"]
# What surrounds an article, with the tags and names it usually has.
AROUND = {
    "menu": (["nav", "div", "ul"], ["menu", "nav", "navbar", "main-menu", "breadcrumb", "navigation", "toc", "links"]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "top-bar", "branding", "logo"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "bottom", "colophon", "legal"]),
    "side": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "more", "rail", "tags", "share", "social", "author"]),
    "notice": (["div", "section", "aside", "p"], ["cookie", "notice", "consent", "banner", "gdpr", "alert", "newsletter", "subscribe", "modal", "popup", "privacy", "disclaimer"]),
    "advert": (["div", "aside", "section", "ins"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "adsbox", "sponsor"]),
    "form": (["form"], ["form", "search", "login", "signup", "contact"]),
    "comment": (["div", "section", "ol", "ul"], ["comments", "comment", "replies", "discussion", "responses", "reply", "respond", "thread"]),
}


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """Html and the label of each leaf block."""
    labels: list[int] = []

    def words(a, b):
        return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b))]

    def sentence(a, b):
        return " ".join(words(a, b)).capitalize() + rng.choice(["", ".", ".", ".", "!"])

    def prose(a, b):
        return " ".join(sentence(4, 16) for _ in range(rng.randint(a, b)))

    def leaf(tag, text, label, inner=None):
        labels.append(label)
        text = f"<{inner}>{text}</{inner}>" if inner else text
        return f"<{tag}>{text}" + ("" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>")

    def around(kind):
        tags, names = AROUND[kind]
        tag = rng.choice(tags)
        plain = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        attr = "" if plain else f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'
        if rng.random() < 0.3 or tag == "p":
            labels.append(0)
            text = prose(1, 3) if kind in ("notice", "comment", "side") else sentence(1, 14)
            return f"<{tag}{attr}>{'&copy; ' if kind == 'footer' else ''}{text}</{tag}>"
        inside = []
        for _ in range(rng.randint(1, 6)):
            if kind in ("menu", "side", "footer", "header") and rng.random() < 0.7:
                inside.append(leaf("li" if kind != "header" else "div", " ".join(words(1, 5)), 0, "a"))
            elif kind == "form":
                inside.append(leaf(rng.choice(["label", "button", "option", "p"]), " ".join(words(1, 4)), 0))
            elif kind == "comment":
                inside.append(leaf(rng.choice(["p", "li", "div"]), prose(1, 6), 0))
            else:
                inside.append(leaf(rng.choice(["p", "div", "h3", "p"]), rng.choice([sentence(1, 10), prose(1, 3)]), 0))
        body = "".join(inside)
        if kind == "menu" and tag != "ul":
            body = f"<ul>{body}</ul>"
        return f"<{tag}{attr}>{body}</{tag}>"

    out = []
    for kind in rng.sample(["menu", "header", "notice", "advert", "side", "form"], rng.randint(1, 5)):
        out.append(around(kind))
    tag = rng.choice(["article", "article", "main", "div", "section"])
    attr = "" if tag in ("article", "main") and rng.random() < 0.6 else f' class="{rng.choice(MAIN_NAMES)}"'
    body = [leaf(rng.choice(["h1", "h1", "h2"]), sentence(2, 12), 1)] if rng.random() < 0.9 else []
    for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
        r = rng.random()
        if r < 0.72:
            body.append(leaf("p", prose(1, 8), 1, rng.choice([None, None, None, "b", "em"])))
        elif r < 0.78:
            body.append(leaf("p", sentence(1, 6), 1))
        elif r < 0.83:
            body.append(leaf(rng.choice(["h2", "h3"]), sentence(1, 8), 1))
        elif r < 0.87:
            body.append("<ul>" + "".join(leaf("li", sentence(2, 14), 1) for _ in range(rng.randint(1, 4))) + "</ul>")
        elif r < 0.90:
            body.append(leaf("blockquote", prose(1, 3), 1))
        elif r < 0.93:
            body.append("<table><tr>" + "".join(leaf("td", " ".join(words(1, 4)), 1) for _ in range(rng.randint(1, 4))) + "</tr></table>")
        else:
            body.append(around(rng.choice(["advert", "side", "notice", "comment", "form"])))
    if rng.random() < 0.3:
        body.append(around("comment"))
    out.append(f"<{tag}{attr}>{''.join(body)}</{tag}>")
    for kind in rng.sample(["footer", "side", "comment", "notice", "advert", "menu", "form"], rng.randint(1, 5)):
        out.append(around(kind))
    return f"<html><head><title>{sentence(2, 8)}</title><style>p{{margin:0}}</style></head><body>{''.join(out)}</body></html>", labels


# --- the field ---


class Field:
    """A two-state linear-chain conditional random field."""

    def __init__(self, known: dict[str, int], weight: np.ndarray, step: np.ndarray) -> None:
        self.known, self.weight, self.step = known, weight, step  # weight: features x 2, step: 2 x 2

    @staticmethod
    def score(rows: list[list[int]], weight: np.ndarray) -> np.ndarray:
        return np.array([weight[r].sum(axis=0) for r in rows]).reshape(-1, 2)

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.3, penalty: float = 1e-3) -> Field:
        """Maximum conditional likelihood with an L2 penalty, by adaptive gradient steps over all pages."""
        known: dict[str, int] = {}
        size = max(len(y) for _, y in pages)
        flat, row, gold = [], [], np.zeros((len(pages), size), np.int64)
        live = np.zeros((len(pages), size), bool)
        for p, (blocks, y) in enumerate(pages):
            for t, names in enumerate(blocks):
                ids = [known.setdefault(n, len(known)) for n in names]
                flat += ids
                row += [p * size + t] * len(ids)
            gold[p, : len(y)], live[p, : len(y)] = y, True
        flat, row = np.array(flat), np.array(row)
        weight, step = np.zeros((len(known), 2)), np.zeros((2, 2))
        seen_w, seen_s = np.full_like(weight, 1e-8), np.full_like(step, 1e-8)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        truth = np.eye(2)[gold] * live[:, :, None]
        pairs = (live[:, 1:] & live[:, :-1])[:, :, None, None]
        true_pairs = (truth[:, :-1, :, None] * truth[:, 1:, None, :] * pairs).sum(axis=(0, 1))
        for _ in range(rounds):
            unary = np.zeros((len(pages) * size, 2))
            unary[row[first]] = np.add.reduceat(weight[flat], first)
            unary = unary.reshape(len(pages), size, 2)
            fore, back = np.zeros_like(unary), np.zeros_like(unary)
            fore[:, 0] = unary[:, 0]
            for t in range(1, size):
                f = unary[:, t] + np.logaddexp.reduce(fore[:, t - 1, :, None] + step, axis=1)
                fore[:, t] = np.where(live[:, t, None], f, fore[:, t - 1])
            for t in range(size - 2, -1, -1):
                b = np.logaddexp.reduce(step + (unary[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
                back[:, t] = np.where(live[:, t + 1, None], b, 0)
            total = np.logaddexp.reduce(fore[:, -1], axis=1)[:, None, None]
            chance = np.exp(fore + back - total) * live[:, :, None]
            both = np.exp(fore[:, :-1, :, None] + step + (unary + back)[:, 1:, None, :] - total[:, :, :, None]) * pairs
            delta = (chance - truth).reshape(-1, 2)
            slope = np.stack([np.bincount(flat, delta[row, k], len(known)) for k in range(2)], axis=1) / len(pages) + penalty * weight
            slope_s = (both.sum(axis=(0, 1)) - true_pairs) / len(pages) + penalty * step
            seen_w += slope**2
            seen_s += slope_s**2
            weight -= rate * slope / np.sqrt(seen_w)
            step -= rate * slope_s / np.sqrt(seen_s)
        return cls(known, weight, step)

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """The likeliest states, by Viterbi."""
        if not blocks:
            return []
        unary = self.score([[self.known[n] for n in names if n in self.known] for names in blocks], self.weight)
        best, back = unary[0], []
        for u in unary[1:]:
            paths = best[:, None] + self.step
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + u
        state = [int(best.argmax())]
        for choice in reversed(back):
            state.append(int(choice[state[-1]]))
        return state[::-1]


@lru_cache(maxsize=2)
def fitted(pages: int = TRAINING_PAGES, seed: int = 7) -> Field:
    rng = random.Random(seed)
    rows = []
    for _ in range(pages):
        html, labels = labelled_page(rng)
        blocks = leaf_blocks(html)
        assert len(blocks) == len(labels), "each leaf block has a label"
        rows.append((features(blocks), labels))
    return Field.fit(rows)


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html, field.known)
    return "\n\n".join(b[0] for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, html_col: str = "html", field: Field | None = None) -> DataFrame:
    """pages without html_col, with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(field or fitted())  # bounded by the features of the training pages
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(lambda x: main_text(x, shared.value))

    rows = pages.select(whole_row(pages).alias("row"))
    out = rows.select("row", text_of(F.coalesce(F.col("row").getField(html_col), F.lit(""))).alias("text"))
    return out.select(*unpacked(names), "text", F.length("text").cast("long").alias("n_chars"))
