"""HTML extraction: a recurrent labeller marks every text block of a page as main text or not.

A page is cut into leaf blocks in page order. A block is read as two vectors: the sum of hashed vectors of the
tokens of its tag path (tags, classes and ids of all open elements) and the mean of hashed vectors of its words.
A bidirectional LSTM in numpy reads the whole sequence, so each label has the context of the entire document.
Blocks labelled as main text are the page's text.

The model is trained here, on a sample of at most ``FIT_PAGES`` pages (smallest hashes of the page id; the bound
is a parameter). The teacher marks the sample's blocks by structure (``teacher``); as one site shows few
layouts, its texts are also set anew into random layouts, whose labels are known from how they were made.
The model has a fixed size; extraction reads each page once and shuffles nothing.

Defined cases: null or empty html gives an empty text; a page without blocks or without main text does, too;
broken markup (open tags, comments, scripts) runs to where a browser would close it or to the end; repeated
rows give repeated results; an empty table trains on made-up layouts alone and returns no row.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 200
MADE_UP = 700
HIDDEN, PATH_SIZE, WORD_SIZE, WORD_PLACES = 20, 64, 12, 4096
EPOCHS, BATCH, RATE = 10, 16, 0.01
#: A page's padded steps in one batch of the forward pass.
STEPS = 40_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|select)\b(?>[^\"'<>]+|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<[a-zA-Z/!?](?>[^\"'<>]+|\"[^\"]*\"|'[^']*'|[\"'])*+>"
    r"|[^<]+|<", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements that hold no content, and elements that stand within a line of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
#: Elements and words in class, id or role that mark what is not the article.
OTHER_TAGS = frozenset("nav header footer aside form button menu dialog figcaption head".split())
OTHER_WORDS = frozenset("ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies "
                        "disclaimer footer form header login masthead menu modal nav navbar navigation newsletter "
                        "notice pager pagination popup promo promoted related reply replies share sharing sidebar "
                        "signup social sponsor sponsored subscribe toolbar widget".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article content entry main post story text".split())


def names_in(tag: str) -> list[str]:
    """Words of the class, id and role of a start tag."""
    if "=" not in tag:
        return []
    found = []
    for kind, a, b, c in NAMES.findall(tag):
        found += [w for w in re.split(r"[^a-z0-9]+", (a or b or c).lower()) if w]
    return found


def blocks_of(page: str) -> list[tuple[str, str]]:
    """``(tag path, text)`` of the leaf blocks in page order; a path's tokens are parted by spaces."""
    found, path, parts, at = [], [], [], ""

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((at, text))
            parts.clear()

    for match in MARKUP.finditer(page):
        piece = match[0]
        if piece[0] != "<" or piece == "<":
            if not parts:
                at = " ".join([token for _, token in path])
            parts.append(piece)
            continue
        tag = TAG.match(piece)
        if match[1] or not tag:
            continue  # comment, declaration, or an element whose content is no text of the page
        name = tag[2].lower()
        inline = name in INLINE
        if inline and name != "br":
            pass
        elif name == "br":
            parts.append(" ") if parts else None
            continue
        else:
            end_block()
        if tag[1]:
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] == name:
                    del path[i:]
                    break
        elif name not in VOID and not piece.endswith("/>"):
            if not inline:
                while path and (path[-1][0] in INLINE or path[-1][0] == "p" or path[-1][0] == name == "li"):
                    path.pop()  # a block ends an open paragraph, and its inline elements with it
            path.append((name, " ".join([name, *[f"{name}.{w}" for w in names_in(piece)]])))
    end_block()
    return found


def teacher(blocks: list[tuple[str, str]]) -> list[int]:
    """Labels by structure: 1 inside the article (or anywhere, on pages without one) and in nothing else."""
    inside, outside = [], []
    for path, _ in blocks:
        tokens = path.split()
        tags = {t for t in tokens if "." not in t}
        words = {t.split(".", 1)[1] for t in tokens if "." in t}
        outside.append(bool(tags & OTHER_TAGS or words & OTHER_WORDS))
        inside.append(bool(tags & MAIN_TAGS or words & MAIN_WORDS))
    some = any(inside)
    return [int(not out and (within or not some)) for within, out in zip(inside, outside)]


def made_up_page(texts: list[str], links: list[str], draw: random.Random) -> tuple[list[tuple[str, str]], list[int]]:
    """A random layout: paths, texts and labels of its blocks."""
    def line(most: int) -> str:
        words = draw.choice(texts).split()
        start = draw.randrange(max(1, len(words)))
        return " ".join(words[start:start + draw.randint(1, most)]) or "more"

    def other(around: str, tags: tuple[str, ...]) -> None:
        kinds = [("nav", "ul li a"), ("header", "p"), ("footer", "p"), ("aside", "p"), ("form", "label")]
        words = sorted(OTHER_WORDS)
        kind, inner = draw.choice(kinds) if draw.random() < 0.4 else \
            (f"{(box := draw.choice(('div', 'section', 'ul', 'p')))} {box}.{draw.choice(words)}",
             draw.choice(("", "p", "p a", "li a", "div p", "h3", "span")))
        for _ in range(draw.randint(1, 5)):
            blocks.append((f"{around} {kind} {inner}".strip(), draw.choice(links) if draw.random() < 0.4 else line(40)))
            labels.append(0)

    blocks, labels, around = [], [], "html body"
    if draw.random() < 0.5:
        around += draw.choice((" div", " div div", " div div.page", " div div.wrap"))
    body = around + draw.choice((" article", " main", " main article", " div div.content", " div div.post",
                                 " article article.post", " section section.story", " div div.article"))
    for _ in range(draw.randint(0, 4)):
        other(around, ())
    if draw.random() < 0.8:
        blocks.append((f"{body} h1", line(12)))
        labels.append(1)
    for _ in range(draw.randint(1, 9)):
        inner = draw.choice(("p",) * 8 + ("p b", "p a", "h2", "ul li", "blockquote p", "div p", "table tr td", "pre", ""))
        blocks.append((f"{body} {inner}".strip(), draw.choice(texts) if draw.random() < 0.6 else line(30)))
        labels.append(1)
        if draw.random() < 0.08:
            other(body, ())
    for _ in range(draw.randint(0, 4)):
        other(around if draw.random() < 0.8 else body, ())
    return blocks, labels


@functools.lru_cache(maxsize=200_000)
def path_vector(path: str) -> np.ndarray:
    """Sum of the hashed vectors of a path's distinct tokens."""
    tokens = sorted(set(path.split()))
    return np.sum([token_vector(t) for t in tokens], axis=0) if tokens else np.zeros(PATH_SIZE)


@functools.lru_cache(maxsize=50_000)
def token_vector(token: str) -> np.ndarray:
    # a class or id counts by its word, on whatever element it stands
    draw = np.random.default_rng(zlib.crc32(token.split(".", 1)[1].encode() + b"." if "." in token else token.encode()))
    return draw.normal(size=PATH_SIZE) / np.sqrt(PATH_SIZE) * 3


@functools.cache
def word_table() -> np.ndarray:
    return np.random.default_rng(5).normal(size=(WORD_PLACES, WORD_SIZE))


def inputs(blocks: list[tuple[str, str]]) -> np.ndarray:
    """``(blocks, PATH_SIZE + WORD_SIZE)`` of one page."""
    out, words = np.empty((len(blocks), PATH_SIZE + WORD_SIZE)), word_table()
    for row, (path, text) in zip(out, blocks):
        row[:PATH_SIZE] = path_vector(path)
        places = [zlib.crc32(w.encode()) % WORD_PLACES for w in text.split()]
        row[PATH_SIZE:] = words[places].mean(axis=0)
    return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(steps, pages, size)`` forwards and backwards, each page from step 0 on, and the pages' lengths."""
    sizes = np.array([len(p) for p in pages])
    ahead = np.zeros((sizes.max(), len(pages), pages[0].shape[1]))
    back = np.zeros_like(ahead)
    for i, page in enumerate(pages):
        ahead[:len(page), i], back[:len(page), i] = page, page[::-1]
    return ahead, back, sizes


def squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction; gates in the order input, forget, output, candidate."""

    def __init__(self, draw: np.random.Generator, size: int, hidden: int):
        self.w = draw.normal(size=(size, 4 * hidden)) / np.sqrt(size)
        self.u = draw.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)
        self.b = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.hidden = hidden

    def forward(self, x: np.ndarray, keep: bool = False) -> np.ndarray:
        steps, n, _ = x.shape
        k, fed = self.hidden, x @ self.w + self.b
        h, c, out = np.zeros((n, k)), np.zeros((n, k)), np.empty((steps, n, k))
        self.seen = []
        for t in range(steps):
            z = fed[t] + h @ self.u
            gates, new = squash(z[:, :3 * k]), np.tanh(z[:, 3 * k:])
            before, c = c, gates[:, k:2 * k] * c + gates[:, :k] * new
            if keep:
                self.seen.append((h, before, gates, new, c))
            h = out[t] = gates[:, 2 * k:] * np.tanh(c)
        return out

    def backward(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients of (w, u, b) for the slope of each step's output, after forward(keep=True)."""
        k = self.hidden
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh_next, dc_next = np.zeros_like(slope[0]), np.zeros_like(slope[0])
        for t in range(len(x) - 1, -1, -1):
            h, before, gates, new, c = self.seen[t]
            i, f, o = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:]
            dh, bent = slope[t] + dh_next, np.tanh(c)
            dc = dc_next + dh * o * (1 - bent * bent)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o),
                                 dc * i * (1 - new * new)], axis=1)
            dw += x[t].T @ dz
            du += h.T @ dz
            db += dz.sum(axis=0)
            dh_next, dc_next = dz @ self.u.T, dc * f
        return [dw, du, db]


class BlockLabeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.ahead, self.back = (Lstm(draw, PATH_SIZE + WORD_SIZE, HIDDEN) for _ in range(2))
        self.v, self.v0 = draw.normal(size=2 * HIDDEN) / np.sqrt(2 * HIDDEN), np.zeros(1)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.v0]

    def states(self, pages: list[np.ndarray], keep: bool = False) -> tuple:
        ahead, back, sizes = padded(pages)
        left, right = self.ahead.forward(ahead, keep), self.back.forward(back, keep)
        turned = np.zeros_like(right)
        for i, n in enumerate(sizes):
            turned[:n, i] = right[:n, i][::-1]
        return ahead, back, sizes, np.concatenate([left, turned], axis=2)

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of being main text, for each block of each page (pages with blocks only)."""
        *_, sizes, both = self.states(pages)
        chance = squash(both @ self.v + self.v0)
        return [chance[:n, i] for i, n in enumerate(sizes)]

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> None:
        draw = np.random.default_rng(3)
        mean, square = ([np.zeros_like(w) for w in self.weights()] for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            turn = draw.permutation(len(pages))
            for at in range(0, len(turn), BATCH):
                chosen = turn[at:at + BATCH]
                ahead, back, sizes, both = self.states([pages[i] for i in chosen], keep=True)
                error = squash(both @ self.v + self.v0)
                for column, (i, n) in enumerate(zip(chosen, sizes)):
                    error[:n, column] -= labels[i]
                    error[n:, column] = 0
                error /= sizes.sum()
                slope = error[..., None] * self.v
                turned = np.zeros_like(slope[..., HIDDEN:])
                for column, n in enumerate(sizes):
                    turned[:n, column] = slope[:n, column, HIDDEN:][::-1]
                slopes = [*self.ahead.backward(ahead, slope[..., :HIDDEN]), *self.back.backward(back, turned),
                          np.einsum("tn,tnk->k", error, both), np.array([error.sum()])]
                step += 1
                for w, g, m, s in zip(self.weights(), slopes, mean, square):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)


def train_labeller(sample: list[str]) -> BlockLabeller:
    """Teach a labeller the sample's own layouts and made-up ones with its texts."""
    draw = random.Random(7)
    cut = [b for b in map(blocks_of, sample) if b]
    texts = [t for blocks in cut for (_, t), y in zip(blocks, teacher(blocks)) if y] or ["one two three four five."]
    links = [t for blocks in cut for (_, t), y in zip(blocks, teacher(blocks)) if not y] or ["home", "about us"]
    examples = [(blocks, teacher(blocks)) for blocks in cut]
    examples += [made_up_page(texts, links, draw) for _ in range(MADE_UP)]
    model = BlockLabeller()
    model.train([inputs(blocks) for blocks, _ in examples], [np.array(y, float) for _, y in examples])
    return model


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES) -> BlockLabeller:
    """Train on at most ``fit_pages`` pages, in one task."""
    def train(group: pd.DataFrame) -> pd.DataFrame:
        model = train_labeller(group.sort_values(["id", "html"])["html"].to_list())
        return pd.DataFrame({"w": [[w.astype("float64").tobytes() for w in model.weights()]]})

    sample = (pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html"))
              .where("length(html) > 0").orderBy(F.xxhash64("id", "html"), "id").limit(fit_pages))
    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(train, "w array<binary>").first()
    if found is None:
        return train_labeller([])
    model = BlockLabeller()
    for w, saved in zip(model.weights(), found["w"]):
        w[...] = np.frombuffer(saved).reshape(w.shape)
    return model


def main_texts(pages: list[str], model: BlockLabeller) -> list[str]:
    """Main text of each page: its blocks labelled as such, joined by an empty line."""
    cut = [blocks_of(page) for page in pages]
    texts = [""] * len(pages)
    turn = sorted((i for i, blocks in enumerate(cut) if blocks), key=lambda i: len(cut[i]))
    while turn:
        some = [turn.pop()]  # the longest page left sets the number of steps
        while turn and (len(some) + 1) * len(cut[some[0]]) <= STEPS and 2 * len(cut[turn[-1]]) > len(cut[some[0]]):
            some.append(turn.pop())
        for i, chance in zip(some, model.chances([inputs(cut[i]) for i in some])):
            texts[i] = "\n\n".join([text for (_, text), p in zip(cut[i], chance) if p >= 0.5])
    return texts


def extract(pages: DataFrame, model: BlockLabeller, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` and ``n_chars`` (code points) at the end."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    own = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts([t or "" for t in part.column(1).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())],
                                                 names=["_page", "text"])

    packed = pages.select(F.struct(*own).alias("_page"), F.col(html_col).alias("_html"))
    schema = f"_page {packed.schema['_page'].dataType.simpleString()}, text string"
    return packed.mapInArrow(run, schema).select(
        *[F.col("_page")[c].alias(c) for c in own if c not in ("text", "n_chars")], "text",
        F.char_length("text").cast("long").alias("n_chars"))
