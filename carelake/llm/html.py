"""Main text of web pages: a bidirectional LSTM labels every block with the whole page as context.

A page is read into its sequence of leaf blocks, each with the tags and class or id words on
its path.  A block's vector holds hashed vectors of its path, hashed vectors of all its words
and a few counts.  The network (numpy, trained here) reads the sequence both ways and
labels each block as article or not; the blocks labelled article are the text.

There are no hand-made labels.  Training pages are at most ``SAMPLE`` rows (smallest hashes of
their ids), each as it is and again with its blocks put into other layouts; all of their blocks are
trained on, in sequences of at most ``LONGEST``; a block's label is what the layout says of
it (``LAYOUT_IN`` and ``LAYOUT_OUT``).  The names that give the labels are hidden in half of the copies: there the
network sees other names or none, and has to go by text, links, lengths, places and neighbours, so pages whose layout
uses names outside the lists are labelled too.  The copies are made in a task; the driver gets vectors only, of at most
``MOST_BLOCKS`` blocks (pages that don't fit what is left of it don't train).  Labelling covers every page.

Defined cases: null or empty html gives empty text; a page without any block too; unclosed and
misnested tags close as in browsers (a new block closes an open paragraph); a tag cut off by
the end of the page is dropped; an svg ending in "/>" is closed, other elements aren't; null and repeated ids are pages like any
other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import as_number, as_text, pick

SAMPLE, LONGEST, MOST_BLOCKS = 300, 400, 400_000
PATH_DIM, WORD_DIM, COUNTS = 48, 8, 4
HIDDEN, EPOCHS, BATCH, RATE = 16, 12, 32, 1e-2

# Element kinds of HTML, and words that layouts use for their parts.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template noscript svg iframe object textarea title".split())
LAYOUT_IN = frozenset("article main content entry post story".split())
LAYOUT_OUT = frozenset(
    "nav menu header footer aside sidebar ad ads advert advertisement sponsored promo banner cookie cookies consent notice "
    "alert popup modal form login signup newsletter subscribe search share social related breadcrumb breadcrumbs pagination "
    "comment comments reply replies disqus widget toolbar copyright button select dialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))[^>\"']*)*)(>|\Z)", re.DOTALL)
# A last "/" that belongs to an unquoted value closes nothing.
_UNQUOTED_END = re.compile(r"=\s*[^\s\"']*/\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: the words of its path (tags and names, outermost first), its text, characters in links."""

    path: tuple[str, ...]
    text: str
    linked: int


def read_blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    texts: list[tuple[str, bool]] = []
    at = 0

    def flush() -> None:
        if texts:
            raw = "".join(t for t, _ in texts)
            text = " ".join(entities.unescape(raw).split())
            if text:
                path = tuple(w for _, words in stack for w in words)
                out.append(Block(path, text, sum(len(t) for t, inside in texts if inside)))
            texts.clear()

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    n = len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else n
        if stop > at:
            texts.append((page[at:stop], any(tag == "a" for tag, _ in stack)))
        if not found:
            break
        at = found.end()
        tag = (found.group(2) or "").lower()
        if not tag or not found.group(4):
            continue
        if found.group(1):
            if tag in BLOCK_TAGS:
                flush()
            close(tag)
            continue
        if tag == "svg" and found.group(3).endswith("/") and not _UNQUOTED_END.search(found.group(3)):
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\s*>|\Z", re.IGNORECASE).search(page, at)
            if tag in BLOCK_TAGS:
                flush()
            at = end.end()
            continue
        if tag == "br":
            texts.append((" ", False))
        if tag in BLOCK_TAGS:
            flush()
            if any(t == "p" for t, _ in stack):
                close("p")
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
        if tag not in VOID_TAGS and not found.group(3).rstrip().endswith("/"):
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(found.group(3))).lower()
            stack.append((tag, (tag, *_WORD.findall(names))))
    flush()
    return out


def layout_label(path: tuple[str, ...]) -> bool:
    """What a layout says of a block: inside an article part and not in any other part."""
    return not LAYOUT_OUT.intersection(path) and bool(LAYOUT_IN.intersection(path))


_path_vectors: dict[str, np.ndarray] = {}
_WORD_TABLE = np.random.default_rng(3).choice([-1.0, 1.0], (1 << 12, WORD_DIM)).astype(np.float32) / np.sqrt(WORD_DIM)


class _Rows(dict):
    """word -> row of the word table; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = row = zlib.crc32(word.lower().encode("utf-8", "replace")) & 4095
        return row


_word_rows = _Rows()


def _path_vector(word: str) -> np.ndarray:
    if word not in _path_vectors:
        if len(_path_vectors) > 50_000:
            _path_vectors.clear()
        rng = np.random.default_rng(zlib.crc32(word.encode()))
        _path_vectors[word] = rng.choice([-1.0, 1.0], PATH_DIM) / np.sqrt(PATH_DIM) * 2
    return _path_vectors[word]


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: path, words, counts."""
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + COUNTS), np.float32)
    for row, b in zip(out, blocks, strict=True):
        for word in dict.fromkeys(b.path):
            row[:PATH_DIM] += _path_vector(word)
        words = b.text.split()
        row[PATH_DIM: PATH_DIM + WORD_DIM] = _WORD_TABLE[list(map(_word_rows.__getitem__, words))].mean(0)
        size = len(b.text)
        row[PATH_DIM + WORD_DIM:] = (np.log1p(size) / 5, min(b.linked / size, 1), len(b.path) / 10, b.text.count(".") / len(words))
    return out


class Network:
    """A bidirectional LSTM with a logistic output per step, for padded batches (steps, rows, inputs)."""

    def __init__(self, inputs: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        weights = lambda: rng.normal(0, 1 / np.sqrt(inputs + HIDDEN), (inputs + HIDDEN, 4 * HIDDEN))
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN: 2 * HIDDEN] = 1
        self.p = [weights(), bias.copy(), weights(), bias.copy(), rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)]

    def _pass(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool):
        steps, rows, _ = x.shape
        h, c = np.zeros((rows, HIDDEN), x.dtype), np.zeros((rows, HIDDEN), x.dtype)
        out, saved = np.zeros((steps, rows, HIDDEN), x.dtype), []
        fixed = x @ w[: x.shape[2]] + b
        for t in range(steps):
            gates = fixed[t] + h @ w[x.shape[2]:]
            s = 1 / (1 + np.exp(-gates[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN: 2 * HIDDEN], s[:, 2 * HIDDEN:]
            g = np.tanh(gates[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            squashed = np.tanh(c_new)
            h_new = np.where(m, o * squashed, h)
            if keep:
                saved.append((h, c, i, f, o, g, squashed, m))
            h, c = h_new, c_new
            out[t] = h
        return out, saved

    def _back(self, x: np.ndarray, w: np.ndarray, saved: list, up: np.ndarray):
        dw, db = np.zeros_like(w), np.zeros(w.shape[1])
        dh, dc = np.zeros_like(up[0]), np.zeros_like(up[0])
        n = x.shape[2]
        for t in range(len(saved) - 1, -1, -1):
            h, c, i, f, o, g, squashed, m = saved[t]
            dh = dh + up[t]
            do = np.where(m, dh * squashed, 0)
            inner = np.where(m, dh * o * (1 - squashed**2) + dc, 0)
            gates = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), do * o * (1 - o), inner * i * (1 - g**2)], 1)
            dw[:n] += x[t].T @ gates
            dw[n:] += h.T @ gates
            db += gates.sum(0)
            dh = np.where(m, gates @ w[n:].T, dh)
            dc = np.where(m, inner * f, dc)
        return dw, db

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2, v, a = (weights.astype(x.dtype) for weights in self.p)
        ahead, _ = self._pass(x, mask, w1, b1, False)
        behind, _ = self._pass(x[::-1], mask[::-1], w2, b2, False)
        return 1 / (1 + np.exp(-(ahead @ v[:HIDDEN] + behind[::-1] @ v[HIDDEN:] + a[0])))

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 13) -> Network:
        rng = np.random.default_rng(seed)
        first, second, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(pages))
            rate = RATE * (0.55 + 0.45 * np.cos(np.pi * epoch / EPOCHS))
            for at in range(0, len(order), BATCH):
                some = [pages[j] for j in order[at: at + BATCH]]
                x, mask = padded([s[0] for s in some])
                y = np.zeros(mask.shape)
                for j, (_, labels) in enumerate(some):
                    y[: len(labels), j] = labels
                w1, b1, w2, b2, v, a = self.p
                ahead, kept1 = self._pass(x, mask, w1, b1, True)
                behind, kept2 = self._pass(x[::-1], mask[::-1], w2, b2, True)
                joined = np.concatenate([ahead, behind[::-1]], 2)
                d = (1 / (1 + np.exp(-(joined @ v + a[0]))) - y) * mask / mask.sum()
                up = d[:, :, None] * v
                dw1, db1 = self._back(x, w1, kept1, up[:, :, :HIDDEN])
                dw2, db2 = self._back(x[::-1], w2, kept2, up[::-1, :, HIDDEN:])
                grads = [dw1, db1, dw2, db2, np.einsum("tr,trh->h", d, joined), np.array([d.sum()])]
                size = np.sqrt(sum((g * g).sum() for g in grads))
                step += 1
                for k, g in enumerate(grads):
                    g = g / max(1.0, size)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def padded(pages: list[np.ndarray], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), kind)
    mask = np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, True
    return x, mask


def relayouts(blocks: list[Block], rng: np.random.Generator, copies: int = 2, borrowed: float = 0.4) -> Iterator[list[Block]]:
    """The same blocks in other layouts: other names for the article, other parts around and within it.

    A share ``borrowed`` of the other parts' blocks holds text of the article, which only names tell apart."""
    inside = [b for b in blocks if layout_label(b.path)]
    outside = [b for b in blocks if not layout_label(b.path)] or blocks[:1]
    out_words, in_words = sorted(LAYOUT_OUT - BLOCK_TAGS), sorted(LAYOUT_IN - BLOCK_TAGS)
    out_tags = sorted(LAYOUT_OUT & BLOCK_TAGS)
    for _ in range(copies if inside else 0):
        shell = [("article",), ("main",), ("main", "article"), ("div", str(rng.choice(in_words))),
                 ("div", "wrapper", "article"), ("section", str(rng.choice(in_words)))][rng.integers(6)]

        def part(base: tuple[str, ...]) -> list[Block]:
            word = (str(rng.choice(out_tags)),) if rng.random() < 0.4 else (str(rng.choice(["div", "section", "ul", "span"])), str(rng.choice(out_words)))
            leaf = str(rng.choice(["p", "li", "div", "a", "h3", "span", "label"]))
            return [Block((*base, *word, leaf), outside[rng.integers(len(outside))].text if rng.random() >= borrowed
                          else inside[rng.integers(len(inside))].text, int(rng.integers(0, 40))) for _ in range(rng.integers(1, 6))]

        made: list[Block] = [b for _ in range(rng.integers(1, 4)) for b in part(("html", "body"))]
        for b in inside:
            tail = tuple(w for w in b.path if w not in LAYOUT_IN and w not in ("html", "body"))
            made.append(Block(("html", "body", *shell, *tail), b.text, b.linked))
            if rng.random() < 0.15:
                made += part(("html", "body", *shell))
        yield made + [b for _ in range(rng.integers(1, 4)) for b in part(("html", "body"))]


def hidden(blocks: list[Block], rng: np.random.Generator) -> list[Block]:
    """The same blocks with every listed name of their paths replaced: by nothing but a div, or by a name made up for this page."""
    nameless, names = rng.random() < 0.5, {}

    def words(w: str) -> tuple[str, ...]:
        if w not in LAYOUT_IN and w not in LAYOUT_OUT:
            return (w,)
        if nameless:
            return ("div",)
        if w not in names:
            names[w] = ("div", bytes(rng.integers(97, 123, 7).tolist()).decode())
        return names[w]

    return [Block(tuple(x for w in b.path for x in words(w)), b.text, b.linked) for b in blocks]


def layouts(blocks: list[Block], rng: np.random.Generator) -> Iterator[tuple[list[Block], list[bool]]]:
    """Every copy of a page that trains, with its labels."""
    label = lambda made: [layout_label(b.path) for b in made]
    for made in [blocks, *relayouts(blocks, rng)]:
        yield made, label(made)
    if any(label(blocks)):
        for made in [blocks, *relayouts(blocks, rng, 1, 0.0)]:
            yield hidden(made, rng), label(made)


def fit(pages: DataFrame, sample: int = SAMPLE, page_id: str = "page_id", html: str = "html", most_blocks: int = MOST_BLOCKS) -> Network | None:
    """A network trained on at most ``sample`` pages and their copies, ``most_blocks`` blocks at the most."""
    turn = F.xxhash64("page_id", F.lit("sample"))
    chosen = pick(pages, page_id=page_id, html=html).where(F.length("html") > 0).orderBy(turn, "page_id", "html").limit(sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the limit leaves one partition: one task sees all chosen pages in their order
        room = most_blocks
        for f in frames:
            for page in f["html"]:
                made = list(layouts(read_blocks(page), np.random.default_rng(zlib.crc32(page.encode("utf-8", "replace")))))
                size = sum(len(blocks) for blocks, _ in made)
                if size > room:
                    continue
                room -= size
                for blocks, labels in made:
                    for at in range(0, len(blocks), LONGEST):
                        yield pd.DataFrame({"x": [vectors(blocks[at: at + LONGEST]).tobytes()],
                                            "y": [np.array(labels[at: at + LONGEST], np.uint8).tobytes()]})

    made = chosen.select("html").mapInPandas(run, "x binary, y binary").toPandas()
    rows = []
    for x, y in zip(made["x"], made["y"], strict=True):
        labels = np.frombuffer(y, np.uint8).astype(float)
        rows.append((np.frombuffer(x, np.float32).reshape(len(labels), -1), labels))
    if not rows:
        return None
    return Network(rows[0][0].shape[1]).train(rows)


def extract(pages: DataFrame, model: Network | None = None, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or fit(pages, page_id=page_id, html=html)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at: at + 256]
                read = [read_blocks(h) if isinstance(h, str) and h else [] for h in part["html"]]
                texts = [""] * len(read)
                order = sorted((j for j, b in enumerate(read) if b), key=lambda j: len(read[j]))
                while order:
                    # pages of like length together, few where they are long
                    most = max(1, min(64, 8192 // len(read[order[-1]])))
                    some, order = order[-most:], order[:-most]
                    if shared.value is None:
                        continue
                    x, mask = padded([vectors(read[j]) for j in some], np.float32)
                    article = shared.value.probabilities(x, mask) >= 0.5
                    for k, j in enumerate(some):
                        texts[j] = "\n".join(b.text for b, yes in zip(read[j], article[:, k], strict=False) if yes)
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts,
                                    "n_chars": [len(t) for t in texts]})

    rows = as_text(pick(pages, page_id=page_id, url=url, html=html), "page_id")
    return as_number(rows.mapInPandas(run, "page_id string, url string, text string, n_chars long"), "page_id")
