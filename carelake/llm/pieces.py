"""SentencePiece encoding and decoding with the lattice of a piece table.

A text becomes words (a run of the space mark and what follows; also cut wherever no
piece holds both neighbours, which no segmentation can cross).  The different words of a
block of texts form one lattice: all substrings of at most the longest piece's characters are
laid out, joined to the piece table by hash, and the found edges stand by word.  A fold over
each word's edges gives its segmentation, all words in step: Viterbi (the path of greatest
score) for unigram models, merging (the best adjacent pair first, the leftmost of equals)
for BPE models, whose result no path score gives.  Characters without a piece become byte pieces.
Ids of frequent words are kept in a bounded cache.  ``decode`` inverts it.

Defined cases: null or empty text has no ids; null or empty ids decode to empty text; an
empty table gives no row; ids are carried as they are, null or repeated ones too; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from carelake.llm.common import CACHES, Rolling, as_number, as_text, pick
from carelake.llm.tokens import BLOCK_CHARS, Encoder, Known

MARK = "▁"
LONG_WORD, TOGETHER, ROWS = 64, 20_000, 250
NONE = np.iinfo(np.int64).max
UNKNOWN_PENALTY = 10.0


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: numbers and values."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at: at + size]
        at += size


class Model:
    """The piece table and settings of a model file."""

    # fixed values of the format: kinds of pieces and of models
    NORMAL, CONTROL, USER, BYTE, UNIGRAM, BPE = 1, 3, 4, 6, 1, 2

    def __init__(self, data: bytes):
        self.pieces: list[bytes] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.prefix, self.squeeze, rules = self.UNIGRAM, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b""))
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, self.NORMAL))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, self.UNIGRAM)
            elif field == 3:
                settings = dict(_fields(value))
                self.prefix, self.squeeze = bool(settings.get(3, 1)), bool(settings.get(4, 1))
                rules = settings.get(2, b"")
        self.kinds = np.array(kinds)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == self.BYTE}
        if rules or self.squeeze or self.kind not in (self.UNIGRAM, self.BPE) or len(self.bytes) < 256:
            raise ValueError("only unigram and BPE models with byte pieces and without text normalisation are supported")


class PieceEncoder(Encoder):
    """Encodes texts to ids; one per Python worker and model."""

    _made: dict[str, PieceEncoder] = {}
    most = 150_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._prepare(Model(f.read()))

    @classmethod
    def from_model(cls, model: Model) -> PieceEncoder:
        made = cls.__new__(cls)
        made._prepare(model)
        return made

    def _prepare(self, model: Model) -> None:
        self.model = model
        self.young, self.old, self.rolling = Known(), Known(), Rolling(1)
        usable = [i for i, k in enumerate(model.kinds) if k in (Model.NORMAL, Model.USER)]
        self.longest = max(len(model.pieces[i].decode()) for i in usable)
        mark = MARK.encode()
        for i in usable:
            if mark in model.pieces[i].lstrip(mark):
                raise ValueError("a piece holds a space mark after another character")
        data = np.frombuffer(b"".join(model.pieces[i] for i in usable), np.uint8)
        size = np.array([len(model.pieces[i]) for i in usable])
        ends = np.cumsum(size)
        self.lattice_rolling = Rolling(max(len(data), 1 << 16))
        keys = self.lattice_rolling.ranges(self.lattice_rolling.prefix(data), ends - size, ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable)[order]
        # ranks by score, the best first; equal scores share a rank
        self.scores = np.array(model.scores)
        self.rank = np.unique(-self.scores, return_inverse=True)[1]
        self.unknown = float(self.scores[usable].min()) - UNKNOWN_PENALTY
        self.pair = np.zeros((256, 256), bool)
        inside = np.ones(len(data), bool)
        inside[ends - 1] = False
        at = np.flatnonzero(inside)
        self.pair[data[at], data[at + 1]] = True
        self.byte_ids = np.array([model.bytes[b] for b in range(256)], "<u4")

    # --- from texts to words ---------------------------------------------------------

    def _pieces(self, text: str) -> Iterator[str]:
        if not text:
            yield ""
            return
        text = (MARK if self.model.prefix else "") + text.replace(" ", MARK)
        at = 0
        while len(text) - at > BLOCK_CHARS:
            end = text.find(MARK, at + BLOCK_CHARS)
            while end > 0 and text[end - 1] == MARK:
                end = text.find(MARK, end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def _cuts(self, values: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(values) + 3, bool)
        mark[:-5] = (values[:-2] == 0xE2) & (values[1:-1] == 0x96) & (values[2:] == 0x81) if len(values) > 2 else False
        cut = np.zeros(len(values), bool)
        cut[3:] = mark[3:-3] & ~mark[: len(values) - 3]
        cut[1:] |= ~self.pair[values[:-1], values[1:]] & ((values[1:] & 0xC0) != 0x80)
        return cut

    # --- the lattice -----------------------------------------------------------------

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(parts)
        short = [i for i, p in enumerate(parts) if len(p) <= LONG_WORD]
        for at in range(0, len(short), TOGETHER):
            some = short[at: at + TOGETHER]
            for i, ids in zip(some, self._segment([parts[i] for i in some]), strict=True):
                out[i] = ids
        for i, p in enumerate(parts):
            if len(p) > LONG_WORD:
                out[i] = self._segment([p])[0] if self.model.kind == Model.UNIGRAM else self._merge_long(p)
        return out

    def _edges(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The piece of every substring: (first character, characters - 1) -> id or -1."""
        if len(self.lattice_rolling.up) <= len(values):
            self.lattice_rolling = Rolling(2 * len(values))
        prefix = self.lattice_rolling.prefix(values)
        edges = np.full((len(begin), self.longest), -1, np.int32)
        for n in range(1, min(self.longest, len(begin)) + 1):
            first = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1:])
            keys = self.lattice_rolling.ranges(prefix, begin[first], end[first + n - 1])
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[place] == keys
            edges[first[hit], n - 1] = self.ids[place[hit]]
        return edges

    def _segment(self, parts: list[bytes]) -> list[bytes]:
        values = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        begin = np.flatnonzero((values & 0xC0) != 0x80)
        end = np.r_[begin[1:], len(values)]
        word = np.repeat(np.arange(len(parts)), sizes)[begin]
        edges = self._edges(values, begin, end, word)
        fold = self._viterbi if self.model.kind == Model.UNIGRAM else self._merge
        first, length = fold(edges, word)
        found = edges[first, length - 1]
        out: list[list[bytes]] = [[] for _ in parts]
        known = found.astype("<u4").tobytes()
        for i, (w, f, piece) in enumerate(zip(word[first].tolist(), first.tolist(), found.tolist(), strict=True)):
            out[w].append(known[4 * i: 4 * i + 4] if piece >= 0 else self.byte_ids[values[begin[f]: end[f]]].tobytes())
        return [b"".join(x) for x in out]

    def _merge(self, edges: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE: in each word the best pair is merged until none is left; all words in step."""
        first, length = np.arange(len(word)), np.ones(len(word), np.int64)
        done_first, done_length = [], []
        while len(first):
            own = word[first]
            both = length[:-1] + length[1:]
            fits = (own[1:] == own[:-1]) & (both <= self.longest)
            piece = np.where(fits, edges[first[:-1], np.minimum(both, self.longest) - 1], -1)
            rank = np.append(np.where(piece >= 0, self.rank[piece], NONE), NONE)
            at = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
            best = np.minimum.reduceat(rank, at)
            spread = np.repeat(best, np.diff(np.r_[at, len(own)]))
            open_ = spread < NONE
            done_first.append(first[~open_])
            done_length.append(length[~open_])
            is_best = open_ & (rank == spread)
            places = np.flatnonzero(is_best)
            left = places[np.unique(own[places], return_index=True)[1]]  # the leftmost of each word
            length[left] += length[left + 1]
            keep = open_.copy()
            keep[left + 1] = False
            first, length = first[keep], length[keep]
        first, length = np.concatenate(done_first), np.concatenate(done_length)
        order = np.argsort(first)
        return first[order], length[order]

    def _viterbi(self, edges: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unigram: the path of greatest score through each word; all words in step."""
        start = np.r_[0, np.flatnonzero(np.diff(word)) + 1]
        size = np.diff(np.r_[start, len(word)])
        score = np.where(edges >= 0, self.scores[edges], -np.inf)
        score[:, 0] = np.where(edges[:, 0] >= 0, score[:, 0], self.unknown)
        best = np.full((len(start), int(size.max()) + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros(best.shape, np.int64)
        for e in range(1, best.shape[1]):
            live = np.flatnonzero(size >= e)
            for n in range(min(e, self.longest), 0, -1):
                value = best[live, e - n] + score[start[live] + e - n, n - 1]
                better = value > best[live, e]
                best[live[better], e], back[live[better], e] = value[better], n
        first, length = [], []
        e, live = size.copy(), np.arange(len(start))
        while len(live):
            n = back[live, e[live]]
            e[live] -= n
            first.append(start[live] + e[live])
            length.append(n)
            live = live[e[live] > 0]
        first, length = np.concatenate(first), np.concatenate(length)
        order = np.argsort(first)
        return first[order], length[order]

    def _merge_long(self, part: bytes) -> bytes:
        """BPE of one long word with a queue of pairs."""
        values = np.frombuffer(part, np.uint8)
        begin = np.flatnonzero((values & 0xC0) != 0x80)
        end = np.r_[begin[1:], len(values)]
        n = len(begin)
        edges = self._edges(values, begin, end, np.zeros(n, np.int64))
        length, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                both = length[i] + length[after[i]]
                if both <= self.longest and (piece := edges[i, both - 1]) >= 0:
                    heapq.heappush(queue, (int(self.rank[piece]), i, length[i], length[after[i]]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if length[i] != a or j >= n or length[j] != b:
                continue
            length[i], length[j] = a + b, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        out = []
        for i in range(n):
            if length[i]:
                piece = edges[i, length[i] - 1]
                out.append(np.array([piece], "<u4") if piece >= 0 else self.byte_ids[values[begin[i]: end[i]]])
        return np.concatenate(out).tobytes()

    # --- back ------------------------------------------------------------------------

    def decode(self, ids: bytes | None) -> str:
        """The text of id bytes."""
        if not ids:
            return ""
        if not hasattr(self, "raw"):
            back = {i: bytes([b]) for b, i in self.model.bytes.items()}
            self.raw = [back.get(i, b"" if k == Model.CONTROL else p) for i, (p, k) in enumerate(zip(self.model.pieces, self.model.kinds, strict=True))]
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text


CACHES.append(PieceEncoder._made.clear)


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for at in range(0, len(f), ROWS):
            yield f.iloc[at: at + ROWS]


def encode(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every document."""
    path = model or model_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder.of(path)
        for f in _slices(frames):
            texts = [t if isinstance(t, str) else "" for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "ids": list(encoder.encode(texts))})

    return as_number(as_text(pick(docs, doc_id=doc_id, text=text), "doc_id").mapInPandas(run, "doc_id string, ids binary"), "doc_id")


def decode(encoded: DataFrame, model: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of every encoded document."""
    path = model or model_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder.of(path)
        for f in _slices(frames):
            yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "text": [encoder.decode(bytes(x) if x is not None else b"") for x in f["ids"]]})

    return as_number(as_text(pick(encoded, doc_id=doc_id, ids=ids), "doc_id").mapInPandas(run, "doc_id string, text string"), "doc_id")


def round_trip(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, text decoded from the ids, of every document: both ways in one pass."""
    path = model or model_path()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder.of(path)
        for f in _slices(frames):
            found = list(encoder.encode([t if isinstance(t, str) else "" for t in f["text"]]))
            yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "n_ids": [len(x) // 4 for x in found],
                                "ids_crc32": [zlib.crc32(x) for x in found], "text": [encoder.decode(x) for x in found]})

    found = as_text(pick(docs, doc_id=doc_id, text=text), "doc_id").mapInPandas(run, "doc_id string, n_ids long, ids_crc32 long, text string")
    return as_number(found, "doc_id")
