"""Token ids of whole texts by a ``tokenizers`` file, with a bounded cache of encoded words.

A byte-level BPE with the usual word pattern never joins a space followed by a visible
character to what stands before it, so a text may be cut before such spaces and the parts
encoded on their own.  Parts repeat: those of a block of texts are told apart by a 64-bit
hash, only unseen ones go through the tokenizer, and their ids (little-endian unsigned 32-bit)
are kept in two generations of little over ``MOST`` entries each, in flat arrays (some 30 bytes an entry).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from carelake.llm.common import CACHES, Rolling

MOST, LONGEST = 400_000, 64
BLOCK_CHARS = 1 << 20
_CUT = re.compile(" (?=[!-~])")
#: Bytes that may follow a cut: visible ASCII and lead bytes of letters none of which is a space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE0] = True
_VISIBLE[0xE4:] = True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _spans(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[begin: begin + size]`` of all spans, one after the other."""
    upto = np.cumsum(sizes)
    return flat[np.repeat(begin - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]


class Known:
    """Ids by the hash of their part: sorted hashes, and where their ids lie in one flat array."""

    def __init__(self):
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.begin, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are here, and the places of these."""
        at = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        there[inside] = self.keys[at[inside]] == keys[inside]
        return there, at[there]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries at these places, one after the other, and how many each has."""
        sizes = self.sizes[at].astype(np.int64)
        return _spans(self.flat, self.begin[at].astype(np.int64), sizes), sizes

    def add(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """New entries, in any order; none of their hashes is here."""
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(self.keys, keys[order])
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.keys = np.insert(self.keys, at, keys[order])
        self.begin = np.insert(self.begin, at, begin[order])
        self.sizes = np.insert(self.sizes, at, sizes[order])
        self.flat = np.concatenate([self.flat, flat])


class Encoder:
    """Encodes texts to id bytes; one per Python worker and tokenizer file."""

    _made: dict[str, Encoder] = {}
    most = MOST

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == space]] = True
        self.young, self.old = Known(), Known()
        self.rolling = Rolling(1)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Id bytes of each text, in order; texts are taken in blocks of bounded size."""
        block: list[str] = []
        owners: list[int] = []  # pieces of a text that is longer than a block carry its number
        done: list[bytes] = []
        size = at = 0
        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                block.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= BLOCK_CHARS:
                    for owner, ids in zip(owners, self._block(block), strict=True):
                        while at < owner:
                            yield b"".join(done)
                            done, at = [], at + 1
                        done.append(ids)
                    block, owners, size = [], [], 0
        for owner, ids in zip(owners, self._block(block), strict=True):
            while at < owner:
                yield b"".join(done)
                done, at = [], at + 1
            done.append(ids)
        if texts:
            yield b"".join(done)

    @staticmethod
    def _pieces(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > BLOCK_CHARS and (found := _CUT.search(text, at + BLOCK_CHARS)):
            yield text[at: found.start()]
            at = found.start()
        yield text[at:] if at else text

    def _fresh(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _words(self, words: list[str], together: int = 200) -> list[bytes]:
        """Ids of parts that are a space and no other space, many to a call.

        In the ids of joined words, a word begins at each id whose token begins with a space.
        """
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            groups = [words[i: i + together] for i in range(at, min(at + 20_000, len(words)), together)]
            for group, found in zip(groups, self._fresh(["".join(g) for g in groups]), strict=True):
                starts = (np.flatnonzero(self.opens[np.frombuffer(found, "<u4")]) * 4).tolist()
                if len(starts) == len(group):
                    out += [found[a:b] for a, b in zip(starts, starts[1:] + [len(found)], strict=True)]
                else:
                    out += self._fresh(group)
        return out

    def _cuts(self, values: np.ndarray) -> np.ndarray:
        """Where a part may begin."""
        cut = np.zeros(len(values), bool)
        cut[:-1] = (values[:-1] == 0x20) & _VISIBLE[values[1:]]
        return cut

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        plain = [p[0] == 0x20 and len(p) > 1 and bool(_VISIBLE[p[1]]) and p.count(b" ") == 1 for p in parts]
        words = iter(self._words([p.decode() for p, yes in zip(parts, plain, strict=True) if yes]))
        others = iter(self._fresh([p.decode() for p, yes in zip(parts, plain, strict=True) if not yes]))
        return [next(words if yes else others) for yes in plain]

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = b"".join(raw)
        if not data:
            yield from (b"" for _ in texts)
            return
        values = np.frombuffer(data, np.uint8)
        if len(self.rolling.up) <= len(values):
            self.rolling = Rolling(len(values) + len(values) // 4)
        edges = np.cumsum([0] + [len(r) for r in raw])
        cut = self._cuts(values)
        cut[edges[:-1][edges[:-1] < len(values)]] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(values)]
        hashes = self.rolling.ranges(self.rolling.prefix(values), starts, ends)
        hashes ^= (ends - starts).astype(np.uint64) << np.uint64(48)
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        flat, begin, sizes = self._look_up(different, data, starts[first], ends[first])
        lengths = sizes[which]
        ids = _spans(flat, begin[which], lengths)
        part = np.searchsorted(starts, edges)  # the first part of each text
        places = np.r_[0, np.cumsum(lengths)][part]
        for a, b in zip(places[:-1], places[1:], strict=True):
            yield ids[a:b].tobytes()

    def _look_up(self, keys: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of all parts in one array (in any order), where those of each key begin, and how many they are."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, Known()
        in_young, at_young = self.young.find(keys)
        in_old, at_old = self.old.find(keys)
        from_old = in_old & ~in_young
        missing = np.flatnonzero(~(in_young | in_old))
        young, young_sizes = self.young.take(at_young)
        old, old_sizes = self.old.take(at_old[from_old[in_old]])
        made = self._encode_parts([data[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)])
        made_sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        made_flat = np.frombuffer(b"".join(made), "<u4")
        order = np.r_[np.flatnonzero(in_young), np.flatnonzero(from_old), missing]
        ordered = np.r_[young_sizes, old_sizes, made_sizes]
        sizes, begin = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        sizes[order], begin[order] = ordered, np.cumsum(ordered) - ordered
        flat = np.concatenate([young, old, made_flat])
        fresh = np.r_[np.flatnonzero(from_old), missing[(ends - starts)[missing] <= LONGEST]]
        if len(fresh):
            self.young.add(keys[fresh], _spans(flat, begin[fresh], sizes[fresh]), sizes[fresh])
        return flat, begin, sizes


CACHES.append(Encoder._made.clear)
