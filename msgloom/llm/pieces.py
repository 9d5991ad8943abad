"""Exact tokenizer ids of many texts, by encoding each distinct piece of text once.

A text is cut only where the tokenizer can never join what stands left and right ("safe boundaries"), so the ids of
the whole text are the ids of its pieces in order. Pieces are hashed with NumPy for a whole batch of texts at a time
and looked up in a table that each Python worker keeps; only pieces that are not in it go through the tokenizer
library. Texts in which a boundary could be unsafe (unusual white space, the text of a special token) are given to the
library as a whole.

A piece is looked up by a 64-bit hash of its bytes and length.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LENGTH = np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's multiplier, and of its inverse modulo 2**64, for ``n`` positions."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20 if n <= 1 << 20 else 1 << 21)
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Spans:
    """64-bit hashes of any spans of ``data``, after one pass over it."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.down[starts]
        h += (ends - starts).astype(np.uint64) * _LENGTH
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        h[h == 0] = 1
        return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for every pair."""
    return Spans(data).hashes(starts, ends)


class PieceTable:
    """An open-addressing table from piece hashes to runs of ids, bounded in size (it starts anew when full)."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.n = self.used = 0
        self.counts = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def room_for(self, new: int) -> None:
        if self.n + new > 1 << (self.bits - 1) or self.used > 1 << 23:
            self.clear()

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        entry = np.where(found == h, self.slots[at], -1)
        open_ = np.flatnonzero((found != h) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == h[open_]
            entry[open_[hit]] = self.slots[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return entry

    def add(self, h: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        """Entries for distinct hashes that are not in the table: how many ids each has, and all ids in order."""
        for name, need in (("counts", self.n + len(h)), ("starts", self.n + len(h)), ("ids", self.used + len(flat))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        rows = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.counts[rows] = counts
        self.starts[rows] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(h), self.used + len(flat)
        at, left = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = h[free]
            won = free[self.keys[at[free]] == h[free]]
            self.slots[at[won]] = rows[won]
            left = left[self.keys[at[left]] != h[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)


def laid_out(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of ``lists``, and their numbers in order."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return counts, np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum()))


#: Bytes that count as white space for a boundary: tab to carriage return, and the space.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def single_pieces(encode: Callable, strip_space: bool = False) -> Callable:
    """Ids of pieces ``data[start:end]``, each encoded by itself: their order, how many ids each has, and all ids."""

    def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]
        if strip_space:
            texts = [x[1:] if x[:1] == " " else x for x in texts]
        return np.arange(len(texts)), *laid_out(encode(texts))

    return pieces


def joined_pieces(encode: Callable, sizes: np.ndarray, together: int = 200) -> Callable:
    """The same by few calls of ``encode``: pieces that start with a lone space are encoded one behind another.

    Their boundaries are safe in any order. ``sizes`` are the bytes that each id stands for, which tell where a piece ends.
    """
    alone = single_pieces(encode)

    def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fit = (data[starts] == 32) & (ends - starts > 1) & ~_SPACE[data[np.minimum(starts + 1, len(data) - 1)]] & ~_SPACE[data[ends - 1]]
        joint, other = np.flatnonzero(fit), np.flatnonzero(~fit)
        n = ends[joint] - starts[joint]
        upto = np.cumsum(n)
        if not len(joint):
            return alone(data, starts, ends)
        raw = data[np.repeat(starts[joint] - (upto - n), n) + np.arange(upto[-1])].tobytes()
        cuts = [0, *upto[together - 1 :: together].tolist()]
        cuts += [len(raw)] if cuts[-1] < len(raw) else []
        _, flat = laid_out(encode([raw[a:b].decode() for a, b in zip(cuts, cuts[1:])]))
        reached = np.cumsum(sizes[flat])
        last = np.searchsorted(reached, upto)
        if last[-1] != len(flat) - 1 or (reached[last] != upto).any():
            raise ValueError("an id reaches over a boundary that counts as safe")
        _, counts, more = alone(data, starts[other], ends[other])
        return np.concatenate([joint, other]), np.concatenate([np.diff(last, prepend=-1), counts]), np.concatenate([flat, more])

    return pieces


def _docs_at(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, positions, "right") - 1


def _find_all(raw: bytes, what: bytes) -> list[int]:
    found, at = [], raw.find(what)
    while at >= 0:
        found.append(at)
        at = raw.find(what, at + 1)
    return found


class PieceEncoder:
    """Ids of texts under one tokenizer file, exactly as its library gives them for the whole texts.

    ``encode`` maps whole texts to id lists, ``pieces`` encodes pieces (:func:`single_pieces`). ``unsafe`` flags texts of a buffer that
    must be encoded whole; ``newlines`` tells whether a single newline between two words stands alone.
    """

    def __init__(self, encode: Callable, strip_space: bool, newlines: bool, unsafe: Callable, pieces: Callable | None = None):
        self.encode, self.newlines, self.unsafe = encode, newlines, unsafe
        self.pieces = pieces or single_pieces(encode, strip_space)
        self.table = PieceTable()

    def _boundaries(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        space = _SPACE[data] if self.newlines else data == 32
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True
        alone = np.zeros(len(data), bool)
        alone[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
        alone &= ~first[:-1] & ~first[1:]
        cut = first[:-1] | (alone & (data == 32))
        if self.newlines:
            line = alone & (data == 10)
            cut |= line
            cut[1:] |= line[:-1]
        return np.flatnonzero(cut)

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = span_hashes(data, starts, ends)
        entry = self.table.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            size = self.table.n, self.table.used
            self.table.room_for(len(new))
            if (self.table.n, self.table.used) != size:  # it started anew: nothing of this batch is in it
                missing = np.arange(len(h))
                new, at = np.unique(h, return_index=True)
            at = missing[at]
            order, counts, flat = self.pieces(data, starts[at], ends[at])
            self.table.add(new[order], counts, flat)
            entry = self.table.find(h)
        return entry

    def runs(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """For texts ``data[offsets[i]:offsets[i+1]]``: how many ids each has, and all ids in order."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        whole = np.zeros(n, bool)
        if len(data):
            whole[self.unsafe(data, offsets[:-1][sizes > 0], np.flatnonzero(sizes > 0))] = True
        counts, flat = np.zeros(n, np.int64), []
        plain = np.flatnonzero(~whole & (sizes > 0))
        parts: dict[int, np.ndarray] = {}
        if len(plain):
            if whole.any():
                kept = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in plain])
            else:
                kept = data
            starts = np.cumsum(sizes[plain]) - sizes[plain]
            cuts = self._boundaries(kept, starts)
            entry = self._entries(kept, cuts, np.append(cuts[1:], len(kept)))
            per = self.table.counts[entry].astype(np.int64)
            doc = np.searchsorted(cuts, starts)
            counts[plain] = np.add.reduceat(per, doc)
            if ids:
                ends = np.cumsum(per)
                at = np.repeat(self.table.starts[entry] - (ends - per), per) + np.arange(ends[-1])
                flat = self.table.ids[at]
        for i in np.flatnonzero(whole):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            parts[i] = np.asarray(self.encode([text])[0], np.uint32)
            counts[i] = len(parts[i])
        if not ids:
            return counts, None
        if not parts:
            return counts, np.asarray(flat, np.uint32)
        out, at = [], 0
        for i in range(n):
            if i in parts:
                out.append(parts[i])
            else:
                out.append(flat[at : at + counts[i]])
                at += counts[i]
        return counts, np.concatenate(out).astype(np.uint32)


def _unsafe_for_byte_bpe(specials: list[bytes]) -> Callable:
    def unsafe(data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Texts with white space beyond ASCII's, separators 28 to 31, or a special token's text."""
        bad = [np.flatnonzero((data >= 28) & (data <= 31))]
        lead = np.flatnonzero((data[:-1] == 0xC2) | ((data[:-1] >= 0xE1) & (data[:-1] <= 0xE3)))
        if len(lead):
            a, b, c = data[lead], data[lead + 1], data[np.minimum(lead + 2, len(data) - 1)]
            hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE3) & (b == 0x80)
            hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c >= 0xA8)) | (b == 0x81) & (c == 0x9F))
            bad.append(lead[hit])
        raw = data.tobytes()
        bad += [np.asarray(_find_all(raw, s), np.int64) for s in specials]
        return np.unique(docs[_docs_at(np.concatenate(bad).astype(np.int64), starts)])

    return unsafe


def _unsafe_for_sentencepiece(data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Texts that start with a space, or hold the piece mark U+2581 or a zero byte."""
    bad = [np.flatnonzero(data == 0), starts[data[starts] == 32], np.asarray(_find_all(data.tobytes(), b"\xe2\x96\x81"), np.int64)]
    return np.unique(docs[_docs_at(np.concatenate(bad).astype(np.int64), starts)])


_encoders: dict[str, PieceEncoder] = {}


def encoder_for(path: str) -> PieceEncoder:
    """The encoder of a tokenizer file, kept by each Python worker: ``.json`` (byte-level BPE) or ``.model``."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()

            def encode(texts: list[str]) -> list[list[int]]:
                return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

            if (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer"):
                specials = [x["content"].encode() for x in spec.get("added_tokens", [])]
                sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)  # a letter of the vocabulary stands for a byte
                for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
                    sizes[k] = len(token)
                _encoders[path] = PieceEncoder(encode, False, True, _unsafe_for_byte_bpe(specials), joined_pieces(encode, sizes))
            else:  # boundaries are not known to be safe: every text as a whole
                _encoders[path] = PieceEncoder(encode, False, False, lambda data, starts, docs: docs)
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            inside = any("▁" in p.strip("▁") or (p[:-1].strip("▁") and p.endswith("▁")) for p in map(model.id_to_piece, range(model.get_piece_size())))
            same = model.normalize("ﬁ  ½é ") == "▁ﬁ▁▁½é▁"
            # a piece never holds a space behind other text, and texts are not normalised: a space starts a new piece
            safe = _unsafe_for_sentencepiece if same and not inside else (lambda data, starts, docs: docs)
            _encoders[path] = PieceEncoder(lambda texts: model.encode(texts, num_threads=1), True, False, safe)
    return _encoders[path]
