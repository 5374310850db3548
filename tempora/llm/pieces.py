"""Texts cut into pieces that tokenizers treat alone, and a bounded memory of the pieces' ids.

A space between two characters that are no white space, and a line feed between two such, end a token in the
tokenizers used here, whatever follows. A text is cut there, equal pieces of a batch are encoded once, and
their ids are laid out for all documents with array operations. Texts with other white space at such a cut
(two spaces, a blank line, space at an end) are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; with more it forgets those that least batches had, and half of them at least.
MOST_PIECES = 600_000


def flattened(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists, and all their ids."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return sizes, np.fromiter((x for ids in lists for x in ids), dtype=np.uint32, count=int(sizes.sum()))


class PieceEncoder:
    """whole(texts) gives the ids of each text; runs(pieces) gives the sizes and all ids of pieces that start with
    white space and may stand side by side; end is an id that closes each document, most the pieces that are remembered,
    and added are strings that the tokenizer finds before it cuts a text: texts that hold one are encoded whole."""

    def __init__(
        self, whole: Callable[[list[str]], list], runs: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None, end: int | None = None, most: int = MOST_PIECES, added: list[str] = ()
    ):
        self.added = [a for a in added if a]
        self.whole, self.end, self.most = whole, [] if end is None else [end], most
        self.runs = runs or (lambda pieces: flattened(whole(pieces)))
        self.clear()

    def clear(self) -> None:
        self.at: tuple[dict[str, int], dict[str, int]] = {}, {}  # of pieces at the start, and after a space
        self.flat = np.array(self.end, dtype=np.uint32)
        self.starts = np.zeros(1, dtype=np.int64)
        self.sizes = np.array([len(self.end)], dtype=np.int64)
        self.batches = np.zeros(1, dtype=np.int32)

    def forget(self) -> None:
        """Keeps the pieces that several batches had, half of the most at most."""
        kept = np.flatnonzero(self.batches > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(self.batches[kept], kind="stable")[-(self.most // 2) :]])
        kept = np.concatenate([[0], kept[kept > 0]])
        number = np.full(len(self.sizes), -1, dtype=np.int64)
        number[kept] = np.arange(len(kept))
        to = number.tolist()
        self.at = tuple({p: to[n] for p, n in at.items() if to[n] > 0} for at in self.at)
        sizes = self.sizes[kept]
        starts = np.cumsum(sizes) - sizes
        self.flat = self.flat[np.repeat(self.starts[kept] - starts, sizes) + np.arange(int(sizes.sum()))]
        self.starts, self.sizes, self.batches = starts, sizes, self.batches[kept] // 2

    @staticmethod
    def stands_alone(piece: str) -> bool:
        body = piece[1:] if piece[:1] == "\n" else piece
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def add(self, pieces: list[str], spaced: bool, added: list[str]) -> np.ndarray:
        """The numbers of the pieces, which differ if spaced, in the memory; -1 for those that don't stand alone or hold one of added."""
        at = self.at[spaced]
        numbers = np.fromiter(map(at.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        missed = np.flatnonzero(numbers < 0).tolist()
        new = [pieces[i] for i in missed]
        good = [p for p in dict.fromkeys(new) if p and (p.strip() == p or self.stands_alone(p)) and not (added and any(a in p for a in added))]
        if good:
            sizes, flat = self.runs([p if p[0] == "\n" else " " + p for p in good]) if spaced else flattened(self.whole(good))
            n = len(self.sizes)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
            self.batches = np.concatenate([self.batches, np.zeros(len(good), dtype=np.int32)])
            at.update(zip(good, range(n, n + len(good)), strict=True))
            numbers[missed] = np.fromiter(map(at.get, new, repeat(-1)), dtype=np.int64, count=len(new))
        if spaced:
            self.batches[numbers[numbers > 0]] += 1
        return numbers

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and for each text the offset of its first, with the end at last."""
        if len(self.sizes) > self.most:
            self.forget()
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        holds = {a: pc.match_substring(texts, a).to_numpy(zero_copy_only=False) for a in self.added}
        added = [a for a, found in holds.items() if found.any()]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.indices.to_numpy(zero_copy_only=False)
        known = coded.dictionary.to_pylist()
        first = np.zeros(len(words), dtype=bool)
        first[bounds[:-1]] = True
        later = np.zeros(len(known), dtype=bool)
        later[words[~first]] = True
        picked = np.flatnonzero(later)
        number = np.full(len(known), -1, dtype=np.int32)
        number[picked] = self.add([known[i] for i in picked], True, added)
        rows = number[words]
        rows[bounds[:-1]] = self.add([known[i] for i in words[bounds[:-1]]], False, added)
        alone = np.minimum.reduceat(rows, bounds[:-1]) < 0 if n else np.zeros(0, dtype=bool)
        for a in added:
            alone |= holds[a]
        wild = np.flatnonzero(alone)
        if not len(wild):
            return self.laid(rows, np.diff(bounds))
        tame = np.flatnonzero(~alone)
        counts = np.diff(bounds)
        flat, offsets = self.laid(rows[np.repeat(~alone, counts)], counts[tame])
        special = [np.array([*ids, *self.end], dtype=np.uint32) for ids in self.whole(texts.take(pa.array(wild)).to_pylist())]
        sizes = np.empty(n, dtype=np.int64)
        sizes[tame], sizes[wild] = np.diff(offsets), [len(x) for x in special]
        out, mine = np.empty(int(sizes.sum()), dtype=np.uint32), np.repeat(alone, sizes)
        out[~mine] = flat
        out[mine] = np.concatenate(special)
        return out, np.concatenate([[0], np.cumsum(sizes)])

    def laid(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of documents of so many pieces each, one document after another, and the offset of each."""
        ends = np.cumsum(counts)
        rows = np.insert(rows, ends, 0)  # what closes a document is number 0
        sizes = self.sizes[rows]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        src = np.repeat(self.starts[rows] - (upto - sizes), sizes)
        src += np.arange(total)
        return self.flat[src], np.concatenate([[0], upto[ends + np.arange(len(ends))]])


def binary_column(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One little-endian byte string for each document."""
    wide = offsets.astype(np.int64) * ids.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(wide), pa.py_buffer(np.ascontiguousarray(ids))])
