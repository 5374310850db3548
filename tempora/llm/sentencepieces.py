"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The normaliser (space to U+2581, a dummy prefix), the pieces and the byte fallback are compiled to arcs; an
input composed with them is a lattice over its characters, and its ids are the tropical shortest path.
In a unigram model an arc weighs minus its piece's score. In a BPE model a state is a position with the piece that
ends there, and an arc weighs nothing if merging leaves that piece and the arc's own apart, and infinitely much if
it joins them: a segmentation is the one that merging makes just if each two neighbours are left apart. Whether they are
is found by undoing the merges of the two, latest first, and remembered. Short texts are solved side by side in arrays.

Pieces never hold a space after another character, so the lattice falls apart at each space that follows one;
the parts are solved once each and remembered.

Defined results: a null or empty text has no ids and decodes to an empty text; bytes that are no UTF-8 decode
to U+FFFD; U+2581 in a text reads as a space. Repeated rows get equal rows each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import lean
from tempora.llm.huffman import small_batches
from tempora.llm.pieces import PieceEncoder, flattened

#: Fixed value: what stands for a space in pieces.
SPACE = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Pairs of pieces that a worker remembers, and the longest piece of text that is solved side by side with others.
MOST_PAIRS, SIDE_BY_SIDE = 500_000, 32
#: Pieces of text that a worker remembers, and bytes of text that it encodes at a time: both bound its memory.
MOST_PIECES, BATCH = 100_000, 1_000_000
#: Cut only at spaces: pieces do hold other white space after another character, as ".\r".
_CHUNK = re.compile(r" *[^ ]+| +")
_CODERS: dict[str, tuple[Transducer, Callable]] = {}


class IntTable:
    """Values of whole numbers from 0 up: open addressing in arrays, for many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        self.bits = max(8, int(2 * max(room, len(keys), 1)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int32)
        self.n = 0
        self.put(keys, values)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that differ from each other and from those held."""
        self.n += len(keys)
        at, last = self.slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, and -1 for keys that are not held."""
        out, at, last = np.full(len(keys), -1, dtype=np.int64), self.slots(keys), (1 << self.bits) - 1
        held = self.keys[at]
        hit = held == keys
        out[hit] = self.values[at[hit]]
        left = np.flatnonzero(~hit & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & last
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (held >= 0)
            left, at = left[go], at[go]
        return out


class SideBySide:
    """The lattices of many short texts of a BPE model at a time: a walk through the trie of the pieces from each
    character, then one step for each end and length of arc. A character that is no piece stands alone and is spelt at the end."""

    def __init__(self, fst: Transducer):
        # A state is a piece or a start of one; 0 is the start of all.
        ids, merge = fst.ids, fst.last_merge
        usable = [p for p in ids if len(p) == 1 or merge(p)]
        self.chars = np.full(0x110000, -1, dtype=np.int64)
        single = [p for p in usable if len(p) == 1]
        self.chars[[ord(p) for p in single]] = np.arange(len(single))
        self.letters, self.odd = len(single) + 1, fst.width.size
        self.spelt = lambda c: [fst.bytes[b] for b in chr(c).encode("utf-8", "replace")] if fst.fallback else [fst.unknown]
        code = {p: i for i, p in enumerate(single)}
        state: dict[str, int] = {"": 0}
        keys, piece = [], [-1]
        for p in usable:
            for i in range(len(p)):
                if p[: i + 1] not in state:
                    keys.append(state[p[:i]] * self.letters + code[p[i]])
                    state[p[: i + 1]] = len(state)
                    piece.append(-1)
            piece[state[p]] = ids[p]
        keys.append(self.letters - 1)
        piece.append(self.odd)
        state["\0odd"] = len(state)
        self.trie = IntTable(np.array(keys, dtype=np.int64), np.arange(1, len(state)))
        self.piece = np.array(piece, dtype=np.int64)
        size = fst.width.size + 1
        self.length = np.zeros(size, dtype=np.int64)
        self.length[self.odd] = 1
        # Merges in order of score; a single character has no merge and comes before all.
        self.rank, self.left, self.right = (np.full(size, -1, dtype=np.int64) for _ in range(3))
        order = sorted((p for p in usable if len(p) > 1), key=lambda p: -fst.score[p])
        for p in usable:
            self.length[ids[p]] = len(p)
        pairs = []
        for r, p in enumerate(order):
            x, y = merge(p)
            self.rank[ids[p]], self.left[ids[p]], self.right[ids[p]] = r, ids[x], ids[y]
        # Any two pieces whose letters make a piece can merge, also where that is not how it is made first.
        for p in usable:
            for i in range(1, len(p)):
                x, y = ids.get(p[:i]), ids.get(p[i:])
                if x is not None and y is not None:
                    pairs.append((x * size + y, self.rank[ids[p]]))
        self.size = size
        self.merges = IntTable(*np.array(pairs, dtype=np.int64).reshape(-1, 2).T)
        self.forget()

    def forget(self) -> None:
        self.pairs = IntTable(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), MOST_PAIRS)

    def stay_apart(self, keys: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces of each key apart. Merges of each happen in order of rank, so the later
        one is undone first; a merge across that ranks before what was undone came first, of equals the left one."""
        x, y = keys // self.size, keys % self.size
        limit = np.full(len(keys), 1 << 40, dtype=np.int64)
        fine, left = np.ones(len(keys), dtype=bool), np.arange(len(keys))
        while len(left):
            across = self.merges.get(x * self.size + y)
            joins = (across >= 0) & (across < limit)
            fine[left[joins]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~joins & ((rx >= 0) | (ry >= 0))
            x, y, rx, ry, left = x[go], y[go], rx[go], ry[go], left[go]
            first = rx > ry
            # Of equal merges the left one happens first, so the right one is undone first.
            limit = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return fine

    def apart(self, keys: np.ndarray) -> np.ndarray:
        got = self.pairs.get(keys)
        new = got < 0
        if new.any():
            fresh = np.unique(keys[new])
            if self.pairs.n + len(fresh) > MOST_PAIRS:
                self.forget()
            told = self.stay_apart(fresh)
            if len(fresh) <= MOST_PAIRS:
                self.pairs.put(fresh, told.astype(np.int64))
            got[new] = told[np.searchsorted(fresh, keys[new])]
        return got > 0

    def __call__(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and all ids, given the code points of all texts one after another and their counts in each text."""
        code, total = self.chars[points], len(points)
        code[code < 0] = self.letters - 1
        ends = np.cumsum(sizes)
        depth = np.arange(total) - np.repeat(ends - sizes, sizes)  # characters before this one in its text
        room = np.repeat(sizes, sizes) - depth
        arcs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(int(sizes.max(initial=0)) + 1)]
        at, state, n = np.arange(total), np.zeros(total, dtype=np.int64), 0
        while len(at):
            state = self.trie.get(state * self.letters + code[at + n])
            n += 1
            found = np.flatnonzero(state >= 0)
            found = found[self.piece[state[found]] >= 0]
            to = at[found] + n - 1
            order = np.argsort(depth[to], kind="stable")
            to, ids = to[order], self.piece[state[found]][order]
            cuts = np.searchsorted(depth[to], np.arange(len(arcs)))
            for d in range(len(arcs) - 1):
                if cuts[d] < cuts[d + 1]:
                    arcs[d].append((to[cuts[d] : cuts[d + 1]], ids[cuts[d] : cuts[d + 1]]))
            go = (state >= 0) & (room[at] > n)
            at, state = at[go], state[go]
        last = np.full(total, -1, dtype=np.int64)
        for d, held in enumerate(arcs):
            for to, ids in reversed(held):
                free = last[to] < 0
                to, ids = to[free], ids[free]
                begin = to - self.length[ids]
                whole = self.length[ids] == d + 1
                fine = whole.copy()
                before = last[begin[~whole]]
                fine[~whole] = self.apart(before * self.size + ids[~whole])
                last[to[fine]] = ids[fine]
        on_path = np.zeros(total, dtype=bool)
        at, begin = ends - 1, ends - sizes
        while len(at):
            on_path[at] = True
            at = at - self.length[last[at]]
            go = at >= begin
            at, begin = at[go], begin[go]
        out, copies = last[on_path].astype(np.uint32), on_path.astype(np.int64)
        odd = out == self.odd
        if odd.any():
            seen, which = np.unique(points[on_path][odd], return_inverse=True)
            spelt = [self.spelt(int(c)) for c in seen]
            times = np.ones(len(out), dtype=np.int64)
            times[odd] = np.array([len(x) for x in spelt])[which]
            copies[on_path] = times
            out, odd = np.repeat(out, times), np.repeat(odd, times)
            out[odd] = np.array([i for w in which for i in spelt[w]], dtype=np.uint32)
        return np.diff(np.concatenate([[0], np.cumsum(copies)])[ends], prepend=0), out


class Transducer:
    """encode(text) and decode(ids) of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with an identity normaliser that keeps and escapes white space are compiled")
        self.kind, self.dummy = model.trainer_spec.model_type, norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER)}
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.fallback = model.trainer_spec.byte_fallback
        self.longest = max(map(len, self.ids))
        self.floor = float(np.float32(min(self.score.values())) - np.float32(10))
        #: The least cost that a path can have: none where arcs weigh nothing or infinitely much, unknown where they weigh scores.
        self.least = 0.0 if self.kind == BPE else None
        self.spaced = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.lined = any("\n" in p[1:] for p in self.ids)
        self.apart: dict[tuple[str, str], bool] = {}
        self.many: SideBySide | None = None
        surface = [b""] * len(model.pieces)
        for piece, i in self.ids.items():
            surface[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            surface[i] = bytes([b]) if self.fallback else surface[i]
        surface[self.unknown] = model.trainer_spec.unk_surface.encode()
        self.width = np.array([len(s) for s in surface], dtype=np.int64)
        self.begins = np.cumsum(self.width) - self.width
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merging joins last to make the piece; None if merging does not make it."""
        parts = list(piece)
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def runs(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and all ids of normalised pieces."""
        if self.kind != BPE or not pieces:
            return flattened([self.path(p) for p in pieces])
        if self.many is None:
            self.many = SideBySide(self)
        counts = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4")
        odd = counts > SIDE_BY_SIDE
        sizes, flat = self.many(points[np.repeat(~odd, counts)], counts[~odd])
        if not odd.any():
            return sizes, flat
        others, rest = flattened([self.path(pieces[i]) for i in np.flatnonzero(odd)])
        every = np.empty(len(pieces), dtype=np.int64)
        every[~odd], every[odd] = sizes, others
        out, mine = np.empty(len(flat) + len(rest), dtype=np.uint32), np.repeat(odd, every)
        out[~mine], out[mine] = flat, rest
        return every, out

    def weight(self, before: str, piece: str) -> float:
        """An arc's weight after the arc that ends where it begins."""
        if self.kind != BPE:
            return np.float32(-self.score.get(piece, self.floor))  # costs add up in single precision, as in the library, whose near ties they share
        if not before:
            return 0.0
        got = self.apart.get((before, piece))
        return 0.0 if (self.left_apart(before, piece) if got is None else got) else float("inf")

    def left_apart(self, a: str, b: str) -> bool:
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > MOST_PAIRS // 10:
                self.apart.clear()
            got = self.apart[a, b] = self.merged(a + b) == [a, b]
        return got

    def path(self, text: str) -> list[int]:
        """The tropical shortest path over the lattice of a normalised text: cost[end] is the least over arcs from begin of
        cost[begin] plus the arc's weight. Longer arcs come first and win ties; none weighs less than self.least."""
        n, known, weigh = len(text), self.score, self.weight
        last: list[str] = [""] * (n + 1)
        cost = [np.float32(0) if self.kind != BPE else 0.0] + [float("inf")] * n
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                piece = text[begin:end]
                if piece in known or begin == end - 1:
                    total = cost[begin] + weigh(last[begin], piece)
                    if total < cost[end]:
                        cost[end], last[end] = total, piece
                        if total == self.least:
                            break
        out: list[int] = []
        while n:
            piece = last[n]
            n -= len(piece)
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out.extend(self.bytes[b] for b in reversed(piece.encode("utf-8", "replace")))
            else:
                out.append(self.unknown)
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (" " if self.dummy else "") + text
        parts = [text] if self.spaced or self.kind != BPE else _CHUNK.findall(text)  # sums round along the whole text
        ids = [i for p in parts for i in self.path(p.replace(" ", SPACE))]
        if self.fallback:
            return ids
        # Unknown characters side by side are one unknown piece.
        return [i for i, before in zip(ids, [None, *ids]) if i != self.unknown or before != i]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many sequences one after another, and the offset of each."""
        width = self.width[ids]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        data = self.surface[np.repeat(self.begins[ids] - (ends - width), width) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[offsets]
        if self.dummy and total:
            # The dummy prefix goes from every sequence that begins with it.
            begins = bounds[:-1][np.diff(bounds) > 0]
            cut = begins[data[begins] == 32]
            keep = np.ones(total, dtype=bool)
            keep[cut] = False
            bounds = bounds - np.searchsorted(cut, bounds, side="left")
            data = data[keep]
        return data, bounds

    def decode(self, ids: list[int]) -> str:
        data, _ = self.decode_all(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))
        return data.tobytes().decode("utf-8", "replace")


def coder(path: str) -> tuple[Transducer, Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]]:
    """One for each worker. A model with pieces across the cuts of PieceEncoder gets whole texts."""
    if path not in _CODERS:
        fst = Transducer(path)
        whole = lambda texts: [fst.encode(t or "") for t in texts]

        def uncut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            sizes, ids = flattened(whole(texts.to_pylist()))
            return ids, np.concatenate([[0], np.cumsum(sizes)])

        runs = lambda pieces: fst.runs([p.replace(" ", SPACE) for p in pieces])
        _CODERS[path] = (fst, uncut if fst.spaced or fst.lined or not fst.fallback or fst.kind != BPE else PieceEncoder(whole, runs, most=MOST_PIECES))
    return _CODERS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id, n_tokens and ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = coder(path)
        for batch in small_batches(batches, "text", BATCH):
            ids, offsets = encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), lists], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids array<int>")


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows' doc_id and text from their ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst, _ = coder(path)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            sizes, flat = flattened([x or [] for x in lists])
            data, bounds = fst.decode_all(flat.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", F.col(ids)).mapInArrow(lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_crc32 (of the decoded
    text in UTF-8) and same, whether that is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst, encode = coder(path)
        for batch in small_batches(batches, "text", BATCH):
            ids, offsets = encode(batch.column("text"))
            data, bounds = fst.decode_all(ids.astype(np.int64), offsets)
            raw, coded = memoryview(data.tobytes()), memoryview(ids.astype("<u4")).cast("B")
            at, to = offsets.tolist(), bounds.tolist()
            crc = [zlib.crc32(coded[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            back = [zlib.crc32(raw[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]
            texts = batch.column("text").to_pylist()
            same = [(t or "").encode() == raw[a:b] for t, a, b in zip(texts, to[:-1], to[1:], strict=True)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "same"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, same boolean")
