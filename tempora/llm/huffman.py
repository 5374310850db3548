"""Token ids as a compressed file format: canonical length-limited Huffman codes.

One code serves the whole corpus and comes from the global counts of ids; its lengths are limited by package-merge, to LIMIT
bits or two more than the used ids need, so that a table of 2^limit entries decodes a symbol with one look-up. Ids are
written in ascending doc_id order as segments; a segment is cut into independent blocks of BLOCK ids, whose
bit offsets it lists, and all blocks of a segment are decoded side by side.

Files: <path>/codebook (id, bits) and <path>/segments (part, start_in_part, n_tokens, payload), ordered by part and
start_in_part. Payload, little-endian: 4 bytes magic, uint32 documents, uint64 ids, uint32 blocks; then for each document
an int64 doc_id, for each a byte that is 1 where doc_id is null, and for each a uint64 count of ids; a uint64 bit offset for each block; then
the bits, first bit highest.

Defined results: a null text counts as empty and gives the end id alone; null doc_ids come first; repeated
doc_ids stand together, in the order of their ids' bytes; an empty table gives no segments. Special tokens of the vocabulary
that stand in a text become their ids, as the library does it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import drop_scratch, scratch_path, width_for, written
from tempora.llm.pieces import PieceEncoder, binary_column

LIMIT = 16
BLOCK = 256
SEGMENT = 1 << 18
MAGIC = b"TPH1"
#: Bytes of text that are encoded at a time: more of them repeat more pieces.
BATCH = 8_000_000
_ENCODERS: dict[tuple, PieceEncoder] = {}


#: Pieces that go to the library as one string; longer strings are slower.
RUN_PIECES = 200


def library_encoder(path: str, end: int | None) -> PieceEncoder:
    """The tokenizers library behind the piece memory, one for each worker.

    Pieces side by side are encoded as one string, for a call costs more than a piece; as every id of a byte-level
    vocabulary stands for a known number of bytes, the ids are cut at the pieces' ends. Texts with an added token go to the
    library whole."""
    if (path, end) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        width = np.zeros(max(tok.get_vocab().values()) + 1, dtype=np.int64)
        for token, i in tok.get_vocab().items():
            width[i] = len(token)
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        whole = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        def runs(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            flat = np.concatenate([np.array(ids, dtype=np.uint32) for ids in whole(["".join(pieces[i : i + RUN_PIECES]) for i in range(0, len(pieces), RUN_PIECES)])])
            ends = np.cumsum(pc.binary_length(pa.array(pieces)).to_numpy())
            upto = np.searchsorted(np.cumsum(width[flat]), ends) + 1
            return np.diff(upto, prepend=0), flat

        _ENCODERS[path, end] = PieceEncoder(whole, runs, end, added=added)
    return _ENCODERS[path, end]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Copies of rows with at most about most bytes of text, a row at least. Copies, for string functions of the
    array library may read a slice of another array beyond its bounds."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.take(pa.array(np.arange(at, to)))
            at = to


def id_type(path: str, end: int) -> str:
    """The narrowest of 16 and 32 bits, little-endian, that holds all ids of a vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if max(end, *Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, end: int, kind: str = "<u4") -> DataFrame:
    """doc_id and ids, as unsigned integers of a kind with the end id last; and for each task a row whose
    counts alone is set: how often it gave each id, as little-endian 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = library_encoder(path, end), np.zeros(0, dtype="<i8")
        for batch in small_batches(batches, "text", BATCH):
            ids, offsets = encode(batch.column("text"))
            got = np.bincount(ids, minlength=len(total)).astype("<i8")
            got[: len(total)] += total
            total = got
            rows = [batch.column("doc_id").cast(pa.int64()), binary_column(ids.astype(kind), offsets), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.large_binary()), pa.array([total.tobytes()])], ["doc_id", "ids", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, counts binary")


def global_counts(counts: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; as many rows as the vocabulary has ids reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                got = np.frombuffer(row, dtype="<i8")
                wide = np.zeros(max(len(got), len(total)), dtype=np.int64)
                wide[: len(total)] += total
                wide[: len(got)] += got
                total = wide
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    counted = counts.select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in counted.collect()}


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Package-merge: optimal code lengths of a limited number of bits."""
    if not counts:
        return {}
    limit = max(LIMIT, (len(counts) - 1).bit_length() + 2)
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    if len(symbols) == 1:
        return {symbols[0]: 1}
    leaves = np.array([counts[s] for s in symbols], dtype=np.int64)
    levels, row = [], leaves
    is_leaf = np.ones(len(leaves), dtype=bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined, marks = np.concatenate([leaves, pairs]), np.concatenate([np.ones(len(leaves), dtype=bool), np.zeros(len(pairs), dtype=bool)])
        order = np.argsort(joined, kind="stable")
        row, is_leaf = joined[order], marks[order]
    levels.append(is_leaf)
    lengths = np.zeros(len(leaves), dtype=np.int64)
    take = 2 * len(leaves) - 2
    for marks in reversed(levels):
        used = int(marks[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    return dict(zip(symbols, lengths.tolist(), strict=True))


class Code:
    """Canonical codes: shorter first, equal lengths by id."""

    def __init__(self, lengths: dict[int, int]):
        self.limit = limit = max(lengths.values(), default=1)
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        top = max(order, default=0) + 1
        self.codes, self.bits = np.zeros(top, dtype=np.uint64), np.zeros(top, dtype=np.int64)
        self.symbol, self.length = np.zeros(1 << limit, dtype=np.uint32), np.ones(1 << limit, dtype=np.int64)
        at = 0
        for s in order:
            n = lengths[s]
            self.codes[s], self.bits[s] = at >> (limit - n), n
            step = 1 << (limit - n)
            self.symbol[at : at + step], self.length[at : at + step] = s, n
            at += step

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ids, and the bit offset of each block."""
        if not len(ids):
            return b"", np.zeros(0, dtype="<u8")
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        value = self.codes[ids] << (64 - bits - (at & 31)).astype(np.uint64)
        word = at >> 5
        heads = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out = np.zeros(int(word[-1]) + 2, dtype=np.uint32)
        out[word[heads]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), heads)
        out[word[heads] + 1] |= np.bitwise_or.reduceat(value.astype(np.uint32), heads)
        return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::BLOCK].astype("<u8")

    def unpack(self, data: bytes, offsets: np.ndarray, total: int) -> np.ndarray:
        """All blocks side by side: at each step every block reads its next symbol from the table."""
        if not total:
            return np.zeros(0, dtype=np.uint32)
        raw = np.frombuffer(data + bytes(BLOCK * self.limit // 8 + 8), dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        at, mask = offsets.astype(np.int64), np.uint32((1 << self.limit) - 1)
        out = np.empty((BLOCK, len(at)), dtype=np.uint32)
        for k in range(BLOCK):
            key = (window[at >> 3] >> (32 - self.limit - (at & 7)).astype(np.uint32)) & mask
            out[k] = self.symbol[key]
            at = at + self.length[key]
        return out.T.reshape(-1)[:total]


def payload(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, code: Code) -> bytes:
    data, offsets = code.pack(ids)
    return b"".join(
        [
            MAGIC,
            struct.pack("<IQI", len(doc_ids), len(ids), len(offsets)),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array(sizes, dtype="<u8").tobytes(),
            offsets.tobytes(),
            data,
        ]
    )


def parse(data: bytes, code: Code) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a payload."""
    if data[:4] != MAGIC:
        raise ValueError("no segment of token ids")
    n, total, blocks = struct.unpack_from("<IQI", data, 4)
    at = 20
    docs = np.frombuffer(data, "<i8", n, at)
    nulls = np.frombuffer(data, np.uint8, n, at + 8 * n)
    sizes = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", blocks, at + 17 * n)
    ids = code.unpack(data[at + 17 * n + 8 * blocks :], offsets, total)
    return [None if z else d for d, z in zip(docs.tolist(), nulls, strict=True)], sizes, ids


def write_ids(docs: DataFrame, vocabulary: str, path: str, end: int = 0) -> None:
    """Tokenises docs and writes codebook and segments under path."""
    spark: SparkSession = docs.sparkSession
    kind = id_type(vocabulary, end)
    wide = np.dtype(kind).itemsize
    ids = written(tokenised(docs, vocabulary, end, kind), "token-ids")
    lengths = code_lengths(global_counts(ids.where("counts IS NOT NULL")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, start = Code(lengths), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            all_ids = np.frombuffer(b"".join(x for _, x in held), dtype=kind)
            body = payload([d for d, _ in held], [len(x) // wide for _, x in held], all_ids, code)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start]), pa.array([len(all_ids)]), pa.array([body])], ["part", "start_in_part", "n_tokens", "payload"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((d, x))
                size += len(x) // wide
                if size >= SEGMENT:
                    yield segment()
                    held, start, size = [], start + size, 0
        if held:
            yield segment()

    ordered = ids.where("counts IS NULL").select("doc_id", "ids").repartitionByRange(width_for(ids), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, "part int, start_in_part long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/segments")
    spark.createDataFrame(sorted(lengths.items()), "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    drop_scratch(ids)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array) of each document of the files under path."""
    lengths = {r[0]: r[1] for r in spark.read.parquet(f"{path}/codebook").collect()}
    segments = spark.read.schema("part int, start_in_part long, n_tokens long, payload binary").parquet(f"{path}/segments")
    before, first = 0, []
    for part, n in sorted(map(tuple, segments.groupBy("part").agg(F.sum("n_tokens")).collect())):
        first.append((part, before))
        before += n
    told = dict(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for part, start, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs, sizes, ids = parse(body, code)
                ends = np.cumsum(sizes)
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(told[part] + start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]
    return segments.select("part", "start_in_part", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, end: int = 0) -> DataFrame:
    """Writes the ids to a new folder in the shared one and reads them back."""
    path = scratch_path(docs.sparkSession, "ids-files")
    write_ids(docs, vocabulary, path, end)
    return read_ids(docs.sparkSession, path, with_ids=False)
