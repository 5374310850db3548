"""Exact top-k inner products by a score-at-a-time index.

Vectors become integers, floor(256 x). A block of vectors is indexed by posting segments: for each dimension, the vectors
whose value falls in the same LEVEL-wide range. For a query a segment's impact is the largest product it can add; the
segments of all dimensions are processed by descending impact, adding it to the scores of their vectors, whose parts not
yet seen add at most the next impact each. The search stops when the vectors whose bound still reaches the k-th
best known score are few, which proves that no other can be a result; those are scored exactly.

The index is a written table with a row for each block of vectors: its postings, its segments with their ranges, and the
vectors for rescoring. Blocks of queries, a small part of the rows, go to the index and are streamed past one block of
it at a time. A first threshold for each query comes from exact scores against SEED_ROWS vectors; it can only save work.
Bounds are float64 sums of integers; where they could pass 2^52 a block is scored in full instead. Scores are 64-bit integers.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as
padded with zeros; rows are told apart by a row number, so that a repeated row is another candidate; equal scores go by
smaller vec_id, null last. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import shuffle_width, written

K = 5
EVERY = 50
LEVEL = 16
#: Vectors of a block of the index: about so many, and fewer, down to the lower bound, where the session has tasks to spare.
BLOCK_ROWS, LEAST_BLOCK_ROWS = 65_536, 4096
QUERY_ROWS = 512
SEED_ROWS = 2048
ROUNDS = 24
INDEX = "block int, uids binary, ids binary, vectors binary, postings binary, starts binary, low binary, high binary"
_INDEX = pa.schema([("block", pa.int32()), *[(c.split()[0], pa.binary()) for c in INDEX.split(", ")[1:]]])
QUERIES = "q_uids binary, q_ids binary, q_values binary, least binary"
_QUERIES = pa.schema([(c.split()[0], pa.binary()) for c in QUERIES.split(", ")])


def integers(table: DataFrame) -> DataFrame:
    """uid, vec_id and v, floor(256 x) of each component, for vectors that take part."""
    rows = table.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(fine).select("uid", "vec_id", F.transform("e", lambda x: F.floor(x * 256)).alias("v"))


def rows_of(batches: Iterator[pa.RecordBatch], width: int, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """uids, ids and values of all rows, or of most at a time; ids that are null stand as the largest integer."""
    uids, ids, values = [], [], []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.zeros((len(values), width), dtype="<i8")
        for row, v in zip(data, values, strict=True):
            row[: len(v)] = v
        return np.array(uids, dtype="<i8"), np.array(ids, dtype="<i8"), data

    for batch in batches:
        for uid, vec_id, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            uids.append(uid)
            ids.append(2**63 - 1 if vec_id is None else vec_id)
            values.append(v)
            if len(values) == most:
                yield block()
                uids, ids, values = [], [], []
    if values:
        yield block()


class Index:
    """Posting segments of a block of integer vectors: entries of each dimension in order of value, cut where the level changes."""

    def __init__(self, values: np.ndarray, postings: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray):
        n, dims = values.shape
        self.values, self.postings, self.starts, self.low, self.high = values, postings, starts, low, high
        self.sizes, self.dim = np.diff(starts, append=n * dims), starts // max(1, n)
        self.largest = float(np.abs(values.astype(float)).max(initial=0))

    @classmethod
    def of(cls, values: np.ndarray) -> Index:
        n, dims = values.shape
        order = np.argsort(values, axis=0, kind="stable")
        flat = np.take_along_axis(values, order, axis=0).T.ravel()
        level = flat // LEVEL
        edge = np.ones(n * dims, dtype=bool)
        edge[1:] = level[1:] != level[:-1]
        edge[::n] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n * dims) - 1
        return cls(values, order.T.ravel().astype("<i4"), starts.astype("<i8"), flat[starts], flat[ends])

    def row(self) -> list[bytes]:
        """What a row of the written index holds."""
        return [x.astype(t).tobytes() for x, t in ((self.values, "<i8"), (self.postings, "<i4"), (self.starts, "<i8"), (self.low, "<i8"), (self.high, "<i8"))]

    @classmethod
    def read(cls, width: int, vectors: bytes, postings: bytes, *others: bytes) -> Index:
        return cls(np.frombuffer(vectors, "<i8").reshape(-1, width), np.frombuffer(postings, "<i4"), *(np.frombuffer(x, "<i8") for x in others))

    def search(self, query: np.ndarray, k: int, known: int | None) -> np.ndarray:
        """Positions that may be among the k best or tie with them; known is a score that k vectors of any block reach."""
        n, dims = self.values.shape
        few = max(4 * k, n // 32)
        if n <= few or dims * self.largest * float(np.abs(query.astype(float)).max(initial=0)) >= 2**52:
            return np.arange(n)
        q = query[self.dim]
        impact = np.where(q > 0, q * self.high, q * self.low)
        order = np.argsort(-impact, kind="stable")
        ends = np.cumsum(self.sizes[order])
        bound, seen = np.zeros(n), np.zeros(n)
        at = 0
        for step in range(1, ROUNDS + 1):
            upto = int(np.searchsorted(ends, ends[-1] * step // ROUNDS, side="left")) + 1 if step < ROUNDS else len(order)
            if upto > at:
                part = order[at:upto]
                sizes = self.sizes[part]
                where = self.postings[np.repeat(self.starts[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
                bound += np.bincount(where, np.repeat(impact[part], sizes), n)
                seen += np.bincount(where, minlength=n)
                at = upto
            if step % 4 and step < ROUNDS:
                continue
            following = impact[order[at]] if at < len(order) else 0
            top = bound + (dims - seen) * following
            best = np.argpartition(top, n - few)[n - few :]
            scores = self.values[best] @ query
            reached = int(np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
            known = reached if known is None else max(known, reached)
            alive = np.flatnonzero(top >= known)
            if len(alive) <= 2 * few or at == len(order):
                return alive
        return np.arange(n)


def best_of(positions: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids[positions], -scores))[:k]


def meet(width: int, k: int) -> Callable:
    """The k best of each block of the index for each query that follows it in rows sorted by block, its index first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda data: np.frombuffer(data, dtype="<i8")
        at, index, uid, vec = None, None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                got = {f.name: batch.column(i)[row].as_py() for i, f in enumerate(batch.schema)}
                if got["vectors"] is not None:
                    at, uid, vec = got["block"], read(got["uids"]), read(got["ids"])
                    index = Index.read(width, *(got[c] for c in ("vectors", "postings", "starts", "low", "high")))
                    continue
                if got["block"] != at:
                    continue  # a block without vectors
                q_uid, q_id, known = read(got["q_uids"]), read(got["q_ids"]), read(got["least"])
                queries, out = read(got["q_values"]).reshape(-1, width), []
                for i in range(len(q_uid)):
                    found = index.search(queries[i], k, int(known[i]) if len(known) else None)
                    found = found[uid[found] != q_uid[i]]
                    scores = index.values[found] @ queries[i]
                    top = best_of(found, scores, vec, k)
                    out.append(np.stack([np.full(len(top), q_uid[i]), np.full(len(top), q_id[i]), vec[found[top]], scores[top]]))
                columns = np.concatenate(out, axis=1)
                ids_or_null = pa.array(columns[2], mask=columns[2] == 2**63 - 1)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), ids_or_null, pa.array(columns[3])], ["uid", "query_id", "vec_id", "score"])

    return run


def built(vectors: DataFrame, blocks: int, width: int) -> DataFrame:
    """The written index: rows are dealt to blocks by a hash of their number, a block to a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for uids, ids, values in rows_of(batches, width):
            columns = [TaskContext.get().partitionId(), uids.tobytes(), ids.tobytes(), *Index.of(values).row()]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _INDEX, strict=True)], schema=_INDEX)

    return written(vectors.repartition(blocks, F.xxhash64("uid")).mapInArrow(run, INDEX), "topk-index")


def search(table: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of every row whose vec_id is divisible by every."""
    spark = table.sparkSession
    vectors = written(integers(table), "topk-vectors")
    shape = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    count, width, asked = shape[0], max(1, shape[1] or 1), shape[2]
    blocks = max(1, -(-count // BLOCK_ROWS), min(shuffle_width(spark), -(-count // LEAST_BLOCK_ROWS)))
    index = built(vectors, blocks, width)
    seeds = np.array([list(r[0]) + [0] * (width - len(r[0])) for r in vectors.select("v").limit(SEED_ROWS).collect()], dtype=np.int64).reshape(-1, width)

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, ids, values in rows_of(batches, width, QUERY_ROWS):
            scores = values @ seeds.T
            at = scores.shape[1] - k - 1
            least = np.partition(scores, at, axis=1)[:, at].astype("<i8").tobytes() if at >= 0 else b""
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (uids.tobytes(), ids.tobytes(), values.tobytes(), least)], schema=_QUERIES)

    chosen = vectors.where(F.col("vec_id") % every == 0).repartition(max(1, -(-asked // QUERY_ROWS)), F.xxhash64("uid"))
    queries = written(chosen.mapInArrow(seeded, QUERIES), "topk-queries")
    spread = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    line = index.unionByName(spread, allowMissingColumns=True).repartition(blocks, "block").sortWithinPartitions("block", F.col("vectors").isNull())
    best = line.mapInArrow(meet(width, k), "uid long, query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
