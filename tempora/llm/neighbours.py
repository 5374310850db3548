"""Quality by nearest neighbours among labelled texts in a latent semantic space.

A text's terms are its words (lower-cased in ASCII, hashed to WORDS buckets), the runs of three coarse character classes that it
is written in, each word that repeats the one before it, and marks for the share of such words and for the text's length. A term weighs 1 + log of its count times its inverse document frequency, which is
counted over all documents; vectors are of length one. Truncated singular vectors of the labelled texts' weights span the space.
A document's score is the vote of the NEAREST labelled texts by cosine, each with its similarity to the power of POWER and with the
weight that makes up for how few of its label were taken.

The labelled vectors are bounded (MOST_LABELLED texts of DIMS numbers) and are broadcast with the basis (TERMS x DIMS); every document
is compared with all of them, exactly, a block of documents at a time. Neighbours that tie with the last one all vote.

What is learned from: rows of labels with quality 0 or 1 whose doc_id's CRC-32 leaves a remainder other than 0 by FOLDS. Of each label
the MOST_LABELLED / 2 doc_ids with the smallest hashes are taken, the bound on the sample; languages, sources and ids enter no score.

Defined results: a null or empty text has its marks alone and is scored like others; where no labelled text is similar, or
none is there, the score is the share of label 1 (1/2 without labels). A doc_id whose labels differ is not learned from; of
several texts with one doc_id the smallest is. Rows with equal texts get equal scores. A null doc_id is held out of nothing: held_out is
false, and it has no label. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import drop_scratch, lean, written

FOLDS = 5
#: Labelled texts that take part at most, half of each label; singular vectors; neighbours; power of the similarity.
MOST_LABELLED, DIMS, NEAREST, POWER = 4096, 48, 24, 4
#: What marks and repeats of words weigh more than other terms, of which a text has hundreds.
STRESS = 6.0
#: Buckets of words, and character classes: letters by case and kind, digits, spaces and separators, and marks by likeness.
WORDS, CLASSES, LENGTHS, SHARES = 4096, 16, 24, 8
AGAIN = WORDS + CLASSES**3
TERMS = AGAIN + 1 + LENGTHS + SHARES + 1
#: A score from which a text is predicted to be of label 1.
CUT = 0.3
#: Rows that are compared at a time, and bytes of text.
BLOCK, BLOCK_BYTES = 64, 1 << 20

_KINDS = ["AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".,;:", "!?", "'\"()[]{}", "#*$%&", "|<>=+~^\\/", "-_@"]


def _classes() -> np.ndarray:
    found = np.full(256, CLASSES - 1, dtype=np.int64)  # other ASCII
    for k, chars in enumerate(_KINDS):
        found[[ord(c) for c in chars]] = k
    found[128:] = CLASSES - 2
    return found


CLASS_OF = _classes()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint32)
GAP = np.isin(np.arange(256), [32, *range(9, 14)])
#: Multipliers of a byte by its place in its word; longer words use them again.
PLACES = (np.uint32(2654435761) * np.arange(1, 65, dtype=np.uint32)) | np.uint32(1)


def counts_of(texts: list[bytes]) -> np.ndarray:
    """Of each text how often it holds each term, a row of TERMS for each."""
    sizes = np.array([len(t) for t in texts])
    a = np.frombuffer(b"".join(texts), dtype=np.uint8)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    kind = CLASS_OF[a]
    shapes = ((kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:] + (WORDS + TERMS * text[2:].astype(np.int64)))[text[:-2] == text[2:]]
    solid = ~GAP[a]
    joined = solid[1:] & solid[:-1] & (text[1:] == text[:-1])
    begin = np.flatnonzero(solid & np.concatenate(([True], ~joined))[: len(a)])
    at = np.flatnonzero(solid)
    long = np.diff(np.append(np.searchsorted(at, begin), len(at)))
    words = np.zeros(0, dtype=np.int64)
    if len(begin):
        mixed = (LOWER[a[at]] + 1) * PLACES[(at - np.repeat(begin, long)) % len(PLACES)]
        sums = np.add.reduceat(mixed, np.cumsum(long) - long)
        words = ((sums ^ (sums >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(20)).astype(np.int64) % WORDS
    of = text[begin].astype(np.int64)
    n = np.bincount(of, minlength=len(texts))
    again = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=len(texts))
    out = np.bincount(np.concatenate((words + TERMS * of, shapes)), minlength=TERMS * len(texts)).reshape(len(texts), TERMS)
    rows = np.arange(len(texts))
    out[rows, AGAIN] = again
    out[rows, AGAIN + 1 + np.minimum(LENGTHS - 1, np.frexp(n)[1])] = 1
    out[rows, AGAIN + 1 + LENGTHS + SHARES * again // np.maximum(1, n)] = 1
    return out


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of weights, of length one."""
    out = np.zeros(counts.shape)
    row, term = np.nonzero(counts)
    out[row, term] = (1 + np.log(counts[row, term])) * idf[term]
    return unit(out)


def blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for x in texts:
        part.append(x.as_py())
        size += len(part[-1])
        if len(part) >= BLOCK or size > BLOCK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of each term the documents that hold it, over all rows, and the number of rows: TERMS + 1 sums at most go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for part in blocks(batch.column(0)):
                total[:TERMS] += np.count_nonzero(counts_of(part), axis=0)
                total[TERMS] += len(part)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "docs"])

    found = texts.mapInArrow(lean(run), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    total = np.zeros(TERMS + 1, dtype=np.int64)
    for term, docs in found:
        total[term] = docs
    return total[:TERMS], int(total[TERMS])


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Terms and counts of the texts that are learned from, their labels, and for each the number of labelled ids that it stands for. The
    counts, at most TERMS of a text, go to the driver, and no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks(batch.column(2)):
                rows = counts_of(part)
                held = [np.flatnonzero(r) for r in rows]
                ids = [batch.column(k).slice(at, len(part)) for k in (0, 1)]
                counts = [pa.array([v.astype(np.int32).tobytes() for v in c]) for c in (held, [r[h] for r, h in zip(rows, held, strict=True)])]
                yield pa.RecordBatch.from_arrays([*ids, *counts], ["doc_id", "quality", "terms", "counts"])
                at += len(part)

    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    one = written(one.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")), "neighbours-labels")
    have = dict(map(tuple, one.groupBy("quality").count().collect()))
    some = [one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED // 2) for q in (0, 1)]
    ids = some[0].unionByName(some[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    read = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.encode(F.min("text"), "UTF-8").alias("text"))
    rows = read.mapInArrow(lean(run), "doc_id long, quality int, terms binary, counts binary").collect()
    drop_scratch(one)
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in rows], dtype=np.int64)
    taken = np.bincount(y, minlength=2)
    stands = np.array([have.get(q, 0) / max(1, taken[q]) for q in (0, 1)])
    return [(np.frombuffer(r.terms, np.int32), np.frombuffer(r.counts, np.int32)) for r in rows], y, stands[y]


def basis_of(weights: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The leading right singular vectors, TERMS x dims: a randomised range finder with power steps and a fixed seed."""
    dims = min(dims, *weights.shape)
    if not dims:
        return np.zeros((TERMS, 0))
    q = np.random.default_rng(11).standard_normal((weights.shape[1], min(dims + 16, *weights.shape)))
    blocks_ = [slice(at, at + BLOCK) for at in range(0, len(weights), BLOCK)]  # so that only a block is ever in doubles
    times = lambda q: np.concatenate([weights[b] @ q for b in blocks_])
    for _ in range(4):
        y = np.linalg.qr(times(q))[0]
        q = np.linalg.qr(sum(weights[b].T @ y[b] for b in blocks_))[0]
    _, _, v = np.linalg.svd(times(q), full_matrices=False)
    return q @ v[:dims].T


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 1e-9)


class Model:
    """Broadcast: inverse document frequencies, the basis, and the labelled vectors with their labels and weights."""

    def __init__(self, idf: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, stands: np.ndarray):
        self.idf = idf
        steps = range(0, len(counts), BLOCK)
        weights = np.zeros((len(counts), TERMS), dtype=np.float32)
        for at in steps:
            part = np.zeros((len(counts[at : at + BLOCK]), TERMS), dtype=np.int64)
            for row, (terms, n) in zip(part, counts[at : at + BLOCK], strict=True):
                row[terms] = n
            weights[at : at + BLOCK] = weighed(part, idf)
        self.basis = basis_of(weights).astype(np.float64)
        self.known = unit(np.concatenate([weights[at : at + BLOCK] @ self.basis for at in steps] or [np.zeros((0, self.basis.shape[1]))]))
        self.y, self.stands = y, stands
        self.share = float(stands[y == 1].sum() / stands.sum()) if len(y) else 0.5

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.y):
            return np.full(len(texts), self.share)
        near = unit(weighed(counts_of(texts), self.idf) @ self.basis) @ self.known.T
        near = np.rint(near * 1e9) / 1e9  # equal texts tie whatever block they stand in
        last = np.partition(near, -min(NEAREST, near.shape[1]), axis=1)[:, -min(NEAREST, near.shape[1])]
        row, col = np.nonzero(near >= np.maximum(last, 1e-9)[:, None])
        votes = near[row, col] ** POWER * self.stands[col]
        total, good = (np.bincount(row, weights=w, minlength=len(texts)) for w in (votes, votes * self.y[col]))
        return np.round(np.divide(good, total, out=np.full(len(texts), self.share), where=total > 0), 6)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    texts = docs.select(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    found, rows = document_frequencies(texts)
    idf = np.log((1 + rows) / (1 + found)) + 0.1
    idf[AGAIN:] *= STRESS
    return Model(idf, *sample(docs, labels))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in blocks(batch.column(2)):
                found = model.value.scores(part)
                ids = [batch.column(k).slice(at, len(part)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(found), pa.array((found >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
                at += len(part)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))
    return read.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")
