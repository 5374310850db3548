"""Runs of periodic words, and texts with each run cut down to its first period.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least max(6, 4 q) words that no
neighbouring word extends keeping period q. A lag q can hold a run only if at least max(6 - q, 3 q) pairs of equal words stand q
apart in the text, so equal pairs are counted for all lags first and only lags with enough of them are scanned for islands, the
stretches of equal pairs. Counting is exact and splits the words by how often they stand in the text: words that occur often are
counted by autocorrelation of their places (a Fourier transform of zeros and ones, whose sums are far below the precision of
doubles), the others by the differences of their places. Lags beyond a quarter of the text hold no run and are not counted.

Each document is read on its own and whole; there is no shuffle. Defined results: a null or empty text has no words, no runs and
an empty collapsed text; rows with equal doc_id or text get equal rows each; a null doc_id is never planted with copies. Extra
columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tempora.llm.common import lean

WORD = re.compile("[^\x20\x09-\x0d]+")
LEAST, TIMES = 6, 4
#: A word is counted by autocorrelation if it occurs more often than RARE times the square root of the text's words.
RARE = 1
#: Rows of an output batch.
ROWS = 512

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lag_counts(codes: np.ndarray, most: int, rare: float = RARE) -> np.ndarray:
    """For each lag 0..most how many pairs of equal codes stand that far apart; entry 0 is 0."""
    n, found = len(codes), np.zeros(most + 1, dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes)
    heavy = np.flatnonzero(sizes > rare * n**0.5)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    if len(heavy):
        wide = 1 << (n + most).bit_length()
        power = np.zeros(wide // 2 + 1)
        for w in heavy:
            places = np.zeros(wide)
            places[order[starts[w] : starts[w + 1]]] = 1
            at = np.fft.rfft(places)
            power += at.real**2 + at.imag**2
        found += np.rint(np.fft.irfft(power, wide)[: most + 1]).astype(np.int64)
    light = np.ones(len(sizes), dtype=bool)
    light[heavy] = False
    at, word = order[light[codes[order]]], codes[order][light[codes[order]]]
    # The k-th following place of the same word, for all words at once: what reaches too far is followed no further.
    live, k = np.arange(len(at)), 0
    while len(live):
        k += 1
        live = live[live + k < len(at)]
        live = live[word[live + k] == word[live]]
        far = at[live + k] - at[live]
        live, far = live[far <= most], far[far <= most]
        found += np.bincount(far, minlength=most + 1)
    found[0] = 0
    return found


def islands(codes: np.ndarray, q: int) -> list[tuple[int, int]]:
    """Stretches (start, length) of period q that are as long as a run must be."""
    equal = np.zeros(len(codes) - q + 2, dtype=np.int8)
    equal[1:-1] = codes[q:] == codes[:-q]
    edge = np.diff(equal)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - begin + q
    long = size >= max(LEAST, TIMES * q)
    return list(zip(begin[long].tolist(), size[long].tolist(), strict=True))


def runs(codes: np.ndarray, rare: float = RARE) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start, then period."""
    n = len(codes)
    most = n // TIMES
    if n < LEAST or not most:
        return []
    lags = np.arange(most + 1)
    counts, needed = lag_counts(codes, most, rare), np.maximum(LEAST - lags, (TIMES - 1) * lags)
    found: dict[int, list[tuple[int, int]]] = {}
    for q in np.flatnonzero(counts[1:] >= needed[1:]) + 1:
        # A stretch of period q whose smallest period is smaller lies in a run of that period, which divides q. Other runs share
        # no pair of equal words with it (they would overlap by more than q words), so the pairs of known runs count no more.
        inner = [x for p, known in found.items() if q % p == 0 for x in known]
        if counts[q] - sum(max(0, size - q) for _, size in inner) < needed[q]:
            continue
        own = [(s, size) for s, size in islands(codes, int(q)) if not any(a <= s and s + size <= a + b for a, b in inner)]
        if own:
            found[int(q)] = own
    return sorted((s, size, q) for q, known in found.items() for s, size in known)


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """Of one document in ten, the words from some place on become copies of the first few of them."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """Words that no run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s, size, q in found:
        edge[s + q] += 1
        edge[s + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def read(words: list[str]) -> list[tuple[int, int, int]]:
    codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, dtype=np.int64)
    return runs(codes.astype(np.int64))


def told(doc_id: int | None, text: str | None) -> tuple:
    """A row of SCHEMA."""
    words = planted(WORD.findall(text or ""), doc_id)
    found = read(words)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best: tuple = (None,) * 4
    if found:
        s, size, q = found[0]
        for t in found[1:]:  # exact: compared as fractions
            ahead = t[1] * q - size * t[2]
            if ahead > 0 or (ahead == 0 and (t[0], t[2]) < (s, q)):
                s, size, q = t
        best = (s, size, q, 1000 * size // q)
    return (doc_id, len(found), *best, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(collapsed(words, found))))


def detect(docs: DataFrame) -> DataFrame:
    """A row of SCHEMA for each document."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [told(i, t.as_py()) for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(lean(run), SCHEMA)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with a column collapsed: the text without what its runs repeat, words joined by one space (null where the text is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(batch.schema.get_field_index("text")):
                words = WORD.findall(t.as_py() or "")
                out.append(" ".join(collapsed(words, read(words))) if t.is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "collapsed"])

    kept = docs.drop("collapsed")
    return kept.mapInArrow(lean(run), StructType(list(kept.schema.fields)).add("collapsed", "string"))
