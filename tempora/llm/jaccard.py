"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Two documents link when 100 * |intersection| >= 80 * |union| of their sets of 5-word shingles. If they do, each
shares at least 4/5 of its own set. So of a set of n tokens in any global order the first n - ceil(4n/5) + l hold at
least l shared ones, and two documents that chose l and l' share min(l, l') tokens in those prefixes.

1. Equal sets are one. In the order of hashes, a set whose prefix of l0 extra tokens has too few tokens that
   other sets' prefixes hold has no partner. Tokens that several sets of one input chunk hold are settled there, so that
   a frequent token crosses the shuffle once for each chunk.
2. The other sets are ordered by document frequency, rare first, and tokens of one set alone are set apart. Lists of very
   frequent tokens are found from a part of the sets and never meet in one task. Each set
   chooses the l that is cheapest by estimate: the postings of its prefix, plus a verification for each candidate,
   of which there are at most postings / l.
3. For PIVOT_ROUNDS rounds each set is verified against one set of another component, that which is first or last
   in most of its lists; links are contracted to components. A round has at most one pair for each set.
4. Only lists with several components are left. Across components, a pair is looked at in the list of its first
   shared prefix token; it is a candidate if it shares min(l, l') prefix tokens and the tokens seen
   to differ leave room for the overlap that its sizes need. Long lists are cut into blocks, of which any two that hold
   different components meet. Candidates are verified on whole sets.

Links inside one component are implied; no link between different components is lost, and no group is expanded into its
pairs. Tokens are 64-bit hashes. Sets are told apart by two such hashes and numbered.

Defined results: a text of fewer than 5 words is one shingle; null texts and texts without words have none, link with
nothing and are their own component. Repeated rows link with each other. A null doc_id takes part, but labels no
component that has another. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import drop_scratch, lean, width_for, written
from tempora.llm.components import components
from tempora.llm.huffman import small_batches

WORDS = 5
#: Similarity at which two sets link, as hundredths.
SIMILAR = 80
#: Tokens that a map task settles at a time.
CHUNK = 1_000_000
#: Extra matches that the first filter asks of a prefix: one more for each so many tokens.
FIRST_PER = 10
MOST_MATCHES = 64
VERIFY_COST = 0.2
_MARK = np.uint64(2**64 - 1)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    t = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for gap in "\t\n\x0b\x0c\r":
        t = pc.replace_substring(t, gap, " ")
    lists = pc.split_pattern(t, " ")
    coded = lists.flatten().dictionary_encode()
    known = np.array(coded.dictionary.to_pylist(), dtype=object)
    hashed = pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, dtype=np.uint64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    some = np.array([bool(w) for w in known], dtype=bool)[at] if len(at) else np.zeros(0, dtype=bool)
    ends = np.concatenate([[0], np.cumsum(some)])[lists.offsets.to_numpy()]
    w = hashed[at[some]]
    with np.errstate(over="ignore"):
        size = max(0, len(w) - words + 1)
        total = np.zeros(size, dtype=np.uint64)
        for j in range(words):
            total += w[j : j + size] * _MULTIPLIERS[j]
        shingles = mixed(total)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(shingles[a : b - words + 1]))
            elif b > a:
                out.append(mixed(np.array([(w[a:b] * _MULTIPLIERS[: b - a]).sum()], dtype=np.uint64), b - a))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_keys(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mixed(s, salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (1, 2))


def least_overlap(n: int) -> int:
    return -(-SIMILAR * n // 100)


def first_matches(n: int) -> int:
    return 1 + n // FIRST_PER


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows of equal bucket as one byte string: each column's values after the other's."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    columns = [c[order].astype(np.uint64) for c in columns]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[order[a]]), np.concatenate([c[a:b] for c in columns]).tobytes()


def from_blobs(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    parts = [np.frombuffer(b, dtype=np.uint64).reshape(columns, -1) for b in blobs]
    return list(np.concatenate(parts, axis=1)) if parts else [np.zeros(0, dtype=np.uint64)] * columns


#: Rows that a task sorts at a time.
PART = 500_000


def in_parts(key: int, *columns: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Rows in parts of about PART, all rows of equal columns[key] in one of them."""
    n = -(-len(columns[0]) // PART)
    if n <= 1:
        yield list(columns)
        return
    part = (mixed(columns[key], 3) % np.uint64(n)).astype(np.uint16 if n < 1 << 16 else np.int64)
    for i in range(n):
        chosen = np.flatnonzero(part == i)
        yield [c[chosen] for c in columns]


FIRST = "bucket int, data binary, doc_id long, mark long, n long, k1 long, k2 long, hits long"
_FIRST = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), *[(c, pa.int64()) for c in ("doc_id", "mark", "n", "k1", "k2", "hits")]])


def first_map(buckets: int) -> Callable:
    """Rows of documents (doc_id, mark, n, k1, k2), of tokens to be counted elsewhere (data) and of hits settled here (k1, hits)."""

    def settle(tokens: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        h = np.concatenate(tokens)
        k = np.repeat(np.array(keys, dtype=np.int64).view(np.uint64), [len(t) for t in tokens])
        h, k = deduplicated(h, k)
        head = np.ones(len(h), dtype=bool)
        head[1:] = h[1:] != h[:-1]
        group = np.cumsum(head) - 1
        several = np.bincount(group)[group] > 1
        found, hits = np.unique(k[several], return_counts=True)
        sent = ~several | head
        h, k = h[sent], np.where(several[sent], _MARK, k[sent])
        rows = [{"bucket": b, "data": d} for b, d in by_bucket((h % np.uint64(buckets)).astype(np.int64), h, k)]
        rows += [{"bucket": int(x) % buckets, "k1": int(x), "hits": int(c)} for x, c in zip(found.view(np.int64), hits, strict=True)]
        return pa.RecordBatch.from_pylist(rows, _FIRST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        keys: list[int] = []
        size = 0
        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, mark, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                k1, k2 = set_keys(s)
                n = len(s)
                # Documents only pass through the count: dealt by doc_id, so that copies don't meet in one task.
                rows.append({"bucket": hash((doc_id or 0, mark)) % buckets, "doc_id": doc_id, "mark": mark, "n": n, "k1": k1, "k2": k2})
                if n:
                    tokens.append(s[: n - least_overlap(n) + first_matches(n)])
                    keys.append(k1)
                    size += len(tokens[-1])
            yield pa.RecordBatch.from_pylist(rows, _FIRST)
            if size > CHUNK:
                yield settle(tokens, keys)
                tokens, keys, size = [], [], 0
        if tokens:
            yield settle(tokens, keys)

    return run


def first_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes documents and hits on, and counts for each set its tokens that another set sent too."""
    blobs: list[bytes] = []
    for batch in batches:
        data = batch.column(1)
        blobs += [d for d in data.to_pylist() if d is not None]
        yield batch.filter(pc.is_null(data))
    whole = from_blobs(blobs, 2)
    blobs.clear()
    for part in in_parts(0, *whole):
        h, k = deduplicated(*part)
        if not len(h):
            continue
        group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        shared = ((np.bincount(group) > 1) | (np.bincount(group, weights=k == _MARK) > 0))[group] & (k != _MARK)
        found, hits = np.unique(k[shared], return_counts=True)
        columns = {"k1": pa.array(found.view(np.int64)), "hits": pa.array(hits)}
        yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(found), f.type)) for f in _FIRST], schema=_FIRST)


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "tokens"])


_BLOB = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def deduplicated(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows in order of their first two columns, one of each pair."""
    h, k = columns[:2]
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    return [h[new], k[new], *(c[order][new] for c in columns[2:])]


#: Sets that the estimate of frequent tokens looks at: one of so many. A token is frequent from MANY such sets, and from one
#: millionth of their tokens, so that there are at most a million frequent ones.
LOOKED, MANY, MOST_FREQUENT = 64, 100, 1_000_000


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens so frequent that their lists must not meet in one task, in order, and about how many sets hold each.

    A missed one costs memory and changes no result: frequencies only put tokens in order, the same for all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["token", "n"])

    looked = sets.where(F.pmod(F.xxhash64("sid"), F.lit(LOOKED)) == 0).select("tokens").mapInArrow(lean(run), "token long, n long")
    counted = written(looked.groupBy("token").agg(F.sum("n").alias("n")), "jaccard-looked")
    total = counted.agg(F.sum("n")).first()[0] or 0
    most = counted.where(F.col("n") >= max(MANY, total // MOST_FREQUENT)).toPandas().sort_values("token")
    drop_scratch(counted)
    tokens, n = most["token"].to_numpy(np.int64).view(np.uint64), most["n"].to_numpy(np.int64) * LOOKED
    order = np.argsort(tokens)
    return tokens[order], n[order]


_BLOB = pa.schema([("bucket", pa.int32()), ("data", pa.binary()), ("ready", pa.binary())])
BLOB = "bucket int, data binary, ready binary"


def tokens_out(buckets: int, known: np.ndarray, df: np.ndarray) -> Callable:
    """(token, set, size of the set) by bucket of token; for the known frequent tokens (set, token, df, size) by bucket of set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([t for _, t in held])
            sizes = np.array([len(t) for _, t in held])
            k = np.repeat(np.array([x for x, _ in held], dtype=np.int64).view(np.uint64), sizes)
            n = np.repeat(sizes, sizes)
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            often = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
            rare = ~often
            rows = [(*x, None) for x in by_bucket((h[rare] % np.uint64(buckets)).astype(np.int64), h[rare], k[rare], n[rare])]
            if often.any():
                rows += [(x, None, y) for x, y in by_bucket((k[often] % np.uint64(buckets)).astype(np.int64), k[often], h[often], df[at[often]], n[often])]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOB)], schema=_BLOB)

        for batch in batches:
            for sid, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((sid, np.frombuffer(tokens, dtype=np.uint64)))
                size += len(held[-1][1])
                if size > CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def frequencies(buckets: int) -> Callable:
    """(set, token, its number of sets, size of the set) by bucket of set, for tokens of several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            blobs += [d for d in batch.column(1).to_pylist() if d is not None]
            yield batch.filter(pc.is_valid(batch.column(2)))
        whole = from_blobs(blobs, 3)
        blobs.clear()
        for part in in_parts(0, *whole):
            h, k, n = deduplicated(*part)
            if not len(h):
                continue
            group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
            df = np.bincount(group)[group]
            kept = df > 1
            rows = list(by_bucket((k[kept] % np.uint64(buckets)).astype(np.int64), k[kept], h[kept], df[kept], n[kept]))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.nulls(len(rows), pa.binary()), pa.array([d for _, d in rows], pa.binary())], schema=_BLOB)

    return run


def chosen_matches(df: np.ndarray, least: int, n: int) -> int:
    """The number of matches l to ask for, given the ordered frequencies of a set's shared tokens."""
    most = min(least, MOST_MATCHES, len(df))
    postings = np.cumsum(df)[len(df) - least : len(df) - least + most].astype(float)
    matches = np.arange(1, len(postings) + 1)
    return int(np.argmin(postings + VERIFY_COST * n * postings / matches)) + 1


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set with enough shared tokens: its size, its tokens of no other set, its l, and its prefix in order."""
    whole = from_blobs([d for batch in batches for d in batch.column(2).to_pylist()], 4)
    for part in in_parts(0, *whole):
        yield from _prefixes(*part)


def _prefixes(k: np.ndarray, h: np.ndarray, df: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((h, df, k))
    k, h, df, n = k[order], h[order], df[order].astype(np.int64), n[order].astype(np.int64)
    edges = np.flatnonzero(np.diff(k, prepend=~k[:1], append=~k[-1:])) if len(k) else np.array([0])
    rows = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        size, shared = int(n[a]), b - a
        least = least_overlap(size)
        if shared < least:
            continue
        l = chosen_matches(df[a:b], least, size)
        upto = a + shared - least + l
        rows.append({"sid": int(k[a].astype(np.int64)), "n": size, "alone": size - shared, "matches": l, "tokens": h[a:upto].view(np.int64), "df": df[a:upto]})
        if len(rows) >= 500:
            yield pa.RecordBatch.from_pylist(rows, _PREFIX)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, _PREFIX)


_PREFIX = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("matches", pa.int64()), ("tokens", pa.list_(pa.int64())), ("df", pa.list_(pa.int64()))])
PREFIX = "sid long, n long, alone long, matches long, tokens array<long>, df array<long>"


def room(a: str, b: str) -> str:
    """SQL: whether two sets can link, given their sizes and the tokens that no other set has."""
    most = f"least({a}.n - {a}.alone, {b}.n - {b}.alone)"
    return f"100 * {most} >= {SIMILAR} * ({a}.n + {b}.n - {most})"


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * shared >= SIMILAR * (len(x) + len(y) - shared))
        yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(verify), "a long, b long")


#: Rows of a list that are compared at a time with all of it.
ROWS = 256


def across(members: list[dict], token: int, apart: bool) -> Iterator[tuple[int, int]]:
    """Candidates between the components of one posting list, or with apart of two blocks of it.

    A pair belongs to the list of its first shared prefix token. Up to the earlier of the two prefixes' ends all tokens
    of both are known, so those that differ there, and those of no other set, count against the overlap that is needed.
    """
    comps: dict[int, int] = {}
    for m in members:
        comps[m["component"]] = comps.get(m["component"], 0) + 1
    if len(comps) < 2:
        return
    top = max(comps, key=lambda c: (comps[c], c))
    members = sorted(members, key=lambda m: (m["component"] == top, m["sid"]))
    rest = sum(m["component"] != top for m in members)
    sizes = np.array([len(m["tokens"]) for m in members])
    h = np.concatenate([np.asarray(m["tokens"], dtype=np.int64) for m in members]).view(np.uint64)  # as prefixes() orders them
    df = np.concatenate([np.asarray(m["df"], dtype=np.int64) for m in members])
    order = np.lexsort((h, df))
    rank = np.empty(len(h), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (h[order][1:] != h[order][:-1])]))
    here = int(rank[np.flatnonzero(h == np.int64(token).view(np.uint64))[0]])
    row = np.repeat(np.arange(len(members)), sizes)
    shared = np.bincount(rank) > 1
    column = np.cumsum(shared) - 1
    used = shared[rank]
    has = np.zeros((len(members), int(shared.sum())), dtype=np.float32)
    has[row[used], column[rank[used]]] = 1
    before = has[:, : int(column[here])]
    starts = np.cumsum(sizes) - sizes
    ranks = [rank[a : a + s] for a, s in zip(starts, sizes, strict=True)]
    last = np.array([r[-1] for r in ranks])
    n, alone, matches = (np.array([m[c] for m in members]) for c in ("n", "alone", "matches"))
    comp, key, block = (np.array([m[c] for m in members]) for c in ("component", "sid", "block"))
    for a in range(0, rest, ROWS):
        b = min(rest, a + ROWS)
        common = has[a:b] @ has.T
        fine = (common >= np.minimum(matches[a:b, None], matches[None, :])) & (comp[a:b, None] != comp[None, :])
        fine &= (before[a:b] @ before.T) == 0
        fine &= np.arange(len(members))[None, :] > np.arange(a, b)[:, None]
        if apart:
            fine &= block[a:b, None] != block[None, :]
        for i, j in zip(*np.nonzero(fine), strict=True):
            i = int(i) + a
            end = min(last[i], last[j])
            both = common[i - a, j]
            need = -(-SIMILAR * (n[i] + n[j]) // (100 + SIMILAR))
            off_i = alone[i] + np.searchsorted(ranks[i], end, side="right") - both
            off_j = alone[j] + np.searchsorted(ranks[j], end, side="right") - both
            if off_i <= n[i] - need and off_j <= n[j] - need:
                yield (int(key[i]), int(key[j])) if key[i] < key[j] else (int(key[j]), int(key[i]))


def across_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """across() for each token and pair of blocks of rows that are sorted by them."""
    unit, held = None, []

    def close() -> pa.RecordBatch:
        pairs = list(across(held, unit[0], unit[1] != unit[2]))
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for row in batch.to_pylist():
            at = row["token"], row["lo"], row["hi"]
            if at != unit and held:
                yield close()
                held = []
            unit = at
            held.append(row)
    if held:
        yield close()


#: Rounds in which each set is verified against one set of another component before lists are compared in full.
PIVOT_ROUNDS = 2
#: Rows of one list that meet in one task: as many of its largest component, and half as many of the others.
BLOCK_ROWS = 1024


def pivots(placed: DataFrame, tried: DataFrame | None) -> DataFrame:
    """For each set at most one pair (a, b), not tried before, with a set of another component that stands first or last in
    most of its lists."""
    entries = placed.select("component", F.struct("sid", "n", "alone").alias("s"), F.explode("tokens").alias("token"))
    ends = entries.groupBy("token").agg(F.min(F.struct("component", "s")).alias("lo"), F.max(F.struct("component", "s")).alias("hi")).where("lo.component <> hi.component")
    met = entries.join(ends, "token").select("s", F.when(F.col("component") == F.col("lo.component"), F.col("hi.s")).otherwise(F.col("lo.s")).alias("p"))
    often = met.where(room("s", "p")).groupBy(F.col("s.sid").alias("s"), F.col("p.sid").alias("p")).agg(F.count(F.lit(1)).alias("shared"))
    fresh = often.withColumns({"a": F.least("s", "p"), "b": F.greatest("s", "p")})
    if tried is not None:
        fresh = fresh.join(tried, ["a", "b"], "left_anti")
    one = fresh.groupBy("s").agg(F.min(F.struct((-F.col("shared")).alias("shared"), "p", "a", "b")).alias("best"))
    return one.select("best.a", "best.b").distinct()


def units(placed: DataFrame) -> DataFrame:
    """Rows of across_lists(): each posting list with several components, cut into pairs of blocks (lo, hi) of bounded size.

    Blocks of a list's largest component come first and don't meet each other; the others meet all. A list of one block of
    each is one unit."""
    entries = placed.select("sid", "component", F.explode("tokens").alias("token"))
    per = entries.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    lists = per.groupBy("token").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m")).where("m > top.m")
    blocks = lambda n, most: F.greatest(F.lit(1), F.ceil(n / F.lit(most))).cast("int")
    lists = lists.select("token", F.col("top.component").alias("top"), blocks(F.col("top.m"), BLOCK_ROWS).alias("tops"), blocks(F.col("m") - F.col("top.m"), BLOCK_ROWS // 2).alias("others"))
    in_top, spread, small = F.col("component") == F.col("top"), F.xxhash64("sid"), F.expr("tops = 1 AND others = 1")
    block = F.when(small, 0).when(in_top, F.pmod(spread, F.col("tops"))).otherwise(F.col("tops") + F.pmod(spread, F.col("others"))).cast("int")
    own = entries.join(lists, "token").withColumn("block", block)
    last = F.expr("tops + others - 1")
    meets = F.when(small, F.array(F.lit(0))).when(in_top, F.sequence("tops", last)).otherwise(F.sequence(F.lit(0), last))
    cut = own.select("token", "sid", "component", "block", F.explode(meets).alias("other"))
    return cut.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "sid", "component", "block")


def links(sets: DataFrame) -> DataFrame:
    """A written table of a spanning part of the links between sets (sid, tokens): edges a, b that give the same components as all links."""
    width = width_for(sets)
    buckets = 2 * width  # each map task sends at most one row to a bucket
    often, df = frequent(sets)
    counted = sets.select("sid", "tokens").mapInArrow(lean(tokens_out(buckets, often, df)), BLOB).repartition(width, "bucket").mapInArrow(lean(frequencies(buckets)), BLOB)
    ordered = written(counted.repartition(width, "bucket").mapInArrow(lean(prefixes), PREFIX), "jaccard-prefixes")
    found, tried, placed, old = None, None, ordered.withColumn("component", F.col("sid")), [ordered]
    for _ in range(PIVOT_ROUNDS):
        pairs = written(pivots(placed, tried), "jaccard-pivots")
        linked = written(verified(pairs, sets), "jaccard-linked")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = linked if found is None else found.unionByName(linked)
        labels = components(found)
        now = ordered.join(labels, ordered["sid"] == labels["node"], "left").withColumn("component", F.coalesce("component", "sid")).drop("node")
        placed = written(now, "jaccard-placed")
        old += [pairs, linked, labels, placed]
    full = units(placed).join(placed.drop("component"), "sid").select("token", "lo", "hi", "block", "sid", "component", "n", "alone", "matches", "tokens", "df")
    candidates = full.repartition(width, "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(lean(across_lists), "a long, b long")
    left = written(candidates.distinct(), "jaccard-candidates")
    every = written(found.unionByName(verified(left, sets)), "jaccard-links")
    drop_scratch(left, *old)
    return every


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row, with mark, a hash of its text, and component, which tells components
    apart whose component_id is the same or null; rows without shingles have none. The result reads the tables in its
    attribute tables, which drop_scratch() deletes when it is no longer needed."""
    width = width_for(docs)
    buckets = 2 * width  # each map task sends at most one row to a bucket
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    mapped = rows.mapInArrow(lean(first_map(buckets)), FIRST).repartition(width, "bucket").mapInArrow(lean(first_count), FIRST)
    first = written(mapped.drop("bucket", "data"), "jaccard-first")
    own = first.where("n IS NOT NULL")
    distinct = own.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("one"), F.max("n").alias("n"))
    sets = written(distinct.withColumn("sid", F.monotonically_increasing_id()), "jaccard-distinct")
    hits = first.where("hits IS NOT NULL").groupBy("k1").agg(F.sum("hits").alias("hits"))
    overlap = f"(({SIMILAR} * n + 99) DIV 100)"
    alive = sets.join(hits, "k1").where(f"hits >= 1 + {overlap} DIV {FIRST_PER}").select("sid", "one.*")
    same = (F.col("r.mark") == F.col("s.mark")) & F.col("r.doc_id").eqNullSafe(F.col("s.doc_id"))
    texts = rows.alias("r").join(alive.alias("s"), same).select("s.sid", "r.text")
    full = written(texts.mapInArrow(lean(whole_sets), "sid long, tokens binary").dropDuplicates(["sid"]), "jaccard-sets")
    linked = links(full)
    labels = components(linked)
    named = sets.join(labels, sets["sid"] == labels["node"], "left").withColumn("component", F.coalesce("component", "sid"))
    named = written(named.select("k1", "k2", "least", "component"), "jaccard-named")
    drop_scratch(full, linked, labels, sets)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").select("k1", "k2", "component", "component_id")
    joined = own.join(known, ["k1", "k2"], "left")
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "mark", "component")
    out.tables = [first, named]
    return out
