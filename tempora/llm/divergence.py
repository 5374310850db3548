"""How far the sources of a language stand apart in their words.

Each language keeps the terms that stand in enough of its documents. Every group (language, source), and the language as a whole,
gives each kept term a smoothed share of SCALE; two groups differ by the sum of floor((p - q)^2 / (p + q)) over the terms, and a
group's own terms are those whose share is above the language's.

The shares are dense: a group gives a share to terms that it never uses. So they are laid out as int64 tiles of groups by terms,
for a block of a language's terms and two blocks of its groups at a time. A tile is broadcast against itself to the differences of
all its pairs of groups, whose sums over the term blocks are added up; it also yields the heap of each group's best terms, and the
heaps of a group are merged by rank. A tile holds about TERMS terms and at most 2 * GROUPS groups, whatever the input; its pairs
are worked through a group at a time. Counts are summed within tasks before they are shuffled, so that no language or source meets
in one task.

All arithmetic is exact in 64 bits: shares are worked out by long division, for counts below 9 * 10^15 in a group or language;
more raise an error.

Defined results: null texts, languages and sources are read as ''. Rows with equal doc_id or text each count as a document. A
group without terms, or a language that keeps none, gives pairs all the same (of value 0 without terms). A language with one
source has no pairs. Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import drop_scratch, lean, written

#: Documents of a language that a kept term stands in at least; terms of a group that are listed; the whole of a group's shares.
LEAST_DOCS, LISTED, SCALE = 10, 10, 1_000_000_000
#: Terms of a tile on average, groups of one of its two sides, counts that a task sums up before it hands them on.
TERMS, GROUPS, HELD = 1024, 48, 200_000
MOST = 9 * 10**15
#: Bytes that belong to terms stay, with A-Z lower-cased; the others separate them. Bytes from 0x80 on belong to
#: characters outside ASCII, which are all part of terms.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs (documents that hold it); a row with term null counts the documents of a group."""
    schema = "lang string, source string, term string, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        rows: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                keys = list(n)
                columns = [[lang] * len(keys), [source] * len(keys), [k.decode() for k in keys], [n[k] for k in keys], [docs[k] for k in keys]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            held.clear()

        for batch in batches:
            size = 0
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = terms_of(text.as_py())
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                rows[lang, source] += 1
                n.update(found)
                docs.update(set(found))
                size += len(found)
                if size > HELD:  # an upper bound of what has come since the last look
                    size = 0
                    if sum(len(x) for x, _ in held.values()) > HELD:
                        yield from out()
            if sum(len(x) for x, _ in held.values()) > HELD:
                yield from out()
        yield from out()
        keys = list(rows)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [None] * len(keys), [0] * len(keys), [rows[k] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kinds, names = [pa.string()] * 3 + [pa.int64()] * 2, ["lang", "source", "term", "n", "docs"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(text("lang").alias("lang"), text("source").alias("source"), F.encode(text("text"), "UTF-8").alias("text"))
    return read.mapInArrow(lean(run), schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total), by long division in base 1000 so that nothing overflows."""
    rest, out = n.astype(np.int64), np.zeros(np.broadcast(n, total).shape, dtype=np.int64)
    rest = np.broadcast_to(rest, out.shape)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


TILE = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("term", pa.string()), ("value", pa.int64())])


def tile(table: pa.Table) -> pa.Table:
    """Of one language, block of terms and two blocks of groups: the pairs' part sums, and where the two blocks are one the best
    terms of each group. table: groups (term null), the language's counts of terms (at -1), and counts of groups."""
    rows = table.to_pandas()
    groups = rows[rows["term"].isna() & (rows["at"] >= 0)].sort_values("at")
    whole = rows[rows["at"] < 0]
    told = whole[whole["term"].notna()].sort_values("term", key=lambda s: s.str.encode("utf-8"))
    cells = rows[rows["term"].notna() & (rows["at"] >= 0)]
    at, terms = groups["at"].to_numpy(), told["term"].to_numpy()
    n = np.zeros((len(groups), len(terms)), dtype=np.int64)
    n[np.searchsorted(at, cells["at"].to_numpy()), pd.Index(terms).get_indexer(cells["term"])] = cells["n"].to_numpy()
    kept, lang_total = rows["kept"].iloc[0], rows["lang_total"].iloc[0]
    p = shares(n + 2, (groups["total"].to_numpy() + 2 * kept)[:, None]) if len(terms) else n
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    side = groups["block"].to_numpy()
    a, b, value = [], [], []
    for x in np.flatnonzero(side == i):
        ys = np.flatnonzero((side == j) & (at > at[x]))
        a += [int(at[x])] * len(ys)
        b += at[ys].tolist()
        value += apart(p[x][None, :], p[ys]).sum(axis=1).tolist()
    out = {"a": a, "b": b, "term": [None] * len(a), "value": value}
    if i == j and len(terms):
        q = shares(told["n"].to_numpy() + 2, np.int64(lang_total + 2 * kept))
        for x in range(len(at)):
            own = np.flatnonzero((n[x] > 0) & (p[x] > q))
            far = apart(p[x][own], q[own])
            best = heapq.nsmallest(LISTED, zip((-far).tolist(), own.tolist(), strict=True))  # terms stand in ascending order
            out["a"] += [int(at[x])] * len(best)
            out["b"] += [-1] * len(best)
            out["term"] += [terms[k] for _, k in best]
            out["value"] += [-f for f, _ in best]
    return pa.table({"lang": [rows["lang"].iloc[0]] * len(out["a"]), **out}, schema=TILE)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank."""
    counts = written(counted(docs), "divergence-counts")
    known = counts.where("term is not null")
    of_lang = known.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "n")
    kept = written(of_lang, "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    cells = written(known.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"]), "divergence-cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    exact = lambda c: F.when(F.coalesce(F.col(c), zero) < MOST, F.coalesce(F.col(c), zero)).otherwise(F.raise_error(F.lit("a count is too large for exact arithmetic")).cast("long")).alias(c)
    groups = (
        counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", exact("total"), exact("kept"), exact("lang_total"))
        .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
        .withColumn("block", F.floor(F.col("at") / GROUPS))
    )
    groups = written(groups, "divergence-groups")
    sizes = groups.groupBy("lang").agg(F.max("kept").alias("kept"), F.max("lang_total").alias("lang_total"), (F.max("block") + 1).alias("blocks"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS))
    block_of = F.pmod(F.xxhash64("term"), blocks)
    # A row of block b goes to the tiles of (b, x) and (x, b) for each x; those of the language go to all tiles.
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    all_pairs = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.transform(F.sequence(x, F.col("blocks") - 1), lambda y: F.struct(x.alias("i"), y.alias("j")))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))
    none = F.lit(None).cast("string")
    columns = ["lang", "tb", "p.i", "p.j", "at", "block", "term", "n", "total", "kept", "lang_total"]
    of_groups = groups.drop("source", "kept", "lang_total").join(sizes, "lang").withColumn("tb", every).withColumn("p", F.explode(meets)).withColumns({"term": none, "n": F.lit(0).cast("long")})
    of_terms = kept.join(sizes, "lang").withColumn("tb", block_of).withColumn("p", F.explode(all_pairs)).withColumns({"at": F.lit(-1).cast("long"), "block": F.lit(-1).cast("long"), "total": F.lit(0).cast("long")})
    of_cells = cells.join(groups.select("lang", "source", "at", "block", "total"), ["lang", "source"]).join(sizes, "lang").withColumn("tb", block_of).withColumn("p", F.explode(meets))
    rows = of_groups.select(*columns).unionByName(of_terms.select(*columns)).unionByName(of_cells.select(*columns))
    tiles = rows.groupBy("lang", "tb", "i", "j").applyInArrow(tile, "lang string, a long, b long, term string, value long")
    parts = written(tiles, "divergence-tiles")

    pairs = parts.where("b >= 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("lang", "p.a", "p.b", "value")
    name = lambda c, as_: groups.select("lang", F.col("at").alias(c), F.col("source").alias(as_))
    paired = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    owned = parts.where("b < 0").join(name("a", "source"), ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    ranked = lambda df: df.withColumn("rank", rank)
    out = ranked(paired).unionByName(ranked(owned).where(F.col("rank") <= LISTED))
    drop_scratch(counts, kept, cells)
    return out

