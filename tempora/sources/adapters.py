"""Readers and writers: rule files, GeoJSON, wide and long CSV, HTML tables, numbered lines, receipts, fingerprints.

All read through Spark, so that paths may lie in any store. Defined results: blank and # lines of a rule file are no rules;
cells that are no numbers go; tables inside tables are tables of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rule_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rules of a JSONL file whose status is active, which is the default."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    rules = lines.select(F.from_json("value", schema).alias("r"))
    return rules.select("r.*").where(F.coalesce("status", F.lit("active")) == "active")


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON collection: their properties, and geometry as text."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:string>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    return found.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry").alias("geometry"))


def as_collection(records: DataFrame, geometry: str) -> DataFrame:
    """A feature text for each record, with the other columns as its properties; lines of a GeoJSON sequence. The geometry is
    GeoJSON text of any type and stands as it is; a null one stays null."""
    others = [c for c in records.columns if c != geometry]
    properties = F.to_json(F.struct(*others), {"ignoreNullFields": "false"})
    return records.select(F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit("}")).alias("value"))


def unpivoted(wide: DataFrame, keep: list[str]) -> DataFrame:
    """Columns BC_n and AD_n as rows keep, year, value: numbers above 0 only."""
    years = [c for c in wide.columns if c[:3] in ("BC_", "AD_")]
    value = lambda c: F.struct(F.lit(int(c[3:]) * (-1 if c[0] == "B" else 1)).alias("year"), F.col(f"`{c}`").cast("string").try_cast("double").alias("value"))
    return wide.select(*keep, F.explode(F.array(*[value(c) for c in years])).alias("p")).select(*keep, "p.*").where("value > 0")


def long_series(rows: DataFrame, entity: str) -> DataFrame:
    """year and value of one entity of a long table (entity, year, value); rows that are no numbers go."""
    return rows.where(F.col("entity") == entity).select(F.col("year").cast("string").try_cast("int").alias("year"), F.col("value").cast("string").try_cast("double").alias("value")).where("year IS NOT NULL AND value IS NOT NULL")


def snapshot_year(path: Column) -> Column:
    """The year in names like world_bc200.geojson."""
    n = F.regexp_extract(path, r"world_(bc)?(\d+)\.geojson", 2).try_cast("int")
    return F.when(F.regexp_extract(path, r"world_(bc)?\d+\.geojson", 1) == "bc", -n).otherwise(n)


def numbered_lines(texts: DataFrame, key: str) -> DataFrame:
    """key, line and text of lines like `L12: text`."""
    row = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(L\d+:.*)$"), F.lit(1))).alias("l")
    return texts.select(key, row).select(key, F.regexp_extract("l", r"^L(\d+):", 1).cast("int").alias("line"), F.trim(F.regexp_replace("l", r"^L\d+:", "")).alias("text"))


#: The widest and highest span of a cell that is believed.
MOST_COLUMNS, MOST_ROWS = 30, 300


class _Tables(HTMLParser):
    """Rows of the tables of a page as (text, colspan, rowspan); a nested table is finished before its parent."""

    def __init__(self):
        super().__init__()
        self.done: list[list[list[tuple[str, int, int]]]] = []
        self.open: list[dict] = []

    @staticmethod
    def span(value: str | None, most: int) -> int:
        digits = (value or "").strip().split(" ")[0]
        return max(1, min(most, int(digits))) if digits.isascii() and digits.isdigit() else 1

    def close_cell(self) -> None:
        t = self.open[-1]
        if t["cell"] is not None:
            words, width, height = t["cell"]
            t["rows"][-1].append((" ".join("".join(words).split()), width, height))
            t["cell"] = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"rows": [], "cell": None})
        elif self.open and tag == "tr":
            self.close_cell()
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            self.close_cell()
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            a = dict(attrs)
            self.open[-1]["cell"] = ([], self.span(a.get("colspan"), MOST_COLUMNS), self.span(a.get("rowspan"), MOST_ROWS))

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag == "table":
            self.done.append(self.open.pop()["rows"])

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"][0].append(data)

    def finish(self):
        self.close()
        while self.open:
            self.handle_endtag("table")
        return self.done


def rectangle(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows with every spanning cell repeated in all places that it covers."""
    placed: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for text, width, height in row:
            while (y, x) in placed:
                x += 1
            for dy in range(min(height, len(rows) - y)):
                for dx in range(width):
                    placed.setdefault((y + dy, x + dx), text)
            x += width
    out: list[list[str]] = [[] for _ in rows]
    for y, x in sorted(placed):
        out[y].append(placed[y, x])
    return out


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, row and cells of all tables of pages; a null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Tables()
                parser.feed(page or "")
                found += [{"key": k, "table": t, "row": y, "cells": cells} for t, rows in enumerate(parser.finish()) for y, cells in enumerate(rectangle(rows))]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("key", pa.int64()), ("table", pa.int32()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))]))

    return pages.select(F.col(key).cast("long"), html).mapInArrow(run, "key long, table int, row int, cells array<string>").withColumnRenamed("key", key)


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at and href of the quoted links of pages, in order."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s(?:[^>]*?\s)?href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("at", "href"))


def fingerprints(files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of files that the binaryFile reader gives."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def receipt_faults(receipts: DataFrame, prints: DataFrame) -> DataFrame:
    """path and fault of receipts (path, sha256): conflicting, outside (its path climbs), missing or changed."""
    seen = receipts.groupBy("path").agg(F.count_distinct("sha256").alias("n"), F.min("sha256").alias("told"))
    j = seen.join(prints.select("path", "sha256"), "path", "left")
    fault = F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"), "outside").when(F.col("n") > 1, "conflicting").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("told"), "changed")
    return j.select("path", fault.alias("fault")).where("fault IS NOT NULL")


def stale(built: DataFrame, published: DataFrame) -> DataFrame:
    """Rows that only one side has, with side: none if the published rows are what a build gives."""
    return built.exceptAll(published).withColumn("side", F.lit("built")).unionByName(published.exceptAll(built).withColumn("side", F.lit("published")))


ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda s, p: s.read.parquet(p),
    "csv": lambda s, p: s.read.option("header", True).csv(p),
    "csv_latin1": lambda s, p: s.read.option("header", True).option("encoding", "ISO-8859-1").csv(p),
    "jsonl": lambda s, p: s.read.json(p),
    "files": lambda s, p: s.read.format("binaryFile").load(p),
}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame | None:
    """The table that a kind of source holds; None for a kind without an adapter."""
    return ADAPTERS[kind](spark, path) if kind in ADAPTERS else None
