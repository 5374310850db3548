"""Layers of features and the registry that names them.

Geometry comes as GeoJSON text and becomes a shape (see tempora.functions.geometry): polygons as they are, other kinds null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import geometry as G
from tempora.operators import polygons
from tempora.operators import rules as R
from tempora.sources import adapters, publication
from tempora.sources.stores import written

#: Properties of one source's features, of country layers, and the name that no country layer keeps.
RECORD = "Name string, FromYear int, ToYear int, Type string, Components string, Wikipedia string, SeshatID string, Wikidata string"
COUNTRY = "ADMIN string, NAME string, ISO_A2 string, ADM0_A3 string"
CLASSED = "featurecla string, scalerank int"
NO_COUNTRY = "Antarctica"
REGISTRY = "id string, title string, provider string, tier int, grade string, format string, role string, path string, polity string, wikidata string, lo int, hi int, bx0 double, by0 double, bx1 double, by1 double"
_TABLES: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a YAML registry; authority becomes lo, hi and the corners of its box. The file is a page of names."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    for s in (yaml.safe_load(text) or {}).get("sources", []):
        domain = s.get("authority") or {}
        years, box = domain.get("years") or [None, None], domain.get("bbox") or [None] * 4
        rows.append((*(s.get(c) for c in ("id", "title", "provider", "tier", "grade", "format", "role", "path", "polity", "wikidata")), *years, *(None if b is None else float(b) for b in box)))
    return spark.createDataFrame(rows, REGISTRY)


def shape_of(geometry: Column) -> Column:
    """A shape from GeoJSON text; anything but polygons is null."""
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    ring = lambda points: F.transform(points, lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    polygon = lambda rings: F.transform(rings, ring)
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.array(polygon(one))).when(kind == "MultiPolygon", F.transform(many, polygon))


def geojson_of(shape: Column) -> Column:
    """GeoJSON text of a shape: a MultiPolygon."""
    coordinates = G.mapped(shape, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return F.when(shape.isNotNull(), F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))))


def feature_table(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The features of a file, read once and kept as a stored table for all later scans of the session, until the file changes."""
    key, now = (spark.sparkContext.applicationId, path, properties), publication.state(spark, path)
    if key not in _TABLES or _TABLES[key][0] != now:
        _TABLES[key] = (now, written(adapters.features(spark, path, properties), "features"))
    return _TABLES[key][1]


def polygon_records(spark: SparkSession, path: str, source: str, year: int, rules: list[dict]) -> DataFrame:
    """S3: records of a source in force in a year by their raw bounds, then as rules say, with repaired shapes; those without one go."""
    raw = feature_table(spark, path, RECORD).where((F.col("FromYear") <= year) & (F.col("ToYear") >= year))
    line = raw.select(
        F.monotonically_increasing_id().alias("id"), F.lit(source).alias("source"), F.col("Name").alias("name"), F.col("Type").alias("type"), F.col("Components").alias("components"),
        F.col("FromYear").alias("from_year"), F.col("Wikidata").alias("wikidata"), F.col("FromYear").alias("f"), F.col("ToYear").alias("t"), "geometry",
    )
    return R.apply_rules(line, rules).withColumn("shape", G.repaired(shape_of(F.col("geometry")))).where("shape IS NOT NULL").drop("geometry")


def union_layer(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """The union of all polygons of a layer, a row for each polygon of it. Rings are repaired first."""
    layer = feature_table(spark, path, "layer string").withColumn("shape", shape_of(F.col("geometry")))
    chosen = layer if keep is None else layer.where(keep)
    valid = polygons.made_valid(chosen.select("shape"), "shape", "fixed").where("fixed IS NOT NULL")
    return polygons.dissolved(valid.select(F.lit(1).alias("all"), F.col("fixed").alias("shape")), ["all"]).select("shape")


def snapshot_index(spark: SparkSession, folder: str) -> DataFrame:
    """Year and path of the snapshots of a folder, by their names; others don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "world_*.geojson").load(folder).select("path")
    return files.select(adapters.snapshot_year(F.col("path")).alias("year"), "path").where("year IS NOT NULL")


def snapshot_records(spark: SparkSession, folder: str, year: int, tolerance: int = 150) -> DataFrame:
    """Named polygons of the snapshot nearest to a year, the earlier of equals, none beyond the tolerance."""
    from pyspark.sql.types import StringType, StructField, StructType

    found = snapshot_index(spark, folder).withColumn("gap", F.abs(F.col("year") - year)).orderBy("gap", "year").limit(1).collect()
    if not found or found[0]["gap"] > tolerance:
        return spark.createDataFrame([], StructType([StructField("name", StringType())])).withColumns({"year": F.lit(None).cast("int"), "shape": F.lit(None).cast(G.SHAPE)})
    layer = feature_table(spark, found[0]["path"], "NAME string")
    named = layer.where(F.trim("NAME") != "").select(F.col("NAME").alias("name"), F.lit(found[0]["year"]).alias("year"), shape_of(F.col("geometry")).alias("shape"))
    return named.where("shape IS NOT NULL")


def countries(spark: SparkSession, path: str, tolerance: float = 0.05) -> DataFrame:
    """Name, code and simplified shape of a country layer."""
    layer = feature_table(spark, path, COUNTRY)
    name = F.coalesce(F.nullif(F.trim("ADMIN"), F.lit("")), F.trim("NAME"))
    code = F.when(F.col("ISO_A2") != "-99", F.col("ISO_A2")).otherwise(F.col("ADM0_A3"))
    line = layer.select(name.alias("name"), code.alias("code"), shape_of(F.col("geometry")).alias("shape")).where(f"name <> '{NO_COUNTRY}' AND name <> '' AND shape IS NOT NULL")
    return line.withColumn("shape", G.simplified(F.col("shape"), tolerance))


def classed_features(spark: SparkSession, path: str, classes: list[str], tolerance: float = 0.01) -> DataFrame:
    """Simplified, clockwise features of some classes with their rank r, in order of rank and of the start of their coordinates."""
    layer = feature_table(spark, path, CLASSED).where(F.col("featurecla").isin(classes))
    shape = G.oriented(G.simplified(shape_of(F.col("geometry")), tolerance))
    line = layer.select(F.col("scalerank").alias("r"), shape.alias("shape")).where("shape IS NOT NULL").withColumn("geometry", geojson_of(F.col("shape")))
    return line.orderBy("r", F.substring("geometry", 1, 80))


def relief(cells: DataFrame, value: str = "value", gain: float = 2.0) -> DataFrame:
    """Shades of a raster's cells around the commonest one, which becomes 128, the smallest of equals: differences times a gain, held to 0..255."""
    middle = cells.agg(F.mode(value, deterministic=True).alias("middle"))
    shade = F.greatest(F.lit(0), F.least(F.lit(255), F.round(128 + gain * (F.col(value) - F.col("middle"))))).cast("int")
    return cells.crossJoin(F.broadcast(middle)).withColumn("shade", shade).drop("middle")


def raster_cells(spark: SparkSession, path: str, width: int) -> DataFrame:
    """X, y and value of the bytes of a raster stored row by row, width cells to a row; a file is one task's work."""
    import pandas as pd

    def cells(frames):
        import numpy as np

        for frame in frames:
            for content in frame["content"]:
                data = np.frombuffer(content, dtype=np.uint8)
                at = np.arange(len(data))
                yield pd.DataFrame({"x": at % width, "y": at // width, "value": data.astype(np.int32)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cells, "x long, y long, value int")


#: Rows of a Stata file that a task hands on at a time.
STATA_ROWS = 50_000


def stata_rows(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of Stata files, only the columns that are asked for (source name to name). A task reads a file and hands its rows on in
    parts; to the driver go the kinds of its columns alone."""
    import io

    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("content")
    reader = lambda content, rows: pd.read_stata(io.BytesIO(content), convert_categoricals=False, columns=list(columns), chunksize=rows)

    def kinds(frames):
        for frame in frames:
            for content in frame["content"]:
                with reader(content, 1) as parts:
                    first = next(iter(parts))
                yield pd.DataFrame({"name": list(columns), "kind": [first[c].dtype.kind for c in columns]})

    told = dict(map(tuple, files.mapInPandas(kinds, "name string, kind string").distinct().collect()))
    named = {"i": "long", "u": "long", "f": "double", "b": "boolean", "M": "timestamp"}
    schema = ", ".join(f"`{new}` {named.get(told.get(old), 'string')}" for old, new in columns.items())

    def rows(frames):
        for frame in frames:
            for content in frame["content"]:
                with reader(content, STATA_ROWS) as parts:
                    for part in parts:
                        yield part[list(columns)].rename(columns=columns)

    return files.mapInPandas(rows, schema)


def stata_records(spark: SparkSession, path: str, columns: dict[str, str], labels: DataFrame) -> DataFrame:
    """Rows of Stata files (columns: source name to name) with the label of their code and country (code, idacr, label). A code
    with two labels is an error."""
    once = labels.groupBy("code", "idacr").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label"))
    sure = once.select("code", "idacr", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two labels for "), "code"))).otherwise(F.col("label")).alias("label"))
    return stata_rows(spark, path, columns).join(sure, ["code", "idacr"], "left")


def star_records(rulers: DataFrame, dynasties: DataFrame) -> DataFrame:
    """Rulers (dynasty_id, name, from, to, note) with their dynasty (dynasty_id, dynasty, branch) and flags of what is unsure; a
    ruler of no known dynasty is an error."""
    line = rulers.join(dynasties, "dynasty_id", "left")
    known = F.when(F.col("dynasty").isNull(), F.raise_error(F.concat(F.lit("no dynasty "), F.col("dynasty_id")))).otherwise(F.col("dynasty"))
    flags = F.array_compact(F.array(F.when(F.col("from").isNull() | F.col("to").isNull(), "unknown-bound"), F.when(F.col("branch").isNotNull(), "branch"), F.when(F.col("note").rlike(r"(?i)\b(?:joint|co-)"), "joint")))
    return line.withColumn("dynasty", known).withColumn("flags", flags)


def reign_rows(rows: DataFrame) -> DataFrame:
    """A table of reigns (Monarch, Kingdom, Start date, End date, line) as records with an id of their line and typed bounds."""
    from tempora.functions.dates import date_bound
    from tempora.functions.names import state_key

    rid = F.concat(F.lit("csv-row-"), F.col("line"))
    return rows.select(rid.alias("rid"), F.col("Monarch").alias("name"), F.col("Kingdom").alias("polity"), state_key(F.col("Kingdom")).alias("polity_key"), date_bound(F.col("Start date")).alias("from"), date_bound(F.col("End date")).alias("to"))


def publish(df: DataFrame, path: str, form: str = "json") -> None:
    """See publication.publish."""
    publication.publish(df, path, form)


def checked(df: DataFrame, path: str) -> None:
    """Fails if the table that is published at a path is not what df gives."""
    if not adapters.stale(df, publication.published(df.sparkSession, path, schema=df.schema)).isEmpty():
        raise ValueError(f"{path} is stale")
