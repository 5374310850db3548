"""Statements of a knowledge base, from its JSON: entities, their statements of some properties, and the terms that these tell.

Only the properties that are asked for are parsed, by a schema made for them; values stay JSON text until a column needs them, so
that statements with other kinds of values do no harm. Texts that are no JSON, and entities without such statements, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import names

SNAK = "struct<datavalue:struct<value:string>>"
STATEMENT = f"struct<id:string,rank:string,mainsnak:{SNAK},qualifiers:map<string,array<{SNAK}>>>"
TIME = "struct<time:string,precision:int,before:int,after:int,calendarmodel:string>"
#: Properties of a term's start and end, of what it is qualified by and of what a statement is, the properties whose
#: presence bars a term, and marks of statements that don't hold as they stand.
START, END, QUALIFIED, NATURE, DISPUTED = "P580", "P582", "P1480", "P1552", "P5102"
BARRED = ("P1319", "P1326", "P518", "P5102")
DOUBTED = ("Q18912752", "Q18122778")


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """text: the lines of files, or each file as one (whole)."""
    return spark.read.text(path, wholetext=whole).select(F.col("value").alias("text"))


def entities(texts: DataFrame) -> DataFrame:
    """entity and body (JSON) of texts: an entity each, or an answer with a table of entities."""
    many = F.from_json("text", "struct<entities:map<string,string>,id:string>")
    listed = texts.select("text", many.alias("m"))
    told = listed.where("m.entities IS NOT NULL").select(F.explode("m.entities").alias("entity", "body"))
    return told.unionByName(listed.where("m.entities IS NULL AND m.id IS NOT NULL").select(F.col("m.id").alias("entity"), F.col("text").alias("body")))


def statements(found: DataFrame, properties: list[str]) -> DataFrame:
    """Entity, label, property, ord (place among the entity's statements of it), rank, target (an entity or null), starts and ends
    (times), qualified and nature (ids), and qualifiers (properties)."""
    schema = f"struct<labels:struct<en:struct<value:string>>,claims:struct<{','.join(f'{p}:array<{STATEMENT}>' for p in properties)}>>"
    parsed = found.select("entity", F.from_json("body", schema).alias("b"))
    by = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(f"b.claims.{p}").alias("all")) for p in properties]))
    each = parsed.select("entity", F.col("b.labels.en.value").alias("label"), by.alias("p")).select("entity", "label", "p.property", F.posexplode("p.all").alias("ord", "s"))
    value = lambda snak: snak["datavalue"]["value"]
    snaks = lambda p: F.coalesce(F.try_element_at("s.qualifiers", F.lit(p)), F.array().cast(f"array<{SNAK}>"))
    times = lambda p: F.transform(snaks(p), lambda x: F.from_json(value(x), TIME))
    ids = lambda p: F.array_compact(F.transform(snaks(p), lambda x: F.get_json_object(value(x), "$.id")))
    return each.where("s IS NOT NULL").select(
        "entity", "label", "property", "ord", F.col("s.rank").alias("rank"), F.get_json_object("s.mainsnak.datavalue.value", "$.id").alias("target"), times(START).alias("starts"), times(END).alias("ends"),
        ids(QUALIFIED).alias("qualified"), ids(NATURE).alias("nature"), F.coalesce(F.map_keys("s.qualifiers"), F.array().cast("array<string>")).alias("qualifiers"),
    )


def terms(told: DataFrame) -> DataFrame:
    """Entity, property, ord, target, f, t and precision of statements that tell one term and are not deprecated."""
    barred = F.arrays_overlap("qualifiers", F.array(*[F.lit(p) for p in BARRED]))
    term = names.statement_term(F.col("starts"), F.col("ends"), F.col("qualified"), barred)
    line = told.where("rank IS NULL OR rank <> 'deprecated'").select("entity", "property", "ord", "target", term.alias("r")).where("r IS NOT NULL")
    return line.select("entity", "property", "ord", "target", F.col("r.f").alias("f"), F.col("r.t").alias("t"), F.col("r.precision").alias("precision"))


def _one_year(times: Column) -> Column:
    """The year that all readable ones of some times name."""
    years = F.array_distinct(F.array_compact(F.transform(times, names.statement_year)))
    return F.when(F.size(years) == 1, years[0])


def doubted(told: DataFrame) -> DataFrame:
    """entity, target, f and t of positions that are disputed or marked as unsure, with a known start and end."""
    mark = F.arrays_overlap(F.concat("qualified", "nature"), F.array(*[F.lit(q) for q in DOUBTED]))
    line = told.where("rank IS NULL OR rank <> 'deprecated'").where(F.array_contains("qualifiers", DISPUTED) | mark)
    return line.select("entity", "target", _one_year(F.col("starts")).alias("f"), _one_year(F.col("ends")).alias("t")).where("f IS NOT NULL AND t IS NOT NULL")
