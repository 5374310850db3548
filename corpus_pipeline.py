"""A corpus pipeline: quality rules, near-duplicate removal, personal data, mixing and token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
Stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import jaccard, mixing, pii, quality, sentencepieces
from tempora.llm.common import drop_scratch, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality.apply_policy(quality.ledger(docs, COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the smallest doc_id, null last, then the smallest hash of the text; of rows that are equal
    in both the one that is smallest in its other columns.

    What stays is told by doc_id and a hash of the text; documents without shingles all stay."""
    same = lambda a, b: (F.col(f"{a}.mark") == F.col(f"{b}.mark")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    joined = jaccard.join(docs)
    alike = joined.where("n_shingles > 0").groupBy("component", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    alike = written(alike, "pipeline-alike")
    drop_scratch(*joined.tables)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "copies")
    kept = written(alike.groupBy("component").agg(F.min(first).alias("one")).select("one.doc_id", "one.mark", "one.copies"), "pipeline-kept")
    # Copies that are equal in doc_id and text are few as a rule, so that this table is read once more for them alone.
    repeated = written(kept.where("copies > 1").select("doc_id", "mark"), "pipeline-repeated")
    drop = alike.alias("a").join(kept.alias("k"), same("a", "k"), "left_anti").select("doc_id", "mark").unionByName(repeated)
    rows = docs.withColumn("mark", F.xxhash64(F.col("text").cast("string")))
    left = rows.alias("r").join(drop.alias("d"), same("r", "d"), "left_anti").select(*COLUMNS)
    copies = rows.alias("r").join(repeated.alias("d"), same("r", "d"), "left_semi")
    single = copies.groupBy("doc_id", "mark").agg(F.min(F.struct(*COLUMNS)).alias("one")).select("one.*")
    return left.unionByName(single)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.masked(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands in it as often as its source's queue gave it."""
    return mixing.schedule(docs, COLUMNS).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document of the mix."""
    return sentencepieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("sentencepiece", token_ids)]

#: The vote model of personal data and the token ids have no SQL; a test compares run() and each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
