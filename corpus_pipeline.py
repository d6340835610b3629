"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import decontaminate, jaccard, langid, mixing, secrets
from lectern.llm._shared import new_path, stored
from lectern.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a recognisable language (null texts, texts without letters) go; the others get the predicted one."""
    ship(spark)
    model = langid.train(docs.filter(~langid.held_out()))
    got = langid.identify(docs, model)
    return got.filter(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays, and every text without words.

    A null id counts as larger than any other; of rows equal in id and text one stays.
    """
    return jaccard.keep_one(docs).select(COLUMNS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth or more repeats benchmark windows go; each is judged by its own text, whatever its id."""
    return decontaminate.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("not contaminated").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are replaced by a mark. A null text stays null."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the mix, with how often and how many words of each; null and repeated ids are rows of their own."""
    rows = stored(docs.withColumn("lectern_row", F.monotonically_increasing_id()), "numbered")
    mixed = mixing.mix(rows, carry=("lectern_row",)).filter("copies > 0").select("lectern_row", F.col("size").alias("n_words"), "source_size", "target", "copies", "taken")
    return rows.join(mixed, "lectern_row").select(*COLUMNS, "n_words", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", deduplicate),
    ("decontamination", remove_contaminated),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
]

#: The kernel classifier of the first stage is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
