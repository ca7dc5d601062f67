"""Small reference files: taxonomy, rater labels, id lists; and the mart sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: layout of the taxonomy file and of a rater file
CODEBOOK_SCHEMA = """
    version STRING,
    categories ARRAY<STRUCT<id: STRING, name: STRING, definition: STRING,
        subaspects: ARRAY<STRUCT<id: STRING, name: STRING, definition: STRING>>>>
"""
GOLD_SCHEMA = "id STRING, aspects ARRAY<STRUCT<id: STRING, sentiment: STRING>>"
# fixed values: the service aspect for topics outside the taxonomy
OTHER_ASPECT = {
    "aspect_id": "other",
    "aspect_name": "Other",
    "aspect_definition": "Topic outside the codebook, named by a short label in note.",
    "category_id": "other",
    "category_name": "Other",
    "category_definition": "Topics outside the codebook.",
}


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    return aspect_rows(spark.read.schema(CODEBOOK_SCHEMA).json(path, multiLine=True))


def aspect_rows(codebook: DataFrame) -> DataFrame:
    """Nested taxonomy -> one row per aspect, plus the service row ``other`` of each version."""
    rows = (
        codebook.select(F.col("version").alias("codebook_version"), F.explode("categories").alias("c"))
        .select("codebook_version", "c", F.explode("c.subaspects").alias("s"))
        .select(
            "codebook_version",
            F.col("s.id").alias("aspect_id"),
            F.col("s.name").alias("aspect_name"),
            F.col("s.definition").alias("aspect_definition"),
            F.col("c.id").alias("category_id"),
            F.col("c.name").alias("category_name"),
            F.col("c.definition").alias("category_definition"),
        )
    )
    other = codebook.select(
        F.col("version").alias("codebook_version"), *[F.lit(v).alias(k) for k, v in OTHER_ASPECT.items()]
    ).distinct()
    return rows.unionByName(other)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return gold_rows(spark.read.schema(GOLD_SCHEMA).json(path, multiLine=True))


def gold_rows(gold: DataFrame) -> DataFrame:
    """One row per (review, aspect). A repeated aspect keeps its last sign, as a mapping would."""
    tags = gold.select(
        F.col("id").cast("bigint").alias("recommendation_id"), F.posexplode("aspects").alias("pos", "a")
    )
    return tags.groupBy("recommendation_id", F.col("a.id").alias("aspect_id")).agg(
        F.max_by("a.sentiment", "pos").alias("sentiment")
    )


def _id_lines(spark: SparkSession, path: str) -> DataFrame:
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    lines = spark.read.text(path).select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return lines.withColumn("recommendation_id", F.col("line").try_cast("bigint"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Review ids, one per line; blank lines and comment lines are skipped, lines that are no id are left to ``bad_id_lines``."""
    return _id_lines(spark, path).filter("recommendation_id is not null").select("recommendation_id")


def bad_id_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id list that are neither an id nor a comment."""
    return _id_lines(spark, path).filter("recommendation_id is null").select("line")


def write_mart(df: DataFrame, target: str, kind: str = "table") -> DataFrame:
    """Materialise a mart: ``table`` writes Parquet at ``target``, ``view`` registers the name only."""
    spark = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(target)
        return spark.table(target)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
