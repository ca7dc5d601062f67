"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, tokens.

Each stage reads what its predecessor wrote and calls one operator of ``tideline.llm`` with production parameters. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.bytebpe import round_trip
from tideline.llm.decontaminate import decontaminate
from tideline.llm.neardup import near_duplicates
from tideline.llm.quality import quality
from tideline.llm.secrets import redact
from tideline.llm.shared import table, written

#: words of a shingle, least similarity and collections of the near-duplicate stage: it misses a pair at 0.8 with 4e-5
SHINGLE, PERCENT, COLLECTIONS = 5, 80, 13


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1; texts without words are judged by the bias alone."""
    return quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def with_text_ids(docs: DataFrame, name: str) -> DataFrame:
    """Adds a number for each id and text: the id itself, but numbers above all ids for the further texts of one id."""
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    own = docs.select("doc_id", digest.alias("digest")).where("doc_id is not null")
    several = own.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last")
    further = own.join(several.select("doc_id", "first"), "doc_id").where("digest <> first").select("doc_id", "digest").distinct()
    # numbered once and written, so that a number means the same text everywhere
    further = written(further.withColumn("place", F.monotonically_increasing_id()), "further-texts")
    most = docs.agg(F.max("doc_id").alias("most")).first().most
    same = (docs["doc_id"] == further["doc_id"]) & (digest == further["digest"])
    number = F.coalesce(F.lit(most) + 1 + F.col("place"), docs["doc_id"])
    return docs.join(further, same, "left").select(*[docs[c] for c in docs.columns], number.cast("long").alias(name))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, and of equal rows one row.

    Rows that share an id but not their text are documents of their own, each kept or dropped by its own text. Rows without
    an id are in no group and all stay.
    """
    name = "text_id"
    while name in docs.columns:
        name += "_"
    numbered = with_text_ids(docs, name)
    found = near_duplicates(numbered, id_col=name, shingle=SHINGLE, percent=PERCENT, collections=COLLECTIONS)
    kept = found.where("kept").where(F.col(name).isNotNull()).select(name).distinct()
    # of rows with one id and text the least in the order of all their columns
    first = numbered.join(kept, name).groupBy(name).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return first.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window.

    Each row is judged by its own text, whatever its id: hits are named by the digest of the text that was read.
    """
    digest = F.unhex(F.sha2(docs["text"], 256))
    found = decontaminate(docs.select(digest.alias("hit"), "text"), table(spark, sf_dir, "benchmark"), id_col="hit")
    hit = found.where("n_hit > 0").select("hit").distinct()
    # hits may be few or many: written, so that their size decides how they are joined
    hit = written(hit, "contaminated")
    return docs.join(hit, digest == hit["hit"], "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the characters of every secret replaced by a mark; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining texts, which decode to what was encoded."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: trained embeddings and byte-pair merges have no SQL form; tests compare the stages with plain Python
ORACLE_SQL = None
