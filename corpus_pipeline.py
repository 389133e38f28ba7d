"""Documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and returns a
table. All but the last return the columns of ``documents``: the first with failing lines taken out
of the texts, the next two with one document of each group, the fourth with the sample. The last
returns a row for each piece of a document with its place in a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import exact_dedup, minhash, mixing, packing, quality_rules
from wayloom.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning; documents that the rules reject go."""
    cleaned = quality_rules.clean(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays."""
    return minhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target weights."""
    found = mixing.sample(docs, mixing.document_labels(), keep=docs.columns)
    return found.where("selected").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of permitted lengths."""
    return packing.pack(docs, packing.n_words("text"))


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("minhash", near),
    ("mixing", mix),
    ("packing", pack),
]
#: Near-duplicate classes are connected components, which one SQL query cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
