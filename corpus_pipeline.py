"""The corpus pipeline: documents in, packed training sequences out.

Stages, each over all that its predecessor kept: language identification
(rejected documents go), line dedup, near-duplicate removal (the smallest
doc_id of each group stays), benchmark decontamination, best-fit packing.
Each stage's result is a Parquet table in the shared folder, read again as the
next one's documents, so a lost executor never costs more than a stage.

Near-duplicate removal takes five words and a similarity of 0.8; decontamination
drops what the contamination rule marks (an item's words cover a twentieth of
the document's words or more).  Line dedup rewrites ``n_chars`` along with
``text``, where the table has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.decontamination import decontaminate
from skerry.llm.langid import keep_identified
from skerry.llm.linededup import dedup_lines
from skerry.llm.neardup import drop_near_duplicates
from skerry.llm.packing import pack
from skerry.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.select(*(F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express language identification and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
