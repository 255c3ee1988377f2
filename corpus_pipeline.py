"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns
of documents, but for the last, which returns packed pieces. Between stages run() writes Parquet to the
shared folder. Null document numbers and repeated rows pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontam, linededup, neardup, packing, quality, shared

#: Packed pieces depend on token ids, which SQL cannot compute; tests compare with a brute-force version.
ORACLE_SQL = None

#: Bytes of text that pack encodes at once: executors still hold the idle workers of the stages before.
PACK_CHUNK = 1 << 19


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    shared.ready(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("t"))
    return quality.assess(rows, "t", "row").where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    shared.ready(spark)
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # names that do not clash with the operator's
    kept = linededup.dedup_lines(docs.toDF(*plain.values()), plain["text"], plain["doc_id"])
    made = {"text": F.col("kept_text")}
    if "n_chars" in plain:
        made["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*(made.get(c, F.col(plain[c])).alias(c) for c in docs.columns))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row number that stays the same, and the number's column."""
    row = shared.unused_name(docs, "row_")
    return shared.numbered(docs, row, "pipeline-numbered"), row


def without(rows: DataFrame, row: str, gone: DataFrame, label: str) -> DataFrame:
    """rows whose number is not in gone, without the number. Only the numbers that go are joined with the texts."""
    out = shared.unused_name(rows, "gone_")
    gone = shared.materialize(gone.select(F.col(row).alias(out)), label)
    return rows.join(shared.broadcast_if_small(gone), F.col(row) == F.col(out), "left_anti").drop(row)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, five-word shingles at Jaccard 0.8, the row of least (doc_id, row) stays."""
    shared.ready(spark)
    rows, row = numbered(docs)
    return without(rows, row, neardup.copies(rows, "text", row, "doc_id"), "pipeline-gone")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold benchmark passages go; rows that share their number, or have none as they do, stay."""
    rows, row = numbered(docs)
    found = decontam.decontaminate(rows, shared.table(spark, sf_dir, "benchmark"), key=row)
    return without(rows, row, found.where("contaminated"), "pipeline-contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    shared.ready(spark)
    return packing.pack(docs, chunk=PACK_CHUNK).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written besides its result goes when the stage is done."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with shared.scratch(spark) as keep:
            docs = keep(shared.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
