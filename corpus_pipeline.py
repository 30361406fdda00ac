"""The corpus pipeline: quality, shared lines, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's docs. What a stage staged for itself, and the table before it, are deleted then.

Defined results, beside those of the operators: all stages but the last return the columns of documents and their types, and pass further columns through, whatever their names; null and empty texts are scored as empty ones,
lose no lines, are never near-duplicates (repeated rows of them are dropped as copies) and pack as one piece; rows without an id are judged by their texts and stay alone; repeated rows become one in the near-dedup stage; lines
that go may leave a text empty, which stays; an empty table gives an empty result of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserql.llm import line_dedup, mixing, near_dedup, packing, quality
from tesserql.llm.common import scratch, stage, table, unstage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; n_chars follows the text where that changed."""
    out = line_dedup.apply_keep(docs, line_dedup.keep_bitmaps(docs), "_tq_lines", "_tq_dropped")
    changed = F.col("_tq_dropped") > 0
    chars = lambda c: F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return out.select(*[chars(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays."""
    return near_dedup.keep_first(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard in the order of their places."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]

#: The classifier is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
