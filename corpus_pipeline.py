"""A training corpus from raw documents, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before it kept; all but the last return the columns of ``documents``.
``run`` writes each stage's result under the shared checkpoint folder and
reads it again as the next one's input; shuffles and driver objects of a
finished stage are let go first.

1. quality: documents that the co-trained classifier rejects go.
2. line_dedup: of every group of equal or near-equal lines one stays;
   documents of which no line is left go (all they held stands elsewhere).
3. simhash: one document of each near-duplicate group stays.
4. decontamination: documents that hold a benchmark item go.
5. packing: the rest is packed into bins of 2,048 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm import decontam, line_dedup, packing, quality
from bazaar.llm import simhash as simhash_op
from bazaar.llm.common import cut, free_shuffles, table
from bazaar.session import ensure_checkpoint_dir

CAPACITY = 2048


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines kept once; ``n_chars`` follows the text; documents emptied by this stage go."""
    ensure_checkpoint_dir(spark)
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_kept") < F.col("n_lines")) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[F.when(F.col("n_kept") < F.col("n_lines"), length).otherwise(F.col(c)).alias(c) if c == "n_chars" else c
                        for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return simhash_op.keep_one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, tokens, bin, position) of every document kept."""
    ensure_checkpoint_dir(spark)
    return packing.pack(docs, CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage), ("line_dedup", line_dedup_stage), ("simhash", simhash_stage),
    ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: No SQL twin: the classifier is fitted and the packing sequential; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        free_shuffles(spark)
    return docs
