"""The corpus pipeline: rules, classifier, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``documents``.  A stage first removes the
scratch tables of earlier stages, whose results have been written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageflow.llm import _shared, decontaminate, near_dup, packing, quality_model, quality_rules, tokens


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _shared.owned(spark, "pipeline"):
        return quality_rules.filter_rules(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on all of ``documents``, whose rejected rows teach most."""
    with _shared.owned(spark, "pipeline"):
        machine = quality_model.train(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "labels"))
        return quality_model.filter_quality(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _shared.owned(spark, "pipeline"):
        return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _shared.owned(spark, "pipeline"):
        return decontaminate.drop_leaks(docs, _shared.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _shared.owned(spark, "pipeline"):
        return packing.digest(packing.pack(docs, tokens.default_path()))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", pack)]
#: SQL expresses neither the classifier nor the latent search: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written and reread."""
    docs = _shared.table(spark, sf_dir, "documents")
    folder = _shared.unswept(spark, "pipeline")
    last = None
    for name, stage in STAGES[:-1]:
        docs = _shared.saved(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if last:  # what the stage has read is done with
            _shared.drop(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
