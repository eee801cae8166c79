"""A training-data pipeline: quality, near duplicates, benchmark, mixing, token files."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from windlass.llm.decontam import remove_contaminated
from windlass.llm.mixing import take_mix
from windlass.llm.quality import keep_quality
from windlass.llm.scratch import Scratch, collected
from windlass.llm.simhash import keep_one
from windlass.llm.tokenfiles import token_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What the last stage of each thread's pipeline over a folder left in the shared folder.
_left: dict[tuple[int, str], list[Scratch]] = {}


def _stage(f: Callable) -> Callable:
    """Before a stage runs, drop the tables that the stage before it left: its result is written by then."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (threading.get_ident(), sf_dir)
        before = _left.pop(key, [])
        if f.__name__ != "quality":  # which begins another pipeline, while the last one's result may still be read
            for scratch in before:
                scratch.drop()
        with collected() as made:
            out = f(spark, docs, sf_dir)
        if f.__name__ != "tokens":
            _left[key] = made
        return out

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps.

    Null and empty texts go; rows of equal doc_id and text stay or go together; null labels
    are ignored, and without good labels all texts stay. Empty tables give an empty result.
    """
    return keep_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, whatever their doc_id: that of the least doc_id, null last.

    Null and empty texts are one component; of rows with equal doc_id and text one stays;
    rows that share a doc_id are told apart by their texts. Empty tables give an empty result.
    """
    return keep_one(docs.select(*COLUMNS))


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs.

    Null and empty texts, and items without words, hold none; repeated rows go or stay
    together. An empty benchmark leaves all documents; empty tables give an empty result.
    """
    return remove_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source, the last in order; null and empty texts have size 0 and are
    taken as their doc_id's hash says; rows of equal doc_id are taken alike. Empty tables
    give an empty result.
    """
    return take_mix(docs.select(*COLUMNS))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in flat files; one row for each document from the files.

    Null and empty texts are the end id alone; a null doc_id comes first; repeated rows are
    written each. Empty tables give an empty result.
    """
    import public_tokenizers

    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources", mix), ("token ids", tokens)]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.cut(docs, f"stage{k}")
            if k:
                tables.drop(f"stage{k - 1}")
    return docs
