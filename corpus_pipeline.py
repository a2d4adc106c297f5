"""Corpus pipeline: language, toxicity, near copies, mixing, packing.

Each stage is a function of (spark, docs, sf_dir). What a stage returns is written as
Parquet in the shared folder that ``spark.checkpoint.dir`` names and read again as the next
stage's input, so a lost executor costs one stage's work at most.

All stages take null and repeated ids, null, empty and very long texts, equal rows, empty
tables and further columns of whatever names; what becomes of each case is said stage by
stage. All but the last return the columns they got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.storage import shared_folder
from weftline.llm import langid, mixing, packing, simhash, toxicity
from weftline.llm.common import table, unused

#: How far above an even guess among the learned languages the pooled probability of the likeliest one must be.
ABOVE_CHANCE = 0.05
MAX_TOXICITY = 0.7
#: Words whose token ids a worker keeps; few, as the same workers hold what the other stages need.
KNOWN_WORDS = 250_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with no letter or no language that stands out.

    Null and empty texts have no letter and go; so does everything if no row has a language to
    learn from. Long texts count as a whole; equal rows meet the same fate.
    """
    tagger = langid.train_tagger(docs)
    name = unused(docs, "language")
    found = F.col(name)
    return langid.identify_languages(docs, tagger, out_col=name).filter((found["lang_pred"] != "und") & (found["score"] >= langid.least_score(tagger, ABOVE_CHANCE))).drop(name)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose calibrated toxicity reaches MAX_TOXICITY.

    Null and empty texts are scored like any other; without usable labels every row stays.
    """
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "toxicity")
    return toxicity.score_toxicity(docs, model, out_col=name).filter(F.col(name) < MAX_TOXICITY).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id.

    A null id comes after all others; null and empty texts are one group; of equal rows one
    stays.
    """
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents as often as their source's target asks for: never, once or twice, in the order of the schedule.

    Documents without words stay once; a null source is a source; equal rows share their
    copies, rounded up.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2,048 tokens.

    Null and empty texts are the separator alone; every row is packed, equal ones too.
    """
    return packing.pack_documents(docs, known_words=KNOWN_WORDS)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
