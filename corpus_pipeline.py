"""Five stages from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's ``docs``, whose scratch
tables are then deleted.

In every stage nulls may stand in any column: a null text is an empty one, a row
without an id is kept unless the classifier rejects its text, null sources are a
source.  Repeated rows are one after the second stage; rows of one id but
different texts are told apart.  Long texts are handled whole.  An empty table
gives an empty result.  Columns beyond those of documents, whatever their names,
are passed on (``mix_repeats`` alone is replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, mixing, near_copies, pii_disclosure, quality_crf
from plumbline.llm.queries import fold, table
from plumbline.scratch import discard, materialise, scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score is below the classifier's threshold."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies.
    Copies are texts whose 5-word shingles have a Jaccard similarity of
    ``near_copies.SIMILARITY`` or more.  SimHash with anchor-point covering finds
    them, at distances far above op9's two bits, and it alone: an exact check of
    the whole sets verifies its links and adds none."""
    return near_copies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak a benchmark item."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; ``n_chars`` follows the text."""
    cleaned = pii_disclosure.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the mix takes, with the repetitions in ``mix_repeats``."""
    return mixing.mix_rows(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixture),
]

#: The field, the fingerprints and the template windows have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scope(spark) as keep:
            out = keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        if docs is not given:
            discard(docs)
        docs = out
    return docs
