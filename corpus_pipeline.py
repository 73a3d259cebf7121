"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

A stage is (spark, docs, sf_dir) -> DataFrame.  All but the last return the columns of documents, further ones of the
input too, whatever their names.  Every stage gives an empty table for an empty one, judges repeated rows alike and takes
a null text as empty: language_id and quality reject it, packing makes one piece of its end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcloud.llm import disclosure, language, nearcopies, packing, quality
from barcloud.llm.common import has_letter, table
from barcloud.session import write_table

#: A text that no language's model codes in fewer bits a byte is none of them.
MOST_BITS = 7.5


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` under names that no operator adds, and its text column; ``_restored`` gives the names back."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def _restored(plain: DataFrame, docs: DataFrame) -> DataFrame:
    return plain.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no learned language explains.

    Models come from the labelled rows of the input itself; where there are none, any text with a letter stays.
    """
    model = language.train(docs)
    if not model.languages:
        return docs.where(has_letter(F.col("text")))
    plain, text = _plain(docs)
    found = language.identify(plain, model, text)
    return _restored(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS)), docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts the scorer, trained on weak labels of the input, takes for bad; texts without a word too."""
    weights = quality.train(docs)
    plain, text = _plain(docs)
    return _restored(quality.score(plain, weights, text).where("keep"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return nearcopies.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it; n_chars follows the new text; all rows stay."""
    done = disclosure.sanitise(docs)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of the documents left; see ``packing.pack_documents``."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", pack),
]

#: SQL can express none of the models and fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
