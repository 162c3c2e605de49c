"""A cleaning pipeline over ``documents``, in stages of the operators of medlattice.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's result as Parquet to the shared checkpoint folder and reads it back for the
next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlattice.llm import decontaminate, packing, quality, secrets, simhash
from medlattice.llm.common import free_name, materialize, table
from medlattice.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.5 stay, one at 0.5 too. A null text is scored
    as an empty one, a very long text whole; repeated rows stay or go together; an empty
    table stays empty."""
    model = quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    score = free_name(docs, "_stage_score")
    return quality.score(docs, model, score).where(F.col(score) >= 0.5).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id
    (null ids last, then by a hash of the text). Null, empty and blank texts are copies of
    each other, of repeated rows one stays, very long texts count whole, an empty table
    stays empty."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more stands in benchmark windows go; exactly
    a twentieth is enough. A null text has no words and stays; rows of the same id and text
    go together, with a null id too; very long texts count whole; an empty table stays empty."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated rows and null ids included; secrets in its text are
    masked and n_chars follows. A null text stays null; very long texts are searched whole;
    an empty table stays empty."""
    return secrets.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training window. A null or empty
    text is one piece of its end id alone; repeated rows are packed each; a null id stays
    null; very long texts fill whole windows; an empty table gives an empty one."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("packing", pack_windows),
]

#: XXH64 fingerprints, tokenizer ids and a learned classifier have no SQL form;
#: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
