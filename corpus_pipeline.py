"""The corpus pipeline: stages that each call one document operator.

Toxic documents go, then exact copies, then near copies (five words, 0.8);
personal data is replaced; what is left is packed into sequences.

All stages but the last return the columns of their input, in order, whatever
other names those have; an empty table stays empty; a null id is a row like
others, unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import exact_dedup, ngram_join, packing, pii, toxicity
from cloakwork.llm.queries import PII_KEY, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under 0.5 stay.  Null and empty texts have the model's bias as score; repeated rows go or stay together; where nothing can be learned all stay."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_unlearned=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one text that with the largest id stays, one row of it if it repeats.  Null counts as empty text, and a null id is below all others."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked rows those with the smallest id stay.  Null, empty and blank texts link with nothing and stay, as do rows without an id."""
    return ngram_join.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated values are replaced in ``text``, and ``n_chars``, where there is one, follows.  No row goes; null texts stay null."""
    hidden = pii.pseudonymise(docs, PII_KEY, count_col=None, kinds_col=None)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence.  Null and empty texts are the end id alone; repeated rows are packed row by row."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: A trained classifier, keyed permutations and bin packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of ``documents``; checkpoints in between cut the lineage."""
    from cloakwork.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
