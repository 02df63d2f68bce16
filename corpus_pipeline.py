"""A training corpus from documents: toxicity, near duplicates, personal data, mixing and packing, one after the other.

Each stage reads what the one before wrote to the shared folder; all but the last return the columns of documents. A
null, empty or repeated row and an empty table are handled as each stage's operator says. Extra columns are carried along to
the last stage, whatever their names. What a stage wrote is deleted when the next has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import mixing, neardup, packing, pii, toxicity
from weftgraph.llm.common import discard, fresh, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, doesn't call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs.columns, "score", "predicted")
    return toxicity.score(docs, model, names=tuple(names)).where(F.col(names[1]) == 0).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.without_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by tags and n_chars counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each epoch that takes them."""
    domain, tokens = fresh(docs.columns, "domain", "tokens")
    facts = docs.withColumns({domain: mixing.domain_of(F.col("source")), tokens: mixing.n_words(F.col("text"))})
    return mixing.mix(facts, levels=(domain, "lang", "source"), tokens=tokens).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of all documents, a row per piece."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training a classifier, components of a graph and a tokenizer's ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
