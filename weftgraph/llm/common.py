"""What the corpus operators share: table access, shared storage and expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, shared_dir, ship, stored

__all__ = ["discard", "fresh", "join_hot", "let", "shared_dir", "ship", "ship_texts", "stored", "table", "words"]

#: A key is hot if it holds more than this share of all rows, so hot keys are never more than its inverse.
HOT_SHARE = 0.001
#: Rows with texts that go to Python at a time.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_texts(spark: SparkSession) -> None:
    """ship() for operators whose Python reads texts: from here on, the session sends it at most BATCH_ROWS rows at a time.

    Spark's usual 10,000 rows hold tens of MB of texts, of which the executor, beside its heap, and each of its Python
    workers keep several copies. A smaller limit of the session stays.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it within lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The array of a text's words, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def fresh(taken: list[str], *names: str) -> list[str]:
    """names, each with underscores before it until no column of taken is called so, in any case of letters."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name = "_" + name
        lower.add(name.lower())
        out.append(name)
    return out


def join_hot(rows: DataFrame, facts: DataFrame, on: list[str], times: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts, which hold a row per key and in times how many rows have it, of total (times is dropped).

    Facts of hot keys, at most 1 / HOT_SHARE, are broadcast, so that rows of such a key stay where they are; the others
    are joined by shuffle. how: inner or left.
    """
    hot = facts.where(F.col(times) > total * HOT_SHARE).drop(times)
    if not facts.where(F.col(times) > total * HOT_SHARE).limit(1).count():
        return rows.join(facts.drop(times), on, how)
    cold = facts.where(F.col(times) <= total * HOT_SHARE).drop(times)
    names = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(names, on, "left_anti").join(cold, on, how))
