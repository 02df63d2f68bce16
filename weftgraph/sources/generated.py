"""A generated workload: sentences of random words, as (Contains (Sentence s) (Word w)) links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.handles import EXPRESSION, SYMBOL, escaped, link_column, node_column
from .relational import once


@dataclass(frozen=True)
class Term:
    """An atom as columns, with everything it is made of."""

    handle: Column
    expr: Column
    atoms: tuple[Column, ...]


def _row(handle: Column, kind: str, name: Column, targets: Column, top: bool, expr: Column) -> Column:
    return F.struct(
        handle.alias("handle"), F.lit(kind).alias("type"), name.cast("string").alias("name"), targets.cast("array<string>").alias("targets"), F.lit(top).alias("is_toplevel"), expr.alias("expr")
    )


def node(name: Column | str) -> Term:
    name = F.lit(name) if isinstance(name, str) else name
    h = node_column(name)
    return Term(h, name, (_row(h, SYMBOL, name, F.lit(None), False, name),))


def link(*terms: Term, top: bool = False) -> Term:
    targets = F.array(*[t.handle for t in terms])
    expr = F.concat(F.lit("("), F.concat_ws(" ", *[t.expr for t in terms]), F.lit(")"))
    h = link_column(targets)
    return Term(h, expr, (*[a for t in terms for a in t.atoms], _row(h, EXPRESSION, F.lit(None), targets, top, expr)))


def literal(value: Column) -> Term:
    return node(F.concat(F.lit('"'), escaped(value), F.lit('"')))


def _word(seed: int, letters: int, length: int, place: Column) -> Column:
    """Letters by a hash of the sentence, the word's place and the letter's: the same in any partitioning."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"[:letters]
    letter = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64(F.lit(seed), "id", place, F.lit(i)), F.lit(letters)).cast("int") + 1, F.lit(1))
    return F.concat(*[letter(i) for i in range(length)])


def sentences(spark: SparkSession, n: int, letters: int = 26, word_length: int = 3, words: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """nodes and links of n sentences. Fewer letters give more shared words, so tighter links."""
    rows = spark.range(n).select(F.array(*[_word(seed, letters, word_length, F.lit(i)) for i in range(words)]).alias("words"))
    each = rows.select(F.array_join("words", " ").alias("s"), F.explode(F.array_distinct("words")).alias("w"))
    fact = link(node("Contains"), link(node("Sentence"), literal(F.col("s"))), link(node("Word"), literal(F.col("w"))), top=True)
    return once(each.select(F.explode(F.array(*fact.atoms)).alias("a")).select("a.*"))
