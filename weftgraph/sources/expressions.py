"""S-expressions: a plan-time reader, and bulk loading of files of expressions into nodes and links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.handles import EXPRESSION, SYMBOL, link_handle, node_handle
from ..runtime import ship

_TOKEN = re.compile(r'\s+|;[^\n]*|(?P<open>\()|(?P<close>\))|(?P<text>"(?:\\.|[^"\\])*")|(?P<word>[^\s()";]+)')
Tree = str | list

NODES = "handle string, type string, name string, is_toplevel boolean"
LINKS = "handle string, type string, arity int, t0 string, t1 string, t2 string, t3 string, targets array<string>, is_toplevel boolean, expr string"


def read(text: str) -> list[Tree]:
    """All expressions of a text: symbols and literals as strings (text literals with their quotes), expressions as lists."""
    stack: list[list] = [[]]
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at : at + 20]!r}")
        at = m.end()
        if m["open"]:
            stack.append([])
        elif m["close"]:
            if len(stack) < 2:
                raise ValueError("a parenthesis closes that wasn't opened")
            done = stack.pop()
            if not done:
                raise ValueError("an expression is empty")
            stack[-1].append(done)
        elif m["text"] or m["word"]:
            stack[-1].append(number(m["word"]) if m["word"] else m["text"])
    if len(stack) != 1:
        raise ValueError("a parenthesis isn't closed")
    return stack[0]


def number(word: str) -> str:
    """Numbers in their one spelling: integers plain, others with six decimals; anything else unchanged."""
    if re.fullmatch(r"[+-]?[0-9]+", word):
        return str(int(word))
    if re.fullmatch(r"[+-]?[0-9]+\.[0-9]*", word):
        return f"{float(word):.6f}"
    return word


def show(tree: Tree) -> str:
    return tree if isinstance(tree, str) else "(" + " ".join(map(show, tree)) + ")"


def handle_of(tree: Tree) -> str:
    return node_handle(tree) if isinstance(tree, str) else link_handle([handle_of(t) for t in tree])


def atoms_of(tree: Tree, top: bool = True) -> Iterator[tuple]:
    """(handle, type, name, targets, is_toplevel, expr) of an expression and all within it."""
    if isinstance(tree, str):
        yield node_handle(tree), SYMBOL, tree, None, top, tree
        return
    if top and tree[0] in ("and", "or"):
        raise ValueError(f"{tree[0]} can't head a stored expression")
    for t in tree:
        yield from atoms_of(t, False)
    targets = [handle_of(t) for t in tree]
    yield link_handle(targets), EXPRESSION, None, targets, top, show(tree)


def atom_rows(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """A row per atom of each expression in the rows of lines, with order's value as seq (0 without)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*a, n) for line, n in zip(batch["value"], batch["seq"], strict=True) if line for tree in read(line) for a in atoms_of(tree)]
            yield pd.DataFrame(rows, columns=["handle", "type", "name", "targets", "is_toplevel", "expr", "seq"])

    ship(lines.sparkSession)
    held = lines.select(F.col(value).alias("value"), (F.col(order) if order else F.lit(0)).cast("long").alias("seq"))
    return held.mapInPandas(run, "handle string, type string, name string, targets array<string>, is_toplevel boolean, expr string, seq long")


def load_expressions(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """nodes and links of the expressions in the rows of lines, each atom once; toplevel if any occurrence is."""
    once = atom_rows(lines, value).groupBy("handle").agg(F.first("type").alias("type"), F.first("name", True).alias("name"), F.first("targets", True).alias("targets"), F.max("is_toplevel").alias("is_toplevel"), F.first("expr").alias("expr"))
    nodes = once.where(F.col("name").isNotNull()).select("handle", "type", "name", "is_toplevel")
    return nodes, as_links(once.where(F.col("targets").isNotNull()))


def as_links(rows: DataFrame) -> DataFrame:
    """rows: handle, type, targets, is_toplevel, expr. With arity and the first targets as columns, for pushed-down filters."""
    return rows.select("handle", "type", F.size("targets").alias("arity"), *[F.get("targets", F.lit(i)).alias(f"t{i}") for i in range(4)], "targets", "is_toplevel", "expr")


def load_file(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files of one expression per line, or, with multiline, of expressions over any lines; such a file is read as a whole."""
    return load_expressions(spark.read.text(path, wholetext=multiline))


def statements(text: str) -> list[str]:
    """The statements of an SQL file: parted by blank lines or lines of comment."""
    parts = re.split(r"(?m)^[ \t]*(?:--.*)?$", text)
    return [p.strip() for p in parts if p.strip()]


def write_expressions(links: DataFrame, path: str, records_per_file: int = 1_000_000) -> None:
    """The toplevel expressions, each once, as text in files of bounded length."""
    links.where("is_toplevel").select("expr").distinct().write.option("maxRecordsPerFile", records_per_file).text(path)
