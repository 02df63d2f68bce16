"""Relational rows as atoms: what a row's key, columns and references say, each as an Evaluation of a Predicate on a Concept."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.handles import EXPRESSION, SYMBOL, escaped, link_column, md5, node_column, node_handle, sanitized
from .expressions import as_links

#: How a fact's predicate is made: the table alone, with a column and its value, or of a reference.
KEY, PLAIN, REFERS = "key", "plain", "refers"


@dataclass(frozen=True)
class TableSpec:
    """key: primary key column; references: column to referenced table; skip: columns left out; where: conditions in SQL, all of
    which a row must meet."""

    name: str
    key: str
    references: dict[str, str] = field(default_factory=dict)
    skip: tuple[str, ...] = ()
    where: tuple[str, ...] = ()


def _facts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """kind, head, mid, v, st, sv: that a predicate, of kind, head, mid and value v, holds of the row sv of table st.

    For the key, each plain or reference column and each ordered pair of distinct references.
    """
    kinds, refers = dict(df.dtypes), {c: t for c, t in spec.references.items() if c not in spec.skip}
    columns = [c for c in df.columns if c != spec.key and c not in spec.skip and not kinds[c].startswith(("timestamp", "date"))]
    values = df.select(*[sanitized(F.col(c).cast("string")).alias(c) for c in dict.fromkeys([spec.key, *columns, *refers])])

    def says(kind: str, head: str, mid: str | None, v: Column, st: str, sv: str, also: Column | None = None) -> Column:
        texts = {"kind": F.lit(kind), "head": F.lit(head), "mid": F.lit(mid).cast("string"), "v": v.cast("string"), "st": F.lit(st), "sv": F.col(sv)}
        holds = F.col(sv).isNotNull() & (F.lit(True) if kind == KEY else v.isNotNull()) & (F.lit(True) if also is None else also)
        return F.when(holds, F.struct(*[t.alias(n) for n, t in texts.items()]))

    held = [says(KEY, spec.name, None, F.lit(None), spec.name, spec.key)]
    for c in columns:
        held.append(says(REFERS, f"{spec.name}.{c}", refers[c], F.col(c), spec.name, spec.key) if c in refers else says(PLAIN, spec.name, f"{spec.name}.{c}", F.col(c), spec.name, spec.key))
    for a, b in permutations(refers, 2):
        differ = None if refers[a] != refers[b] else F.col(a) != F.col(b)
        held.append(says(REFERS, f"{spec.name}.{a}", refers[a], F.col(a), refers[b], b, differ))
    return values.select(F.explode(F.array_compact(F.array(*held))).alias("f")).select("f.*")


def _atoms(facts: DataFrame) -> DataFrame:
    """A row per atom of each fact, level by level, so that what a level makes is computed once and its code stays small."""
    quoted = lambda c: F.concat(F.lit('"'), escaped(F.col(c)), F.lit('"'))
    of = lambda *kinds: F.col("kind").isin(*kinds)
    shown = lambda *parts: F.concat(F.lit("("), F.concat_ws(" ", *parts), F.lit(")"))
    fixed = {name: F.lit(node_handle(name)) for name in ("Evaluation", "Predicate", "Concept")}
    df = facts.withColumns({"v": quoted("v"), "sv": quoted("sv")})
    df = df.withColumns({f"h_{c}": node_column(F.col(c)) for c in ("head", "mid", "v", "st", "sv")})
    # (st sv) and what a reference refers to, each of the form (table value); then the concepts of both.
    df = df.withColumns({"h_row": link_column(F.array("h_st", "h_sv")), "e_row": shown("st", "sv"), "h_ref": F.when(of(REFERS), link_column(F.array("h_mid", "h_v"))), "e_ref": F.when(of(REFERS), shown("mid", "v"))})
    concept = lambda c: {f"h_{c}_of": link_column(F.array(fixed["Concept"], f"h_{c}")), f"e_{c}_of": shown(F.lit("Concept"), f"e_{c}")}
    df = df.withColumns(concept("row") | {n: F.when(of(REFERS), x) for n, x in concept("ref").items()})
    made = F.when(of(PLAIN), F.array("h_head", "h_mid", "h_v")).when(of(REFERS), F.array("h_head", "h_ref_of"))
    df = df.withColumns({"made": made, "e_made": F.when(of(PLAIN), shown("head", "mid", "v")).when(of(REFERS), shown("head", "e_ref_of")).otherwise(F.col("head"))})
    df = df.withColumn("h_made", F.when(of(KEY), F.col("h_head")).otherwise(link_column(F.col("made"))))
    df = df.withColumns({"h_predicate": link_column(F.array(fixed["Predicate"], "h_made")), "e_predicate": shown(F.lit("Predicate"), "e_made")})
    df = df.withColumns({"h_fact": link_column(F.array(fixed["Evaluation"], "h_predicate", "h_row_of")), "e_fact": shown(F.lit("Evaluation"), "e_predicate", "e_row_of")})

    def row(handle: Column, kind: str, name: Column, targets: Column, top: bool, expr: Column) -> Column:
        return F.struct(handle.alias("handle"), F.lit(kind).alias("type"), name.cast("string").alias("name"), targets.cast("array<string>").alias("targets"), F.lit(top).alias("is_toplevel"), expr.alias("expr"))

    node = lambda handle, name: row(handle, SYMBOL, name, F.lit(None), False, name)
    link = lambda c, *targets, top=False: row(F.col(f"h_{c}"), EXPRESSION, F.lit(None), F.array(*targets), top, F.col(f"e_{c}"))
    every = [node(h, F.lit(n)) for n, h in fixed.items()] + [node(F.col(f"h_{c}"), F.col(c)) for c in ("head", "st", "sv")]
    every += [link("row", "h_st", "h_sv"), link("row_of", fixed["Concept"], "h_row"), link("predicate", fixed["Predicate"], "h_made"), link("fact", fixed["Evaluation"], "h_predicate", "h_row_of", top=True)]
    valued = [node(F.col(f"h_{c}"), F.col(c)) for c in ("mid", "v")] + [row(F.col("h_made"), EXPRESSION, F.lit(None), F.col("made"), False, F.col("e_made"))]
    refers = [link("ref", "h_mid", "h_v"), link("ref_of", fixed["Concept"], "h_ref")]
    atoms = F.array(*every, *[F.when(~of(KEY), a) for a in valued], *[F.when(of(REFERS), a) for a in refers])
    return df.select(F.explode(F.array_compact(atoms)).alias("a")).select("a.*")


def selected(df: DataFrame, spec: TableSpec) -> DataFrame:
    for condition in spec.where:
        df = df.where(condition)
    return df


def map_table(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """nodes and links of a table's rows, each atom once. Null, empty, too long and temporal values say nothing."""
    return once(_atoms(_facts(selected(df, spec), spec)))


def once(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    once = atoms.groupBy("handle").agg(F.first("type").alias("type"), F.first("name", True).alias("name"), F.first("targets", True).alias("targets"), F.max("is_toplevel").alias("is_toplevel"), F.first("expr").alias("expr"))
    return once.where(F.col("name").isNotNull()).select("handle", "type", "name", "is_toplevel"), as_links(once.where(F.col("targets").isNotNull()))


def map_query(spark: SparkSession, sql: str, specs: dict[str, TableSpec]) -> tuple[DataFrame, DataFrame]:
    """A query whose columns are named table__column; each table's columns are mapped by their own names."""
    df = spark.sql(sql)
    parts = []
    for name, spec in specs.items():
        prefix = name.replace(".", "_") + "__"
        own = [c for c in df.columns if c.startswith(prefix)]
        if prefix + spec.key not in own:
            raise ValueError(f"the key of {name} must be selected as {prefix}{spec.key}")
        parts.append(map_table(df.select(*[F.col(c).alias(c.removeprefix(prefix)) for c in own]), spec))
    return _joined(parts)


def _joined(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    nodes, links = (reduce(DataFrame.unionByName, tables) for tables in zip(*parts, strict=True))
    return nodes.dropDuplicates(["handle"]), links.dropDuplicates(["handle"])


def map_tables(tables: dict[str, DataFrame], specs: list[TableSpec], referenced: list[TableSpec] | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and links of the tables of specs, and of those of referenced the rows that a selected row of specs refers to."""
    parts = [map_table(tables[s.name], s) for s in specs]
    for r in referenced or []:
        keys = [selected(tables[s.name], s).select(F.col(c).alias(r.key)) for s in specs for c, t in s.references.items() if t == r.name and c not in s.skip]
        if keys:
            parts.append(map_table(tables[r.name].join(reduce(DataFrame.unionByName, keys).distinct(), r.key, "left_semi"), r))
    return _joined(parts)


def synced(spark: SparkSession, folder: str, tables: dict[str, DataFrame], specs: list[TableSpec]) -> tuple[DataFrame, DataFrame]:
    """nodes and links of all tables, written to folder once for each set of specs and only read after that."""
    path = f"{folder}/{md5(repr(specs))}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/links/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        for name, both in zip(("nodes", "links"), map_tables(tables, specs), strict=True):
            both.write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/links")


def referenced_rows(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """The rows of another table that df's column refers to."""
    return other.join(df.select(F.col(column).alias(key)).distinct(), key, "left_semi")


def relation(df: DataFrame, name: str, *columns: Column) -> DataFrame:
    """One link (name c1 c2 ...) per row of df, its symbols named by the columns: the plain form of a fact table.

    The relation's own symbol is a constant, so a template over another relation prunes all of this one.
    """
    names = [c.cast("string") for c in columns]
    head = node_column(F.lit(name))
    targets = F.array(head, *[node_column(n) for n in names])
    expr = F.concat(F.lit(f"({name} "), F.concat_ws(" ", *names), F.lit(")"))
    t = [head, *[node_column(n) for n in names]]
    return df.select(
        link_column(targets).alias("handle"), F.lit(EXPRESSION).alias("type"), F.lit(len(t)).alias("arity"), *[(t[i] if i < len(t) else F.lit(None).cast("string")).alias(f"t{i}") for i in range(4)],
        targets.alias("targets"), F.lit(True).alias("is_toplevel"), expr.alias("expr"),
    )
