"""From patterns to DataFrames.

Every operator gives branches: DataFrames with `handles, paths, total, clauses..., strength` and a `v_<name>` column for each
of a known set of bound variables. A union keeps its inputs' branches apart, so a join always knows which variables both of
its sides bind: it stays an equi-join (or a cross product where the query itself asks for one), and a variable that
only some clauses of an OR bind is compatible with anything, as it must be.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import find_paths
from ..runtime import stored
from .patterns import And, AndNot, Chain, Constant, Or, Query, Template, Variable, parse, parse_tokens


@dataclass(frozen=True)
class QueryOptions:
    """How a query is answered.

    focus_strictness s: 0 keeps all matches of a template, 1 the best, else the best max(1, round(s * n)).
    greatest: an AND's importance is its clauses' greatest, not their average. merge_handles: joined answers keep both sides'
    handles and paths, else the left side's. path_greatest: a path is as important as its most important link. compat_path_average: a path of k > 1 links
    divides its importance by k + 1. max_hops: a search whose paths can still grow then raises.
    """

    unique_assignment: bool = False
    unique_value: bool = False
    positive_importance: bool = False
    disregard_importance: bool = False
    focus_strictness: float = 0.0
    max_answers: int = 0
    count_only: bool = False
    allow_incomplete_paths: bool = False
    all_prefixes: bool = False
    populate_expressions: bool = False
    greatest: bool = False
    merge_handles: bool = True
    path_greatest: bool = False
    compat_path_average: bool = True
    max_hops: int | None = None
    order_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.disregard_importance and (self.positive_importance or self.focus_strictness):
            raise ValueError("importance can't be disregarded and asked for")
        if not 0 <= self.focus_strictness <= 1:
            raise ValueError("focus_strictness is a share")


@dataclass
class Branch:
    df: DataFrame
    bound: frozenset[str]


@dataclass
class Compiler:
    """links: the store's links; importance: handle, importance of a context, or None for 0 everywhere."""

    spark: SparkSession
    links: DataFrame
    importance: DataFrame | None = None
    options: QueryOptions = field(default_factory=QueryOptions)

    def compile(self, query: Query | str | list[str]) -> DataFrame:
        """handles, paths, importance, strength and v_<name> for every variable; nulls are unbound."""
        if isinstance(query, str):
            query = parse(query) if query.lstrip().startswith("(") else parse_tokens(query)
        elif isinstance(query, list):
            query = parse_tokens(query)
        answers = union(self.branches(query))
        if self.options.order_by:
            return answers.orderBy(*self.options.order_by)
        return answers

    def branches(self, query: Query) -> list[Branch]:
        if isinstance(query, Template):
            return [self.template(query)]
        if isinstance(query, Chain):
            return [self.chain(query)]
        if isinstance(query, Or):
            return self.unique([b for c in query.clauses for b in self.branches(c)])
        if isinstance(query, And):
            return self.unique(self.joined(query.clauses))
        if isinstance(query, AndNot):
            return self.unique(self.excluded(self.joined(query.clauses[:-1]), self.branches(query.clauses[-1])))
        raise TypeError(f"{query!r} is no query")

    # Leaves

    def template(self, query: Template) -> Branch:
        df, names = self._matches(query)
        if self.options.disregard_importance or self.importance is None:
            df = df.withColumn("importance", F.lit(0.0))
        else:
            # Handles are longer than what they are made of, so sizes are estimated too low for a broadcast by estimate.
            df = df.join(self.importance.select("handle", "importance").hint("merge"), "handle", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
        if self.options.positive_importance:
            df = df.where(F.col("importance") > 0)
        s = self.options.focus_strictness
        if s:
            df = best_share(df, s)
        shape = [F.array("handle").alias("handles"), F.array().cast("array<array<string>>").alias("paths"), "importance", F.lit(0.0).alias("strength")]
        return Branch(df.select(*shape, *[f"v_{n}" for n in names]), frozenset(names))

    def _matches(self, query: Template, kind: str | None = None) -> tuple[DataFrame, list[str]]:
        """handle and v_<name> of the links that match, nested templates by joins on their handles."""
        at = lambda i: F.col(f"t{i}") if i < 4 else F.get("targets", F.lit(i))
        df = self.links.where((F.col("type") == query.kind) & (F.col("arity") == len(query.targets)))
        first: dict[str, Column] = {}
        nested: list[tuple[str, Template]] = []
        out = [F.col("handle")]
        for i, t in enumerate(query.targets):
            if isinstance(t, Constant):
                df = df.where(at(i) == t.handle)
            elif isinstance(t, Variable):
                if t.name in first:
                    df = df.where(at(i) == first[t.name])
                else:
                    first[t.name] = at(i)
                    out.append(at(i).alias(f"v_{t.name}"))
            else:
                nested.append((f"_n{i}", t))
                out.append(at(i).alias(f"_n{i}"))
        df, names = df.select(*out), list(first)
        for column, inner in nested:
            found, inner_names = self._matches(inner)
            shared = [n for n in inner_names if n in names]
            found = found.withColumnRenamed("handle", column).withColumnsRenamed({f"v_{n}": f"_same_{n}" for n in shared})
            df = df.join(found, column)
            for n in shared:
                df = df.where(F.col(f"v_{n}") == F.col(f"_same_{n}")).drop(f"_same_{n}")
            df = df.drop(column)
            names += [n for n in inner_names if n not in names]
        return df, names

    def chain(self, query: Chain) -> Branch:
        answers = union(self.branches(query.query))
        picked = F.get("handles", F.lit(query.selector)) if isinstance(query.selector, int) else F.col(f"v_{query.selector}")
        picks = answers.select(picked.alias("handle"), "importance").where(F.col("handle").isNotNull()).groupBy("handle").agg(F.max("importance").alias("importance"))
        ends = F.get("targets", F.lit(query.tail)).alias("src"), F.get("targets", F.lit(query.head)).alias("dst")
        edges = picks.hint("merge").join(self.links.where(F.col("arity") > max(query.tail, query.head)), "handle").select("handle", *ends, "importance")
        source, target = (t.handle if isinstance(t, Constant) else None for t in (query.source, query.target))
        o = self.options
        incomplete = o.allow_incomplete_paths or source is None or target is None
        found = find_paths(edges, source, target, incomplete=incomplete, all_prefixes=o.all_prefixes, max_hops=o.max_hops, compat_average=o.compat_path_average, greatest=o.path_greatest)
        shape = [F.array().cast("array<string>").alias("handles"), F.array("links").alias("paths"), "importance", F.lit(1.0).alias("strength")]
        end = query.source if source is None else query.target if target is None else None
        if end is None:
            return Branch(found.select(*shape), frozenset())
        far = F.col("first") if source is None else F.col("last")
        return Branch(found.select(*shape, far.alias(f"v_{end.name}")), frozenset([end.name]))

    # Operators

    def joined(self, clauses: tuple) -> list[Branch]:
        """Every combination of the clauses' branches; importance is averaged over the clauses, strength multiplied."""
        out = [Branch(b.df.withColumn("_sum", F.col("importance")), b.bound) for b in self.branches(clauses[0])]
        for clause in clauses[1:]:
            right = self.branches(clause)
            out = [self._join(a, b) for a in out for b in right]
        n = float(len(clauses))
        value = F.col("_sum") if self.options.greatest else F.col("_sum") / n
        return [Branch(b.df.withColumn("importance", value).drop("_sum"), b.bound) for b in out]

    def _join(self, a: Branch, b: Branch) -> Branch:
        shared = sorted(a.bound & b.bound)
        right = b.df.select(*[F.col(f"v_{n}").alias(f"_r_{n}") for n in sorted(b.bound)], F.col("handles").alias("_h"), F.col("paths").alias("_p"), F.col("importance").alias("_i"), F.col("strength").alias("_s"))
        on = [F.col(f"v_{n}") == F.col(f"_r_{n}") for n in shared]
        if self.options.unique_value:
            on += [F.col(f"v_{x}") != F.col(f"_r_{y}") for x in sorted(a.bound) for y in sorted(b.bound) if x != y]
        df = a.df.join(right, on) if shared else product(a.df, right, on)
        total = F.greatest("_sum", "_i") if self.options.greatest else F.col("_sum") + F.col("_i")
        return Branch(
            df.select(
                (F.array_union("handles", "_h") if self.options.merge_handles else F.col("handles")).alias("handles"),
                (F.array_union("paths", "_p") if self.options.merge_handles else F.col("paths")).alias("paths"),
                total.alias("_sum"),
                F.lit(0.0).alias("importance"),
                (F.col("strength") * F.col("_s")).alias("strength"),
                *[f"v_{n}" for n in sorted(a.bound)],
                *[F.col(f"_r_{n}").alias(f"v_{n}") for n in sorted(b.bound - a.bound)],
            ),
            a.bound | b.bound,
        )

    def excluded(self, rows: list[Branch], by: list[Branch]) -> list[Branch]:
        """Rows that no row of by is compatible with; without a shared variable any row of by excludes all."""
        out = []
        for a in rows:
            df = a.df
            for b in by:
                shared = sorted(a.bound & b.bound)
                right = b.df.select(*[F.col(f"v_{n}").alias(f"_r_{n}") for n in sorted(b.bound)])
                on = [F.col(f"v_{n}") == F.col(f"_r_{n}") for n in shared]
                if self.options.unique_value:
                    on += [F.col(f"v_{x}") != F.col(f"_r_{y}") for x in sorted(a.bound) for y in sorted(b.bound) if x != y]
                if on:
                    df = df.join(right, on, "left_anti")
                else:
                    some = right.limit(1).agg(F.count(F.lit(1)).alias("_any"))  # one row
                    df = df.join(F.broadcast(some)).where(F.col("_any") == 0).drop("_any")
            out.append(Branch(df, a.bound))
        return out

    def unique(self, branches: list[Branch]) -> list[Branch]:
        """With unique_assignment, of rows that bind the same variables to the same values only the most important."""
        if not self.options.unique_assignment:
            return branches
        by_bound: dict[frozenset[str], list[Branch]] = {}
        for b in branches:
            by_bound.setdefault(b.bound, []).append(b)
        return [Branch(distinct_assignments(union(group)), bound) for bound, group in by_bound.items()]


#: Cells of a histogram, so rows that the driver sees of one; rows that one task may sort.
CELLS, SORTED = 4096, 100_000


def best_share(df: DataFrame, share: float, sorted_rows: int = SORTED) -> DataFrame:
    """The best max(1, round(share * n)) of df's n rows (1: the best), by importance and then handle.

    df is stored, so that the cut holds for the rows it was found in. Up to sorted_rows are the first of an order; more are
    found by a filter, without sorting: the importance at the cut comes from histograms over
    ever smaller ranges, and among rows of just that importance the handle from counts of ever longer prefixes (handles are
    hexadecimal); the driver sees CELLS counts at a time.
    """
    df = stored(df, "matches")
    value, handle = F.col("importance"), F.col("handle")
    n, low, high = df.agg(F.count(F.lit(1)), F.min(value), F.max(value)).first()
    left = 1 if share == 1 else max(1, int(share * n + 0.5))
    if left >= n:
        return df
    if left <= sorted_rows:
        return df.orderBy(value.desc(), handle).limit(left)
    while low < high:
        cell = F.least(F.lit(CELLS - 1), F.floor((F.lit(high) - value) / F.lit(high - low) * CELLS))
        for r in df.where(value.between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).orderBy("cell").collect():
            if r["n"] >= left:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    prefix, held = "", CELLS + 1
    while held > CELLS:
        longer = F.substring(handle, 1, len(prefix) + 3)
        for r in df.where((value == low) & handle.startswith(prefix)).groupBy(longer.alias("prefix")).count().orderBy("prefix").collect():
            if r["count"] >= left:
                prefix, held = r["prefix"], r["count"]
                break
            left -= r["count"]
    last = df.where((value == low) & handle.startswith(prefix)).select(handle).orderBy(handle).limit(left).collect()[-1]["handle"]
    return df.where((value > low) | ((value == low) & (handle <= last)))


#: Rows of a side in one block of a product, few enough for a dictionary of their values; products up to which no blocks are made.
BLOCK, SMALL_PRODUCT = 8192, 10_000_000


def product(left: DataFrame, right: DataFrame, on: list[Column]) -> DataFrame:
    """Every row of left with every row of right that on lets pass. A large product is made block by block, each block of both
    sides in one task, so that neither side has to fit a task and a task's rows repeat few values, which keeps what is written of them small."""
    plain = left.join(right, on) if on else left.crossJoin(right)
    n, m = left.count(), right.count()
    if n * m <= SMALL_PRODUCT:
        return plain
    left, right = stored(left, "left"), stored(right, "right")
    blocks = [-(-k // BLOCK) for k in (n, m)]
    block = lambda df, k: F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    tasks = blocks[0] * blocks[1] * 4
    lefts = left.withColumn("_left", block(left, blocks[0])).withColumn("_right_no", every(blocks[1])).repartition(tasks, "_left", "_right_no")
    rights = right.withColumn("_right", block(right, blocks[1])).withColumn("_left_no", every(blocks[0])).repartition(tasks, "_left_no", "_right")
    same = (F.col("_left") == F.col("_left_no")) & (F.col("_right_no") == F.col("_right"))
    for one in on:
        same = same & one
    return lefts.hint("merge").join(rights, same).drop("_left", "_left_no", "_right", "_right_no")


def distinct_assignments(answers: DataFrame) -> DataFrame:
    """The most important answer of each assignment; null bindings compare equal. Partial sums before the shuffle."""
    names = [c for c in answers.columns if c.startswith("v_")]
    rank = F.struct((-F.col("importance")).alias("i"), F.col("handles").alias("h"), F.col("paths").alias("p"), F.col("strength").alias("s"))
    best = answers.groupBy(*names).agg(F.min(rank).alias("_best"))
    return best.select(F.col("_best.h").alias("handles"), F.col("_best.p").alias("paths"), (-F.col("_best.i")).alias("importance"), F.col("_best.s").alias("strength"), *names)


def union(branches: list[Branch]) -> DataFrame:
    out = branches[0].df
    for b in branches[1:]:
        out = out.unionByName(b.df, allowMissingColumns=True)
    return out


def top_answers(answers: DataFrame, n: int) -> DataFrame:
    """The n most important answers, in a total order."""
    names = sorted(c for c in answers.columns if c.startswith("v_"))
    return answers.orderBy(F.desc("importance"), "handles", "paths", *names).limit(n)


def assignment(answers: DataFrame) -> Column:
    """The bound variables as a map."""
    pairs = [F.struct(F.lit(c[2:]).alias("key"), F.col(c).alias("value")) for c in sorted(answers.columns) if c.startswith("v_")]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


__all__ = ["Branch", "Compiler", "QueryOptions", "assignment", "best_share", "distinct_assignments", "product", "top_answers", "union"]
