"""Registered queries of the pattern engine, over a hypergraph of the tables, each with SQL where SQL has its meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.handles import link_column, md5, node_column, node_handle
from .operators import accessors, linking
from .operators.attention import Attention, context_lines
from .operators.paths import find_paths
from .operators.store import SKIP, Federation, Peer, Store, federated
from .plans.compiler import Compiler, QueryOptions, top_answers
from .plans.patterns import And, Chain, Constant, Or, Template, Variable, parse
from .sources.expressions import as_links, load_expressions
from .sources.relational import TableSpec, map_table, map_tables, relation

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def in_nation(spark: SparkSession, d: str) -> DataFrame:
    return relation(table(spark, d, "customer"), "InNation", named("customer", "c_custkey"), named("nation", "c_nationkey"))


def in_region(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return relation(rows, "InRegion", named("nation", "n_nationkey"), F.concat(F.lit('"'), "r_name", F.lit('"')))


def placed_by(spark: SparkSession, d: str) -> DataFrame:
    return relation(table(spark, d, "orders"), "PlacedBy", named("order", "o_orderkey"), named("customer", "o_custkey"))


def contains(spark: SparkSession, d: str) -> DataFrame:
    return relation(table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), "Contains", named("order", "l_orderkey"), named("part", "l_partkey"))


def supplied_in(spark: SparkSession, d: str) -> DataFrame:
    return relation(table(spark, d, "supplier"), "SuppliesIn", named("supplier", "s_suppkey"), named("nation", "s_nationkey"))


def deals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return relation(rows, "Deals", named("customer", "o_custkey"), named("supplier", "l_suppkey"))


def under(spark: SparkSession, d: str) -> DataFrame:
    """Each part under those of half and a third of its number: a graph with many paths."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("p"))
    rows = parts.select("p", F.explode(F.array(F.floor(F.col("p") / 2), F.floor(F.col("p") / 3))).alias("q")).where("q > 0").distinct()
    return relation(rows, "Under", named("part", "p"), named("part", "q"))


def rich(spark: SparkSession, d: str) -> DataFrame:
    """(Rich (InNation c n)) for customers with a balance over 5000: links over links."""
    inner = relation(table(spark, d, "customer").where("c_acctbal > 5000"), "InNation", named("customer", "c_custkey"), named("nation", "c_nationkey"))
    targets = F.array(F.lit(node_handle("Rich")), F.col("handle"))
    rows = inner.select(targets.alias("targets"), F.concat(F.lit("(Rich "), "expr", F.lit(")")).alias("expr"))
    return as_links(rows.select(link_column(F.col("targets")).alias("handle"), F.lit("Expression").alias("type"), "targets", F.lit(True).alias("is_toplevel"), "expr"))


def links_of(spark: SparkSession, d: str, *relations: Callable) -> DataFrame:
    out = relations[0](spark, d)
    for r in relations[1:]:
        out = out.unionByName(r(spark, d))
    return out


def ask(spark: SparkSession, d: str, query: object, relations: tuple, options: QueryOptions | None = None, importance: DataFrame | None = None) -> DataFrame:
    return Compiler(spark, links_of(spark, d, *relations), importance, options or QueryOptions()).compile(query)


# SQL building blocks. Handles are MD5 over type and content.

X = md5("Expression")


def sym(value: str) -> str:
    return f"md5('Symbol ' || {value})"


def lnk(*targets: str) -> str:
    return f"md5('{X} ' || {' || chr(32) || '.join(targets)})"


def rel_sql(head: str, a: str, b: str, source: str) -> str:
    """a, b, h of a relation."""
    return f"(SELECT {sym(a)} AS a, {sym(b)} AS b, {lnk(repr(node_handle(head)), sym(a), sym(b))} AS h FROM {source})"


IN_NATION = rel_sql("InNation", "'customer:' || c_custkey", "'nation:' || c_nationkey", "customer")
IN_REGION = rel_sql("InRegion", "'nation:' || n_nationkey", "'\"' || r_name || '\"'", "nation JOIN region ON n_regionkey = r_regionkey")
PLACED_BY = rel_sql("PlacedBy", "'order:' || o_orderkey", "'customer:' || o_custkey", "orders")
CONTAINS = rel_sql("Contains", "'order:' || l_orderkey", "'part:' || l_partkey", "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
SUPPLIES_IN = rel_sql("SuppliesIn", "'supplier:' || s_suppkey", "'nation:' || s_nationkey", "supplier")
DEALS = rel_sql("Deals", "'customer:' || o_custkey", "'supplier:' || l_suppkey", "(SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
UNDER_ROWS = "(SELECT DISTINCT p, q FROM (SELECT p_partkey AS p, p_partkey // 2 AS q FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE q > 0)"
UNDER = rel_sql("Under", "'part:' || p", "'part:' || q", UNDER_ROWS)


def s(name: str) -> str:
    return f"'{node_handle(name)}'"


def query(sql: str | None = None) -> Callable[[Build], Build]:
    def add(f: Build) -> Build:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flat(answers: DataFrame, *names: str) -> DataFrame:
    """The answers with handles as text, for comparison by value."""
    bound = [F.col(f"v_{n}").alias(n) for n in names]
    return answers.select(*bound, F.array_join("handles", " ").alias("handles"), "importance", "strength")


# Leaves and operators


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return flat(ask(spark, d, '(and (InNation $c $n) (InRegion $n "ASIA"))', (in_nation, in_region)), "c", "n")


@query(f"SELECT x.a AS c, x.b AS n, x.h || ' ' || y.h AS handles, 0.0::DOUBLE AS importance, 0.0::DOUBLE AS strength FROM {IN_NATION} x JOIN {IN_REGION} y ON x.b = y.a WHERE y.b = {s(chr(34) + 'ASIA' + chr(34))}")
def pattern_and(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


@query(f"SELECT a AS c, h AS handles, 0.0::DOUBLE AS importance, 0.0::DOUBLE AS strength FROM {IN_NATION} WHERE b = {s('nation:3')}")
def pattern_template(spark: SparkSession, d: str) -> DataFrame:
    return flat(ask(spark, d, "(InNation $c nation:3)", (in_nation, in_region)), "c")


def rel(head: str, *parts: object) -> Template:
    return Template((Constant(node_handle(head)), *[Variable(p[1:]) if p[0] == "$" else Constant(node_handle(p)) for p in parts]))


@query(f"SELECT x.a AS c, x.b AS n, z.a AS o, x.h || ' ' || y.h || ' ' || z.h AS handles, 0.0::DOUBLE AS importance, 0.0::DOUBLE AS strength FROM {IN_NATION} x JOIN {IN_REGION} y ON x.b = y.a JOIN {PLACED_BY} z ON z.b = x.a WHERE y.b = {s(chr(34) + 'ASIA' + chr(34))}")
def pattern_and_three(spark: SparkSession, d: str) -> DataFrame:
    q = And((rel("InNation", "$c", "$n"), rel("InRegion", "$n", '"ASIA"'), rel("PlacedBy", "$o", "$c")))
    return flat(ask(spark, d, q, (in_nation, in_region, placed_by)), "c", "n", "o")


@query(f"SELECT a AS c, h AS handles, 0.0::DOUBLE AS importance, 0.0::DOUBLE AS strength FROM {IN_NATION} x WHERE b = {s('nation:3')} AND NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 5000 AND x.a = {sym(chr(39) + 'customer:' + chr(39) + ' || c_custkey')})")
def pattern_andnot(spark: SparkSession, d: str) -> DataFrame:
    return flat(ask(spark, d, "(andnot (InNation $c nation:3) (Rich (InNation $c $n)))", (in_nation, rich)), "c")


@query(f"SELECT a AS x, h AS handles, 0.0::DOUBLE AS importance, 0.0::DOUBLE AS strength FROM {IN_NATION} WHERE b = {s('nation:3')} UNION ALL SELECT a, h, 0.0::DOUBLE, 0.0::DOUBLE FROM {SUPPLIES_IN} WHERE b = {s('nation:3')}")
def pattern_or(spark: SparkSession, d: str) -> DataFrame:
    return flat(ask(spark, d, "(or (InNation $x nation:3) (SuppliesIn $x nation:3))", (in_nation, supplied_in)), "x")


@query(f"SELECT DISTINCT y.a AS c FROM {PLACED_BY} z JOIN {IN_NATION} y ON z.b = y.a")
def pattern_unique(spark: SparkSession, d: str) -> DataFrame:
    """Distinct assignments; the order isn't part of them, so the customer alone is kept by a plain distinct afterwards."""
    found = ask(spark, d, "(and (PlacedBy $o $c) (InNation $c $n))", (placed_by, in_nation), QueryOptions(unique_assignment=True))
    return found.select(F.col("v_c").alias("c")).distinct()


@query(f"""SELECT c, n, least(h1, h2) AS handles FROM (SELECT x.a AS c, x.b AS n, min(x.h) AS h1, min(x.h) AS h2 FROM {IN_NATION} x JOIN {PLACED_BY} y ON y.b = x.a GROUP BY 1, 2)""")
def pattern_unique_filter(spark: SparkSession, d: str) -> DataFrame:
    """Of equal assignments of an OR only one answer stays."""
    q = Or((rel("InNation", "$c", "$n"), And((rel("InNation", "$c", "$n"), rel("PlacedBy", "$o", "$c")))))
    found = Compiler(spark, links_of(spark, d, in_nation, placed_by), None, QueryOptions(unique_assignment=True)).compile(q)
    return found.where("v_o IS NOT NULL").groupBy(F.col("v_c").alias("c"), F.col("v_n").alias("n")).agg(F.min(F.get("handles", F.lit(0))).alias("handles"))


@query(f"""SELECT z.a AS c, z.b AS s, x.h || ' ' || z.h AS handles FROM {IN_NATION} x JOIN {DEALS} z ON z.a = x.a WHERE x.b = {s('nation:3')}
UNION ALL SELECT z.a, z.b, y.h || ' ' || z.h FROM {SUPPLIES_IN} y JOIN {DEALS} z ON z.b = y.a WHERE y.b = {s('nation:3')}""")
def pattern_partial_or(spark: SparkSession, d: str) -> DataFrame:
    """An OR whose clauses bind different variables, joined on whichever is bound."""
    q = "(and (or (InNation $c nation:3) (SuppliesIn $s nation:3)) (Deals $c $s))"
    return flat(ask(spark, d, q, (in_nation, supplied_in, deals)), "c", "s").drop("importance", "strength")


@query(f"SELECT x.a AS n, y.a AS m, x.h || ' ' || y.h AS handles FROM {IN_REGION} x, {IN_REGION} y WHERE x.b = {s(chr(34) + 'ASIA' + chr(34))} AND y.b = {s(chr(34) + 'EUROPE' + chr(34))}")
def pattern_product(spark: SparkSession, d: str) -> DataFrame:
    """Clauses without a shared variable: the product that the query asks for."""
    return flat(ask(spark, d, '(and (InRegion $n "ASIA") (InRegion $m "EUROPE"))', (in_region,)), "n", "m").drop("importance", "strength")


@query(f"SELECT x.a AS x, y.a AS y, x.b AS n FROM {IN_NATION} x JOIN {SUPPLIES_IN} y ON x.b = y.b WHERE x.b = {s('nation:3')}")
def pattern_unique_value(spark: SparkSession, d: str) -> DataFrame:
    found = ask(spark, d, "(and (and (InNation $x $n) (SuppliesIn $y $n)) (InNation $x nation:3))", (in_nation, supplied_in), QueryOptions(unique_value=True))
    return found.select(F.col("v_x").alias("x"), F.col("v_y").alias("y"), F.col("v_n").alias("n"))


@query(f"SELECT x.a AS c, x.b AS n, {lnk(s('Rich'), 'x.h')} AS handles FROM {IN_NATION} x JOIN (SELECT {sym(chr(39) + 'customer:' + chr(39) + ' || c_custkey')} AS a FROM customer WHERE c_acctbal > 5000) r ON r.a = x.a")
def pattern_nested(spark: SparkSession, d: str) -> DataFrame:
    return flat(ask(spark, d, "(Rich (InNation $c $n))", (rich, in_nation)), "c", "n").drop("importance", "strength")


IMPORTANCE = f"(SELECT {lnk(s('InNation'), sym(chr(39) + 'customer:' + chr(39) + ' || c_custkey'), sym(chr(39) + 'nation:' + chr(39) + ' || c_nationkey'))} AS h, {sym(chr(39) + 'customer:' + chr(39) + ' || c_custkey')} AS c, c_acctbal AS i FROM customer)"


def balance_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = relation(table(spark, d, "customer").withColumn("k", F.col("c_acctbal")), "InNation", named("customer", "c_custkey"), named("nation", "c_nationkey"))
    both = table(spark, d, "customer").select(node_column(named("customer", "c_custkey")).alias("t1"), F.col("c_acctbal").alias("importance"))
    return rows.join(both, "t1").select("handle", "importance")


@query(f"SELECT c, round(i, 6) AS importance FROM {IMPORTANCE} ORDER BY i DESC, h LIMIT 50")
def option_max_answers(spark: SparkSession, d: str) -> DataFrame:
    found = top_answers(ask(spark, d, "(InNation $c $n)", (in_nation,), None, balance_importance(spark, d)), 50)
    return found.select(F.col("v_c").alias("c"), F.round("importance", 6).alias("importance"))


@query(f"SELECT c FROM {IMPORTANCE} WHERE i > 0")
def option_positive_importance(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "(InNation $c $n)", (in_nation,), QueryOptions(positive_importance=True), balance_importance(spark, d)).select(F.col("v_c").alias("c"))


@query(f"SELECT c FROM (SELECT c, row_number() OVER (ORDER BY i DESC, h) AS r, count(*) OVER () AS n FROM {IMPORTANCE}) WHERE r <= greatest(1, CAST(floor(0.3 * n + 0.5) AS BIGINT))")
def option_focus_strictness(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "(InNation $c $n)", (in_nation,), QueryOptions(focus_strictness=0.3), balance_importance(spark, d)).select(F.col("v_c").alias("c"))


@query("SELECT count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey")
def option_count(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "(and (PlacedBy $o $c) (InNation $c $n))", (placed_by, in_nation)).agg(F.count(F.lit(1)).alias("count"))


@query(f"SELECT n, count(*) AS answers FROM (SELECT y.b AS n FROM {PLACED_BY} x JOIN {IN_NATION} y ON x.b = y.a) GROUP BY n")
def answers_grouped(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d, "(and (PlacedBy $o $c) (InNation $c $n))", (placed_by, in_nation)).groupBy(F.col("v_n").alias("n")).agg(F.count(F.lit(1)).alias("answers"))


def serves(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs as InNation under another name."""
    return relation(table(spark, d, "customer"), "Serves", named("customer", "c_custkey"), named("nation", "c_nationkey"))


SERVES = rel_sql("Serves", "'customer:' || c_custkey", "'nation:' || c_nationkey", "customer")


@query(f"""SELECT x.a AS c, x.b AS n, CASE WHEN i.i > 0 THEN x.h WHEN i.i < 0 THEN y.h ELSE least(x.h, y.h) END AS handles, greatest(i.i, 0) AS importance, 0.0::DOUBLE AS strength
FROM {IN_NATION} x JOIN {SERVES} y ON x.a = y.a AND x.b = y.b JOIN {IMPORTANCE} i ON i.h = x.h""")
def unique_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Two clauses of an OR bind the same values; the more important answer of either stays."""
    q = Or((rel("InNation", "$c", "$n"), rel("Serves", "$c", "$n")))
    return flat(ask(spark, d, q, (in_nation, serves), QueryOptions(unique_assignment=True), balance_importance(spark, d)), "c", "n")


@query(f"SELECT x.a AS x, y.a AS y FROM {IN_NATION} x JOIN {SERVES} y ON x.b = y.b AND x.a <> y.a WHERE x.b = {s('nation:3')}")
def unique_value(spark: SparkSession, d: str) -> DataFrame:
    """Different variables bind different values: no customer meets itself."""
    found = ask(spark, d, "(and (InNation $x nation:3) (Serves $y nation:3))", (in_nation, serves), QueryOptions(unique_value=True))
    return found.select(F.col("v_x").alias("x"), F.col("v_y").alias("y"))


ORDERS_OF = f"{PLACED_BY} z JOIN {IMPORTANCE} i ON i.c = z.b"


@query(f"SELECT z.a AS o, round(i.i / 2, 6) AS importance FROM {ORDERS_OF}")
def importance_average(spark: SparkSession, d: str) -> DataFrame:
    found = ask(spark, d, "(and (PlacedBy $o $c) (InNation $c $n))", (placed_by, in_nation), None, balance_importance(spark, d))
    return found.select(F.col("v_o").alias("o"), F.round("importance", 6).alias("importance"))


@query(f"SELECT z.a AS o, round(greatest(i.i, 0), 6) AS importance FROM {ORDERS_OF}")
def importance_greatest(spark: SparkSession, d: str) -> DataFrame:
    found = ask(spark, d, "(and (PlacedBy $o $c) (InNation $c $n))", (placed_by, in_nation), QueryOptions(greatest=True), balance_importance(spark, d))
    return found.select(F.col("v_o").alias("o"), F.round("importance", 6).alias("importance"))


@query(f"SELECT z.a AS o, z.h AS handles FROM {ORDERS_OF}")
def merge_left_handles(spark: SparkSession, d: str) -> DataFrame:
    found = ask(spark, d, "(and (PlacedBy $o $c) (InNation $c $n))", (placed_by, in_nation), QueryOptions(merge_handles=False))
    return found.select(F.col("v_o").alias("o"), F.array_join("handles", " ").alias("handles"))


@query("SELECT count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey")
def engine_count_only(spark: SparkSession, d: str) -> DataFrame:
    links = links_of(spark, d, placed_by, in_nation)
    return Engine(spark, Store(links.limit(0).select("handle"), links)).query("(and (PlacedBy $o $c) (InNation $c $n))", QueryOptions(count_only=True))


# Paths


def part_importance(spark: SparkSession, d: str) -> DataFrame:
    """Of an Under link, by the number of its lower part."""
    parts = table(spark, d, "part").select(node_column(named("part", "p_partkey")).alias("t1"), (F.col("p_partkey") % 7 / 10.0).alias("importance"))
    return under(spark, d).join(parts.hint("merge"), "t1").select("handle", "importance")


WEIGHED = f"(SELECT u.*, i FROM {UNDER} u JOIN (SELECT {sym(chr(39) + 'part:' + chr(39) + ' || p_partkey')} AS k, p_partkey % 7 / 10.0 AS i FROM part) w ON w.k = u.a)"
FROM_150 = f"""WITH RECURSIVE e AS {WEIGHED}, p AS (SELECT [h] AS links, [{s('part:150')}, b] AS nodes, b AS here, CAST(i AS DOUBLE) AS total, CAST(i AS DOUBLE) AS top FROM e WHERE a = {s('part:150')}
UNION ALL SELECT list_append(links, h), list_append(nodes, b), b, total + i, greatest(top, i) FROM p JOIN e ON e.a = p.here WHERE NOT list_contains(nodes, b) AND here <> {s('part:1')})"""


def part_chain(source: str | None, target: str | None) -> Chain:
    end = lambda name, v: Constant(node_handle(name)) if name else Variable(v)
    return Chain(0, 1, 2, end(source, "x"), end(target, "y"), rel("Under", "$p", "$q"))


@query(f"{FROM_150} SELECT array_to_string(links, ' ') AS path, round(total / CASE WHEN len(links) > 1 THEN len(links) + 1 ELSE 1 END, 9) AS importance FROM p WHERE here = {s('part:1')}")
def chain_compiled(spark: SparkSession, d: str) -> DataFrame:
    """A CHAIN through the compiler, its edges selected from a query's answers, with importance."""
    found = ask(spark, d, part_chain("part:150", "part:1"), (under, in_nation), None, part_importance(spark, d))
    return found.select(F.array_join(F.get("paths", F.lit(0)), " ").alias("path"), F.round("importance", 9).alias("importance"))


@query(f"{FROM_150} SELECT array_to_string(links, ' ') AS path, round(top, 9) AS importance FROM p WHERE here = {s('part:1')}")
def chain_greatest(spark: SparkSession, d: str) -> DataFrame:
    found = ask(spark, d, part_chain("part:150", "part:1"), (under,), QueryOptions(path_greatest=True), part_importance(spark, d))
    return found.select(F.array_join(F.get("paths", F.lit(0)), " ").alias("path"), F.round("importance", 9).alias("importance"))


@query(f"""{FROM_150.replace(f" AND here <> {s('part:1')}", "")}, r AS (SELECT links, here, row_number() OVER (PARTITION BY links[:-2] ORDER BY round(total / CASE WHEN len(links) > 1 THEN len(links) + 1 ELSE 1 END, 12) DESC, links[-1]) AS nth FROM p)
SELECT array_to_string(links, ' ') AS path, here AS y FROM r WHERE nth = 1 OR here NOT IN (SELECT a FROM e)""")
def chain_best_child(spark: SparkSession, d: str) -> DataFrame:
    """From one part to a variable end: dead ends, and of every path its most important continuation."""
    found = ask(spark, d, part_chain("part:150", None), (under,), None, part_importance(spark, d))
    return found.select(F.array_join(F.get("paths", F.lit(0)), " ").alias("path"), F.col("v_y").alias("y"))


@query(f"{FROM_150} SELECT array_to_string(links, ' ') AS path, array_to_string(nodes[2:-2], ' ') AS hops FROM p WHERE here = {s('part:1')}")
def path_hops(spark: SparkSession, d: str) -> DataFrame:
    """The nodes along each path but its ends."""
    found = ask(spark, d, part_chain("part:150", "part:1"), (under,))
    found = found.withColumn("path", F.array_join(F.get("paths", F.lit(0)), " "))
    return accessors.path_hops(found, under(spark, d), ">^$0_1_2", "path").select("path", F.array_join("hops", " ").alias("hops"))


@query(f"""WITH RECURSIVE e AS {UNDER}, p AS (SELECT [h] AS links, [{s('part:150')}, b] AS nodes, b AS here FROM e WHERE a = {s('part:150')}
UNION ALL SELECT list_append(links, h), list_append(nodes, b), b FROM p JOIN e ON e.a = p.here WHERE NOT list_contains(nodes, b) AND here <> {s('part:1')})
SELECT array_to_string(links, ' ') AS path, CAST(len(links) AS BIGINT) AS hops FROM p WHERE here = {s('part:1')}""")
def chain_complete(spark: SparkSession, d: str) -> DataFrame:
    edges = under(spark, d).select("handle", F.col("t1").alias("src"), F.col("t2").alias("dst"), F.lit(0.0).alias("importance"))
    found = find_paths(edges, node_handle("part:150"), node_handle("part:1"))
    return found.select(F.array_join("links", " ").alias("path"), F.size("links").cast("long").alias("hops"))


@query(f"""WITH RECURSIVE e AS {UNDER}, p AS (SELECT [h] AS links, [b, a] AS nodes, a AS here FROM e WHERE b = {s('part:7')}
UNION ALL SELECT list_prepend(h, links), list_append(nodes, a), a FROM p JOIN e ON e.b = p.here WHERE NOT list_contains(nodes, a))
SELECT here AS start, array_to_string(links, ' ') AS path FROM p""")
def chain_to_variable(spark: SparkSession, d: str) -> DataFrame:
    """All paths that end at one part, from whichever part."""
    edges = under(spark, d).select("handle", F.col("t1").alias("src"), F.col("t2").alias("dst"), F.lit(0.0).alias("importance"))
    found = find_paths(edges, None, node_handle("part:7"), incomplete=True, all_prefixes=True)
    return found.select(F.col("first").alias("start"), F.array_join("links", " ").alias("path"))


# Store


@query(f"SELECT {sym(chr(39) + 'nation:' + chr(39) + ' || n_nationkey')} AS target, count(*) AS links FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) x JOIN nation ON k = n_nationkey GROUP BY 1")
def store_incoming(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(node_column(named("nation", "n_nationkey")).alias("handle"))
    links = links_of(spark, d, in_nation, supplied_in)
    return Store(links.select("handle").limit(0), links).incoming(nations).groupBy("target").agg(F.count(F.lit(1)).alias("links"))


@query(f"SELECT h AS handle, unnest([{s('InNation')}, a, b]) AS target, unnest([0, 1, 2]) AS pos FROM {IN_NATION}")
def store_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return in_nation(spark, d).select("handle", F.posexplode("targets").alias("pos", "target"))


@query(f"SELECT unnest([{s('InNation')}, a, b]) AS target, unnest([0, 1, 2]) AS pos FROM {IN_NATION} WHERE a = {s('customer:7')}")
def store_targets(spark: SparkSession, d: str) -> DataFrame:
    links = in_nation(spark, d)
    one = links.where(F.col("t1") == node_handle("customer:7")).first()["handle"]
    return Store(links.select("handle").limit(0), links).targets(one).select(F.posexplode("targets").alias("pos", "target"))


@query(f"SELECT h AS handle FROM {IN_NATION} WHERE b = {s('nation:3')} UNION ALL SELECT h FROM {SUPPLIES_IN} WHERE b = {s('nation:3')}")
def store_federation_writes(spark: SparkSession, d: str) -> DataFrame:
    """New links reach the writable peer alone, and both peers are read as one store."""
    none = in_nation(spark, d).select("handle", "type", F.col("expr").alias("name"), "is_toplevel").limit(0)
    both = Federation((Peer(Store(none, in_nation(spark, d).where("false"))), Peer(Store(none, in_nation(spark, d)), writable=False)))
    after = both.added(Store(none, supplied_in(spark, d)))
    if after.peers[1].written is not None:
        raise ValueError("a read-only peer was written to")
    return after.store().links.where(F.col("t2") == node_handle("nation:3")).select("handle")


@query(f"SELECT h AS handle FROM {IN_NATION} WHERE b = {s('nation:3')}")
def store_match(spark: SparkSession, d: str) -> DataFrame:
    links = links_of(spark, d, in_nation, placed_by)
    return Store(links.select("handle").limit(0), links).match([node_handle("InNation"), None, node_handle("nation:3")]).select("handle")


@query(f"SELECT h AS handle FROM {IN_NATION} UNION SELECT h FROM {SUPPLIES_IN}")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    first, second = in_nation(spark, d), links_of(spark, d, in_nation, supplied_in)
    new = second.select("handle", "type", "targets", "is_toplevel", "expr")
    return Store(first.select("handle").limit(0), first).add_links(new, SKIP).links.select("handle")


@query(f"SELECT h AS handle FROM {IN_NATION} WHERE b <> {s('nation:3')}")
def store_delete(spark: SparkSession, d: str) -> DataFrame:
    """Deleting a nation takes the links that hold it, and the links over those."""
    links = links_of(spark, d, in_nation, rich)
    gone = spark.createDataFrame([(node_handle("nation:3"),)], "handle string")
    left = Store(gone, links).delete(gone, with_incoming=True)
    return left.links.where(F.col("t0") == node_handle("InNation")).select("handle")


@query(f"SELECT h AS handle, CASE WHEN b = {s('nation:3')} THEN 'first' ELSE 'second' END AS origin FROM {IN_NATION}")
def store_federated(spark: SparkSession, d: str) -> DataFrame:
    """Two stores hold some links both; the first one's copy counts."""
    links = in_nation(spark, d)
    a = links.where(F.col("t2") == node_handle("nation:3")).withColumn("expr", F.lit("first"))
    b = links.withColumn("expr", F.lit("second"))
    none = links.select("handle", "type", F.col("expr").alias("name"), "is_toplevel").limit(0)
    return federated([Store(none, a), Store(none, b)]).links.select("handle", F.col("expr").alias("origin"))


@query(f"""SELECT root, unnest([{s('InNation')}, {s('Rich')}, a, b]) AS handle FROM (SELECT {lnk(s('Rich'), 'x.h')} AS root, x.a, x.b FROM {IN_NATION} x JOIN (SELECT {sym(chr(39) + 'customer:' + chr(39) + ' || c_custkey')} AS a FROM customer WHERE c_acctbal > 5000) r ON r.a = x.a)""")
def store_reachable(spark: SparkSession, d: str) -> DataFrame:
    links = links_of(spark, d, in_nation, rich)
    leaves = links.select(F.explode("targets").alias("handle")).distinct().join(links.select("handle"), "handle", "left_anti")
    return Store(leaves, links).reachable(rich(spark, d).select("handle"))


# Attention


def order_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string"))).alias("handles")).select("handles")


SETS = "(SELECT DISTINCT l_orderkey AS o, 'supplier:' || l_suppkey AS h FROM lineitem)"
BIG_SETS = f"(SELECT o, h FROM {SETS} WHERE o IN (SELECT o FROM {SETS} GROUP BY o HAVING count(*) > 1))"
EDGES = f"(SELECT x.h AS src, y.h AS dst, count(*) AS cnt FROM {BIG_SETS} x JOIN {BIG_SETS} y ON x.o = y.o AND x.h <> y.h GROUP BY 1, 2)"


@query(f"SELECT src, dst, cnt FROM {EDGES}")
def attention_correlate(spark: SparkSession, d: str) -> DataFrame:
    return Attention.empty(spark).correlate(order_sets(spark, d)).edges


@query(f"""WITH nodes AS (SELECT h, count(*) AS cnt FROM {BIG_SETS} GROUP BY h), edges AS {EDGES},
w AS (SELECT src, dst, e.cnt / CAST(n.cnt AS DOUBLE) AS w FROM edges e JOIN nodes n ON src = h), t AS (SELECT src, sum(w) AS all_w FROM w GROUP BY src),
paid AS (SELECT h, 1.0 / (SELECT count(*) FROM nodes) AS importance FROM nodes),
got AS (SELECT dst, sum(importance * 0.1 * w / all_w) AS received FROM w JOIN t USING (src) JOIN paid ON src = h GROUP BY dst)
SELECT h AS handle, round(importance * 0.9 + coalesce(received, 0), 9) AS importance FROM paid LEFT JOIN got ON dst = h""")
def attention_stimulate(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers get an equal wage out of the first token, then spread a tenth along their correlations."""
    state = Attention.empty(spark).correlate(order_sets(spark, d))
    state = state.stimulate(state.nodes.select("handle", F.lit(1).alias("n")))
    return state.nodes.select("handle", F.round("importance", 9).alias("importance"))


@query("""WITH base AS (SELECT 'n' || n_nationkey AS h, 'r' || n_regionkey AS d, n_nationkey / 100.0 AS own FROM nation), r AS (SELECT 'r' || r_regionkey AS h, r_regionkey / 10.0 AS own FROM region)
SELECT base.h AS handle, round((base.own + r.own) / 2, 9) AS importance FROM base JOIN r ON d = r.h UNION ALL SELECT h, round(own, 9) FROM r""")
def attention_determiners(spark: SparkSession, d: str) -> DataFrame:
    """A nation's importance is averaged with its region's."""
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    n = lambda df, kind, key, by: df.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("handle"), F.lit(1).cast("long").alias("cnt"), (F.col(key) / by).alias("importance"))
    empty = Attention.empty(spark)
    state = Attention(n(nations, "n", "n_nationkey", 100.0).unionByName(n(regions, "r", "r_regionkey", 10.0)), empty.edges, empty.determiners)
    lists = nations.select(F.array(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("handles"))
    return state.set_determiners(lists).importance().select("handle", F.round("importance", 9).alias("importance"))


def ordered_sets(spark: SparkSession, d: str) -> DataFrame:
    return order_sets(spark, d).select(F.array_sort("handles").alias("handles"))


@query(f"SELECT src, h AS dst, count(*) AS cnt FROM (SELECT o, min(h) AS src FROM {BIG_SETS} GROUP BY o) JOIN {BIG_SETS} USING (o) WHERE h <> src GROUP BY 1, 2")
def attention_asymmetric(spark: SparkSession, d: str) -> DataFrame:
    return Attention.empty(spark).correlate_asymmetric(ordered_sets(spark, d)).edges


@query("""WITH f AS (SELECT 'n' || n_nationkey AS n, 'r' || n_regionkey AS r, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation),
c AS (SELECT r AS h, CAST(m AS BIGINT) AS cnt FROM f UNION ALL SELECT n, 1 FROM f) SELECT h AS handle, 0 + CASE WHEN h[1] = 'n' THEN round(1.0 / (SELECT count(*) FROM nation), 9) ELSE 0 END AS importance FROM (SELECT DISTINCT h FROM c)""")
def attention_replay(spark: SparkSession, d: str) -> DataFrame:
    """A file of lines: nations are determined by their regions, and each nation is stimulated once."""
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    nations = table(spark, d, "nation").select(name("n", "n_nationkey").alias("n"), name("r", "n_regionkey").alias("r"))
    none = nations.limit(0).select(F.array("n").alias("handles"))
    lines = context_lines(nations.select(F.array("n", "r").alias("handles")), none, nations.select(F.array("n").alias("handles")))
    return Attention.empty(spark).replay(lines).nodes.select("handle", F.round(F.greatest("importance", F.lit(0.0)) / 0.9, 9).alias("importance"))


# Inference and link creation


def part_facts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as predicates that hold of the orders they are in, weighted by discount. An order has few parts, so pairs stay few."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("owner"), F.col("l_orderkey").cast("string").alias("key"))
    return rows.agg((F.round(F.max("l_discount") * 100) + 1).cast("long").alias("w"))


FACTS = "(SELECT CAST(l_partkey AS VARCHAR) AS owner, CAST(l_orderkey AS VARCHAR) AS key, CAST(round(max(l_discount) * 100) + 1 AS BIGINT) AS w FROM lineitem GROUP BY 1, 2)"
COUNTED = f"""f AS {FACTS}, c AS (SELECT owner, sum(w) AS w FROM f GROUP BY owner),
p AS (SELECT x.owner AS a, y.owner AS b, sum(least(x.w, y.w)) AS common FROM f x JOIN f y ON x.key = y.key AND x.owner < y.owner GROUP BY 1, 2)"""


@query(f"""WITH {COUNTED}, e AS (SELECT a, b, common / CAST(ca.w + cb.w - common AS DOUBLE) AS strength FROM p JOIN c ca ON ca.owner = a JOIN c cb ON cb.owner = b)
SELECT a, b, round(strength, 6) AS strength FROM e WHERE strength >= 0.03 UNION ALL SELECT b, a, round(strength, 6) FROM e WHERE strength >= 0.03""")
def infer_equivalence(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "a string, b string")
    return linking.equivalences(part_facts(spark, d), none, 0.03).select("a", "b", F.round("strength", 6).alias("strength"))


@query(f"""WITH {COUNTED}, e AS (SELECT CASE WHEN ca.w < cb.w THEN a ELSE b END AS a, CASE WHEN ca.w < cb.w THEN b ELSE a END AS b, common / CAST(least(ca.w, cb.w) AS DOUBLE) AS strength FROM p JOIN c ca ON ca.owner = p.a JOIN c cb ON cb.owner = p.b)
SELECT a, b, round(strength, 6) AS strength FROM e WHERE strength >= 0.06""")
def infer_implication(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "a string, b string")
    return linking.implications(part_facts(spark, d), none, 0.06).select("a", "b", F.round("strength", 6).alias("strength"))


@query(f"SELECT DISTINCT {lnk(s('Trades'), 'x.b', 'y.b')} AS handle FROM {IN_NATION} x JOIN {DEALS} z ON z.a = x.a JOIN {SUPPLIES_IN} y ON y.a = z.b")
def link_creation(spark: SparkSession, d: str) -> DataFrame:
    """(Trades n m) for nations whose customers and suppliers deal."""
    links = links_of(spark, d, in_nation, deals, supplied_in)
    found = Compiler(spark, links).compile(And((rel("InNation", "$c", "$n"), rel("Deals", "$c", "$s"), rel("SuppliesIn", "$s", "$m"))))
    return linking.instantiated(found, rel("Trades", "$n", "$m"), links).select("handle")


def supplier_facts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as predicates that hold of the nations they deliver to, weighted by their largest discount there: few keys, each a hub."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("l_suppkey").cast("string").alias("owner"), F.col("c_nationkey").cast("string").alias("key")).agg(F.round(F.max("l_discount") * 100).cast("long").alias("w"))


HUB_FACTS = "(SELECT CAST(l_suppkey AS VARCHAR) AS owner, CAST(c_nationkey AS VARCHAR) AS key, CAST(round(max(l_discount) * 100) AS BIGINT) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
HUB_COUNTED = COUNTED.replace(FACTS, HUB_FACTS)


@query(f"""WITH {HUB_COUNTED}, e AS (SELECT a, b, common / CAST(ca.w + cb.w - common AS DOUBLE) AS strength FROM p JOIN c ca ON ca.owner = a JOIN c cb ON cb.owner = b)
SELECT a, b, round(strength, 6) AS strength FROM e WHERE strength >= 0.9 UNION ALL SELECT b, a, round(strength, 6) FROM e WHERE strength >= 0.9""")
def infer_equivalence_hubs(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "a string, b string")
    return linking.equivalences(supplier_facts(spark, d), none, 0.9, classes=True, digits=6)


@query(f"""WITH {HUB_COUNTED}, e AS (SELECT CASE WHEN ca.w < cb.w THEN a ELSE b END AS a, CASE WHEN ca.w < cb.w THEN b ELSE a END AS b, common / CAST(least(ca.w, cb.w) AS DOUBLE) AS strength FROM p JOIN c ca ON ca.owner = p.a JOIN c cb ON cb.owner = p.b)
SELECT a, b, round(strength, 6) AS strength FROM e WHERE strength >= 0.97""")
def infer_implication_hubs(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "a string, b string")
    return linking.implications(supplier_facts(spark, d), none, 0.97, classes=True, digits=6)


def tenth_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rules: every tenth part implies the next."""
    return table(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string").alias("a"), (F.col("p_partkey") + 1).cast("string").alias("b"), F.lit(0.5).alias("strength"))


@query(f"""WITH f AS {FACTS}, r AS (SELECT CAST(p_partkey AS VARCHAR) AS a, CAST(p_partkey + 1 AS VARCHAR) AS b FROM part WHERE p_partkey % 10 = 0),
e AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_orderkey + 1 AS VARCHAR) AS b FROM orders WHERE o_orderkey % 7 = 0),
n AS (SELECT b AS owner, key, w * 0.5::DOUBLE AS w FROM f JOIN r ON owner = a UNION ALL SELECT owner, b, w * 0.5::DOUBLE FROM f JOIN e ON key = a)
SELECT owner, key, max(w) AS w FROM n WHERE (owner, key) NOT IN (SELECT owner, key FROM f) GROUP BY 1, 2 HAVING max(w) >= 2""")
def infer_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """What follows by an implication between parts or an equivalence of orders."""
    equal = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").cast("string").alias("a"), (F.col("o_orderkey") + 1).cast("string").alias("b"), F.lit(0.5).alias("strength"))
    return linking.evaluations(part_facts(spark, d), tenth_parts(spark, d), equal, 2.0)


@query(f"""WITH f AS {FACTS} SELECT x.owner AS a, y.owner AS b, x.key AS key, {lnk(s('AND'), 'x.owner', 'y.owner')} AS composite
FROM f x JOIN f y ON x.key = y.key AND x.owner < y.owner WHERE x.owner[1] <> y.owner[1]""")
def infer_and_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parts in one order whose numbers begin differently: their first digit stands for the base predicate."""
    facts = part_facts(spark, d)
    mentions = facts.select("owner", F.substring("owner", 1, 1).alias("name")).distinct()
    return linking.and_predicates(facts, spark.createDataFrame([], "a string, b string"), mentions).drop("w")


ORDER_WORDS = """(SELECT l_orderkey AS sentence, 'part ' || l_partkey AS word, count(*) AS n FROM lineitem GROUP BY 1, 2
UNION ALL SELECT o_orderkey, o_orderpriority, 1 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


@query(f"""WITH w AS {ORDER_WORDS}, t AS (SELECT sentence, sum(n) AS total FROM w GROUP BY 1),
s AS (SELECT x.sentence AS a, y.sentence AS b, sum(x.n + y.n) AS shared FROM w x JOIN w y ON x.word = y.word AND x.sentence < y.sentence GROUP BY 1, 2)
SELECT a, b, round(CAST(shared AS DOUBLE) / CAST(p.total + q.total AS DOUBLE), 6) AS similarity FROM s JOIN t p ON p.sentence = a JOIN t q ON q.sentence = b
WHERE CAST(shared AS DOUBLE) / CAST(p.total + q.total AS DOUBLE) >= 0.6""")
def sentence_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sentences of their parts and of their priority, a word that a fifth of all orders hold."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    parts = lines.groupBy(F.col("l_orderkey").alias("sentence"), F.concat(F.lit("part "), F.col("l_partkey")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    urgency = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_orderkey").alias("sentence"), F.col("o_orderpriority").alias("word"), F.lit(1).cast("long").alias("n"))
    return linking.similar_sentences(parts.unionByName(urgency), 0.6).withColumn("similarity", F.round("similarity", 6))


# Relational mapping


@query("""SELECT name FROM (SELECT unnest(['Predicate', 'Concept', 'Evaluation', 'region', 'region.r_name']) AS name
UNION SELECT '"' || r_regionkey || '"' FROM region UNION SELECT '"' || r_name || '"' FROM region)""")
def relational_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = map_table(table(spark, d, "region"), TableSpec("region", "r_regionkey"))
    return nodes.select("name")


@query("""SELECT '(Evaluation (Predicate nation) (Concept (nation "' || n_nationkey || '")))' AS expr FROM nation
UNION ALL SELECT '(Evaluation (Predicate (nation nation.n_name "' || n_name || '")) (Concept (nation "' || n_nationkey || '")))' FROM nation
UNION ALL SELECT '(Evaluation (Predicate (nation.n_regionkey (Concept (region "' || n_regionkey || '")))) (Concept (nation "' || n_nationkey || '")))' FROM nation""")
def relational_facts(spark: SparkSession, d: str) -> DataFrame:
    _, links = map_table(table(spark, d, "nation"), TableSpec("nation", "n_nationkey", {"n_regionkey": "region"}))
    return links.where("is_toplevel").select("expr")


@query("""WITH c AS (SELECT * FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING')
SELECT '(Evaluation (Predicate customer) (Concept (customer "' || c_custkey || '")))' AS expr FROM c
UNION ALL SELECT '(Evaluation (Predicate (customer customer.c_name "' || c_name || '")) (Concept (customer "' || c_custkey || '")))' FROM c
UNION ALL SELECT '(Evaluation (Predicate (customer.c_nationkey (Concept (nation "' || c_nationkey || '")))) (Concept (customer "' || c_custkey || '")))' FROM c
UNION ALL SELECT '(Evaluation (Predicate nation) (Concept (nation "' || n_nationkey || '")))' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)
UNION ALL SELECT '(Evaluation (Predicate (nation nation.n_name "' || n_name || '")) (Concept (nation "' || n_nationkey || '")))' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)""")
def relational_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Some customers, and of the nations those that they are in."""
    customers = TableSpec("customer", "c_custkey", {"c_nationkey": "nation"}, ("c_acctbal", "c_mktsegment"), ("c_acctbal > 9000", "c_mktsegment = 'BUILDING'"))
    _, links = map_tables({n: table(spark, d, n) for n in ("customer", "nation")}, [customers], [TableSpec("nation", "n_nationkey", skip=("n_regionkey",))])
    return links.where("is_toplevel").select("expr")


@query(f"""SELECT h AS handle, true AS is_toplevel FROM (SELECT {lnk(s('Knows'), sym(chr(39) + '"' + chr(39) + ' || c_name || ' + chr(39) + '"' + chr(39)), lnk(s('Lives'), sym(chr(39) + 'nation:' + chr(39) + ' || c_nationkey')))} AS h FROM customer)
UNION SELECT {lnk(s('Lives'), sym(chr(39) + 'nation:' + chr(39) + ' || c_nationkey'))}, false FROM customer""")
def load_lines(spark: SparkSession, d: str) -> DataFrame:
    """Expressions as text, nested, read into links, each once."""
    lines = table(spark, d, "customer").select(F.concat(F.lit('(Knows "'), "c_name", F.lit('" (Lives nation:'), F.col("c_nationkey").cast("string"), F.lit("))")).alias("value"))
    return load_expressions(lines)[1].select("handle", "is_toplevel")


# Words of documents


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents)
SELECT x.doc_id FROM w x JOIN w y ON x.doc_id = y.doc_id WHERE x.word = 'the' AND y.word = 'that'""")
def words_together(spark: SparkSession, d: str) -> DataFrame:
    """(and (Contains $s "the") (Contains $s "that")) over the words of all documents."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"))).alias("word")).where("word <> ''")
    links = relation(words, "Contains", F.col("doc_id"), F.concat(F.lit('"'), F.col("word"), F.lit('"')))
    found = Compiler(spark, links).compile(parse('(and (Contains $s "the") (Contains $s "that"))'))
    names = table(spark, d, "documents").select("doc_id", node_column(F.col("doc_id").cast("string")).alias("v_s"))
    return found.join(names, "v_s").select("doc_id")


@query(f"SELECT x.a AS c, x.a || ' ' || x.b AS bound, x.h AS first FROM {IN_NATION} x")
def answer_accessors(spark: SparkSession, d: str) -> DataFrame:
    found = ask(spark, d, "(InNation $c $n)", (in_nation,))
    return found.select(accessors.element(found, "$c").alias("c"), F.array_join(accessors.elements(found, "$*"), " ").alias("bound"), accessors.element(found, "_0").alias("first"))


@query(f"SELECT {sym('c_name')} AS node, {lnk(sym('c_name'), sym('c_mktsegment'))} AS link FROM customer")
def content_handles(spark: SparkSession, d: str) -> DataFrame:
    name, segment = node_column(F.col("c_name")), node_column(F.col("c_mktsegment"))
    return table(spark, d, "customer").select(name.alias("node"), link_column(F.array(name, segment)).alias("link"))
