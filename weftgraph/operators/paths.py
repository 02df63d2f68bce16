"""Variable-length path search: simple paths by one join a hop."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored


def path_importance(total: Column, n: Column, compat_average: bool, greatest: bool = False) -> Column:
    """compat_average: a path of n > 1 links divides by n + 1. greatest: total is the greatest link's and stays as it is."""
    if greatest:
        return total
    return total / (F.when(n > 1, n + 1).otherwise(n) if compat_average else n)


def find_paths(
    edges: DataFrame, source: str | None, target: str | None, incomplete: bool = False, all_prefixes: bool = False, max_hops: int | None = None, compat_average: bool = True, greatest: bool = False
) -> DataFrame:
    """links (in source-to-target order), first, last, importance of the simple paths over edges (handle, src, dst, importance).

    Between two known ends: all paths; a path that reaches the far end isn't extended. With incomplete, or from one known
    end: the dead ends too, and of each extended path its most important continuation (ties to the smaller
    link), or every continuation with all_prefixes. Self-loops are on no simple path and are left out. Every hop is a join with
    the edges, stored in the shared folder; the search ends when no path can grow, which simple paths come to by themselves, and raises if
    some still can after max_hops.
    """
    # Where all continuations are returned, dead ends are among them, and no path is found twice.
    best_only, every = incomplete and not all_prefixes, incomplete and all_prefixes
    edges = edges.where(F.col("src") != F.col("dst"))
    edges = stored(edges.dropDuplicates(["handle", "src", "dst"]) if every else edges, "edges")
    backward = source is None
    near, far = ("dst", "src") if backward else ("src", "dst")
    start, goal = (target, source) if backward else (source, target)
    step = edges.select(F.col(near).alias("_near"), F.col(far).alias("_far"), F.col("handle").alias("_link"), F.col("importance").alias("_importance"))
    empty = F.array().cast("array<string>")
    front = edges.limit(1).select(empty.alias("links"), F.array(F.lit(start)).alias("nodes"), F.lit(0.0).alias("total")) if start else None
    out: list[DataFrame] = []
    for hop in count(1):
        here = F.element_at("nodes", -1)
        grown = front.join(step, (here == F.col("_near")) & ~F.array_contains("nodes", F.col("_far")))
        grown = grown.select(*[F.col("links").alias("before")] * best_only, F.array_append("links", F.col("_link")).alias("links"), F.array_append("nodes", F.col("_far")).alias("nodes"), (F.greatest("total", "_importance") if greatest else F.col("total") + F.col("_importance")).alias("total"))
        grown = stored(grown, "paths", compression="zstd")
        done = F.element_at("nodes", -1) == goal if goal else F.lit(False)
        shape = ["links", "nodes", "total"]
        if every:
            out.append(grown.where(~done).select(shape))
        if best_only:
            dead = front.join(grown.select("before").distinct(), F.col("links") == F.col("before"), "left_anti").where(F.size("links") > 0)
            n = F.size("links")
            best = F.struct((-path_importance(F.col("total"), n, compat_average, greatest)).alias("i"), F.element_at("links", -1).alias("link"), "links", "nodes", "total")
            out.append(dead.select(shape))
            out.append(grown.where(~done).groupBy("before").agg(F.min(best).alias("b")).select("b.links", "b.nodes", "b.total"))
        if goal:
            out.append(grown.where(done).select(shape))
        front = grown.where(~done).select(shape)
        if not front.limit(1).count():
            break
        if hop == max_hops:
            raise ValueError("paths are longer than max_hops")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    if not every:
        found = found.dropDuplicates(["links"])
    ordered = (lambda c: F.reverse(c)) if backward else (lambda c: F.col(c))
    nodes = ordered("nodes")
    return found.select(
        ordered("links").alias("links"), F.element_at(nodes, 1).alias("first"), F.element_at(nodes, -1).alias("last"), path_importance(F.col("total"), F.size("links"), compat_average, greatest).alias("importance")
    )
