"""Accessors: short names for parts of an answer, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PATH, _HOPS = re.compile(r"\^(\d+)_(\d+)$"), re.compile(r"([<>])(\^?)(\$?)(\d+)_(\d+)_(\d+)$")


def variables(answers: DataFrame) -> list[str]:
    return sorted(c for c in answers.columns if c.startswith("v_"))


def element(answers: DataFrame, name: str, strict: bool = True) -> Column:
    """One value: `-` none, `_i` a handle, `$v` a variable, `^p_i` a link of a path. Missing: an error, or empty if not strict."""
    if name == "-":
        return F.lit(None).cast("string")
    if m := _PATH.match(name):
        value = F.get(F.get("paths", F.lit(int(m[1]))), F.lit(int(m[2])))
    elif name[0] == "_" and name[1:].isdigit():
        value = F.get("handles", F.lit(int(name[1:])))
    elif name[0] == "$" and len(name) > 1 and name[1:] != "*":
        value = F.col(f"v_{name[1:]}") if f"v_{name[1:]}" in answers.columns else F.lit(None).cast("string")
    else:
        raise ValueError(f"{name} names no single value")
    missing = F.raise_error(F.lit(f"an answer has no {name}")).cast("string") if strict else F.lit("")
    return F.coalesce(value, missing)


def elements(answers: DataFrame, name: str, strict: bool = True) -> Column:
    """An array of values: `_*`, `$*`, `^*`, `*` for everything, or an array of one for a single value."""
    bound = F.filter(F.array(*[F.col(v) for v in variables(answers)]).cast("array<string>"), lambda v: v.isNotNull())
    if name == "_*":
        return F.col("handles")
    if name == "$*":
        return bound
    if name == "^*":
        return F.flatten("paths")
    if name == "*":
        return F.array_distinct(F.concat(F.col("handles"), bound, F.flatten("paths")))
    if name == "-":
        return F.array().cast("array<string>")
    return F.filter(F.array(element(answers, name, strict)), lambda v: v != "")


def path_hops(answers: DataFrame, links: DataFrame, name: str, key: str) -> DataFrame:
    """key and hops: the nodes along path p of `>p_s_e`, from targets s of its first link over targets e of every link.

    `<` swaps s and e; `^` drops the first node and `$` the last. key names a column that tells answers apart.
    """
    m = _HOPS.match(name)
    if not m:
        raise ValueError(f"{name} names no hops")
    p, s, e = (int(m[i]) for i in (4, 5, 6))
    if m[1] == "<":
        s, e = e, s
    steps = answers.select(key, F.posexplode(F.get("paths", F.lit(p))).alias("pos", "handle"))
    ends = links.select("handle", F.get("targets", F.lit(s)).alias("s"), F.get("targets", F.lit(e)).alias("e"))
    row = F.struct("pos", "s", "e")
    nodes = steps.join(ends, "handle").groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("steps"))
    hops = F.concat(F.transform(F.slice("steps", 1, 1), lambda x: x["s"]), F.transform("steps", lambda x: x["e"]))
    if m[2]:
        hops = F.slice(hops, 2, 1 << 30)
    if m[3]:
        hops = F.slice(hops, 1, F.size(hops) - 1)
    return nodes.select(key, hops.alias("hops"))


def answer_hash(answers: DataFrame) -> Column:
    """An answer's identity, from what it matched and bound."""
    bound = F.concat_ws(" ", *[F.concat(F.lit(v[2:] + "="), F.coalesce(v, F.lit(""))) for v in variables(answers)])
    return F.md5(F.concat_ws("|", F.array_join("handles", " "), F.array_join(F.flatten("paths"), " "), bound))


def to_json(answers: DataFrame) -> Column:
    pairs = F.struct(*[F.col(v).alias(v[2:]) for v in variables(answers)]) if variables(answers) else F.struct(F.lit(None).cast("string").alias("none"))
    return F.to_json(F.struct("handles", "paths", pairs.alias("assignment"), "importance", "strength"))
