r"""Mixing sources to target weights: hierarchical budgets and seeded token-prefixes. No Python runs on rows.

A tree of domain, language and source gets a token budget at its root. Each node deals its budget to its children by
their weights; what a child can't use (its supply is its tokens times max_epochs) is dealt among its siblings by weight
until they are full, and only what all of them can't use falls back to the parent's siblings. Since a node's supply is
the sum of its leaves', dealing from the root down by filling levels to supply does exactly this.

Each leaf then takes rows in the order of a seeded hash, a fresh order each epoch, as long as the tokens taken before a
row are less than its budget: a prefix that overshoots by less than one row. Rows are ordered by hash in buckets whose
token sums are added up first, so no leaf is sorted by one task, however large; a bucket's rows are ordered within it.

Tokens are words `[^\x20\x09-\x0D]+`. Null texts and texts without words supply nothing and are never taken; null
levels form a leaf of their own. Rows of one key share a hash and follow each other by tokens, then by a hash of all their
values, so only rows that are equal altogether are interchangeable. All columns of the caller's frame are carried along,
whatever their names. Weights of any node of the tree, by its path of names, take the place of the rules above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, fresh, stored, words

LEVELS = ("domain", "lang", "source")
#: Share of all available tokens that the mix asks for, and how often a row may be used.
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.8, 2, 17
#: Leading hexadecimal digits of a row's hash that name its bucket.
BUCKET_DIGITS = 3
#: Weights of the domains of domain_of(), any others weigh 1. Languages and sources weigh by DAMP's power of their tokens.
DOMAIN_WEIGHTS = {"web": 5.0, "books": 3.0, "code": 2.0}
DAMP = 0.5


def domain_of(source: Column) -> Column:
    """The domain of a source by its number: a stand-in for a table of sources, as the tables have none."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int")
    return F.when(number.isNull(), "other").when(number % 3 == 0, "web").when(number % 3 == 1, "books").otherwise("code")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _dealt(children: DataFrame, parent: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """children (levels, supply, weight, parent_budget) with budget: the parent's, dealt by weight up to each supply.

    By rising supply per weight, a child is full if dealing everything at its rate leaves something over; the others
    share by weight what the full ones leave.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rising = by.orderBy(F.col("supply") / F.col("weight"), *order)
    so_far = rising.rowsBetween(Window.unboundedPreceding, -1)
    df = children.withColumns(
        {
            "_full_before": F.coalesce(F.sum("supply").over(so_far), F.lit(0).cast("long")),
            "_weight_from": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("_full", F.col("_full_before") + F.col("supply") / F.col("weight") * F.col("_weight_from") <= F.col("parent_budget"))
    df = df.withColumns(
        {
            "_taken": F.coalesce(F.sum(F.when(F.col("_full"), F.col("supply"))).over(by), F.lit(0).cast("long")),
            "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(by),
        }
    )
    share = F.floor((F.col("parent_budget") - F.col("_taken")) * F.col("weight") / F.col("_open") + 1e-6).cast("long")
    return df.withColumn("budget", F.when(F.col("_full"), F.col("supply")).otherwise(F.least(F.col("supply"), share))).drop("_full_before", "_weight_from", "_full", "_taken", "_open")


def _weight(own: tuple[str, ...], top_weights: dict[str, float], damp: float, weights: dict[tuple[str | None, ...], float]) -> Column:
    """A node's weight: its own in weights, by the path of its names, else for the first level top_weights (or 1), for others damped."""
    out = F.lit(1.0) if len(own) == 1 else F.pow(F.col("tokens").cast("double"), F.lit(damp))
    given = dict({(name,): w for name, w in top_weights.items()} if len(own) == 1 else {}) | {p: w for p, w in weights.items() if len(p) == len(own)}
    for path, w in given.items():
        same = F.lit(True)
        for c, name in zip(own, path, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(name))
        out = F.when(same, float(w)).otherwise(out)
    return out


def budgets(
    leaves: DataFrame, budget: Column, levels: tuple[str, ...] = LEVELS, top_weights: dict[str, float] = DOMAIN_WEIGHTS, damp: float = DAMP, weights: dict[tuple[str | None, ...], float] | None = None
) -> DataFrame:
    """leaves (levels, tokens, supply) with each leaf's budget. weights: of nodes at any level, by path, as ("web", "en")."""
    if any(w <= 0 for w in [*top_weights.values(), *(weights or {}).values()]):
        raise ValueError("weights are positive")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0).cast("long")).alias("tokens")).select(budget.alias("parent_budget"))
    parents, above = total, ()
    for depth in range(len(levels)):
        own = levels[: depth + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("tokens").alias("tokens"), F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", _weight(own, top_weights, damp, weights or {}))
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"p.{c}")) for c in above]
        joined = nodes.alias("n").join(parents.alias("p"), on=same) if above else nodes.alias("n").join(F.broadcast(parents.alias("p")))  # one row
        dealt = _dealt(joined.select("n.*", "p.parent_budget"), above, own)
        parents, above = dealt.select(*own, F.col("budget").alias("parent_budget")), own
    return dealt.select(*levels, "tokens", "supply", "budget")


#: Leaves whose plan may be broadcast; beyond it the plan is joined by shuffle.
MAX_BROADCAST_LEAVES = 50_000


def mix(
    docs: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    tokens: str = "n_tokens",
    key: str = "doc_id",
    budget: Column | None = None,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    top_weights: dict[str, float] = DOMAIN_WEIGHTS,
    damp: float = DAMP,
    weights: dict[tuple[str | None, ...], float] | None = None,
) -> DataFrame:
    """The rows of docs that the mix takes, with the epoch (from 1) that takes them: a row taken twice comes twice.

    budget: a column over `tokens`, the sum of all tokens; by default BUDGET_SHARE of it. The epoch is the last column,
    called epoch, with underscores before it if docs have a column of that name.
    """
    budget = F.floor(F.col("tokens") * BUDGET_SHARE).cast("long") if budget is None else budget
    named = {f"level_{i}": F.col(c) for i, c in enumerate(levels)}
    # The caller's row is one column, so that its names can't meet those used here.
    facts = stored(docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in named.items()], F.col(tokens).cast("long").alias("n"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")), "mix")
    some = facts.where(F.col("n") > 0)
    names = tuple(named)
    leaves = some.groupBy(*names).agg(F.sum("n").alias("tokens")).withColumn("supply", F.col("tokens") * max_epochs)
    plan = budgets(leaves, budget, names, top_weights, damp, weights).where(F.col("budget") > 0)
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = stored(plan.select(*[F.col(c).alias(f"p_{c}") for c in names], "whole", "rest"), "mix-plan")
    small = plan.count() <= MAX_BROADCAST_LEAVES
    leaf = [f"p_{c}" for c in names]

    def planned(rows: DataFrame, more: DataFrame) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in names]
        return rows.join(F.broadcast(more) if small else more, on=same)

    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole") + 1, "key"))
    bucket = F.substring("order", 1, BUCKET_DIGITS)
    ordered = planned(some.drop("row"), plan).withColumn("order", order).withColumn("bucket", bucket)
    sums = ordered.where(F.col("rest") > 0).groupBy(*leaf, "rest", "bucket").agg(F.sum("n").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
    # The bucket in which the rest runs out: those before it are taken whole.
    edge = sums.where(F.col("before") < F.col("rest")).groupBy(*leaf).agg(F.max(F.struct("bucket", "before")).alias("edge"))
    edge = edge.select(*[F.col(c).alias(f"e_{c}") for c in leaf], F.col("edge.bucket").alias("last"), F.col("edge.before").alias("before"))
    full_plan = stored(plan.join(edge, [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in leaf], "left").drop(*[f"e_{c}" for c in leaf]), "mix-plan")
    discard(plan)
    rows = planned(some, full_plan).withColumn("order", order).withColumn("bucket", bucket)
    last = rows.where((F.col("rest") > 0) & (F.col("bucket") == F.col("last")))
    inside = F.sum("n").over(Window.partitionBy(*leaf).orderBy("order", "n", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("in", F.coalesce(inside, F.lit(0).cast("long"))).where(F.col("before") + F.col("in") < F.col("rest"))
    whole = rows.where(F.col("whole") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))))
    first = rows.where((F.col("rest") > 0) & (F.col("bucket") < F.col("last"))).withColumn("epoch", F.col("whole") + 1)
    taken = whole.select("row", "epoch").unionByName(first.select("row", "epoch")).unionByName(last.withColumn("epoch", F.col("whole") + 1).select("row", "epoch"))
    return taken.select("row.*", F.col("epoch").alias(fresh(docs.columns, "epoch")[0]))


def mix_documents(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, text, lang, source) and epoch taken."""
    facts = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", n_words(F.col("text")).alias("n_tokens"))
    return mix(facts).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def mix_sql(max_epochs: int = MAX_EPOCHS, seed: int = SEED, damp: float = DAMP, share: float = BUDGET_SHARE) -> str:
    """The same over a view documents, ordering each leaf as a whole."""
    weights = " ".join(f"WHEN domain = '{k}' THEN {v}::DOUBLE" for k, v in DOMAIN_WEIGHTS.items())
    number = "try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS INTEGER)"
    ctes, above = [], ()
    for depth in range(3):
        own = LEVELS[: depth + 1]
        weight = f"CASE {weights} ELSE 1.0::DOUBLE END" if depth == 0 else f"pow(CAST(sum(tokens) AS DOUBLE), {damp})"
        parent = f"PARTITION BY {', '.join(above)}" if above else ""
        same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in above) or "true"
        ctes.append(f"""
n{depth} AS (SELECT {", ".join(own)}, sum(tokens) AS tokens, sum(supply) AS supply, {weight} AS weight FROM leaves GROUP BY {", ".join(own)}),
j{depth} AS (SELECT n.*, p.budget AS pb FROM n{depth} n JOIN p{depth} p ON {same}),
f{depth} AS (SELECT *, coalesce(sum(supply) OVER ({parent} ORDER BY supply / weight, {", ".join(own)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + supply / weight * sum(weight) OVER ({parent} ORDER BY supply / weight, {", ".join(own)} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= pb AS is_full FROM j{depth}),
g{depth} AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN supply END) OVER ({parent}), 0) AS taken, sum(CASE WHEN NOT is_full THEN weight END) OVER ({parent}) AS open_weight FROM f{depth}),
p{depth + 1} AS (SELECT {", ".join(own)}, tokens, CASE WHEN is_full THEN supply ELSE least(supply, CAST(floor((pb - taken) * weight / open_weight + 1e-6) AS BIGINT)) END AS budget FROM g{depth})""")
        above = own
    same = " AND ".join(f"d.{c} IS NOT DISTINCT FROM p.{c}" for c in LEVELS)
    return f"""
WITH docs AS (SELECT doc_id, CASE WHEN {number} IS NULL THEN 'other' WHEN {number} % 3 = 0 THEN 'web' WHEN {number} % 3 = 1 THEN 'books' ELSE 'code' END AS domain, lang, source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
filled AS (SELECT * FROM docs WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {max_epochs} AS supply FROM filled GROUP BY ALL),
p0 AS (SELECT CAST(floor(sum(tokens) * {share}) AS BIGINT) AS budget FROM leaves),{",".join(ctes)},
plan AS (SELECT *, CAST(floor(budget / tokens) AS BIGINT) AS whole, budget - CAST(floor(budget / tokens) AS BIGINT) * tokens AS rest FROM p3 WHERE budget > 0),
o AS (SELECT d.*, p.whole, p.rest, md5('{seed}:' || (p.whole + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM filled d JOIN plan p ON {same}),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(1, whole + 1)) AS BIGINT) AS epoch FROM o WHERE whole > 0
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + 1 AS BIGINT) FROM c WHERE before < rest"""
