"""Attention: a directed weighted network per context, kept as DataFrames and changed by whole-table arithmetic.

A state holds nodes (handle, cnt, importance), edges (src, dst, cnt), determiners (handle, determiner) and the tokens not
yet handed out. Every operation returns a new state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stored


@dataclass(frozen=True)
class Rates:
    rent: float = 0.75
    spread_low: float = 0.10
    spread_high: float = 0.10


@dataclass(frozen=True)
class Attention:
    nodes: DataFrame
    edges: DataFrame
    determiners: DataFrame
    tokens: float = 1.0
    rates: Rates = Rates()

    @staticmethod
    def empty(spark: SparkSession, rates: Rates = Rates()) -> Attention:
        table = lambda schema: spark.createDataFrame([], schema)
        return Attention(table("handle string, cnt long, importance double"), table("src string, dst string, cnt long"), table("handle string, determiner string"), 1.0, rates)

    # Growing the network

    def _merged(self, counts: DataFrame, edges: DataFrame) -> Attention:
        nodes = self.nodes.unionByName(counts.withColumn("importance", F.lit(0.0))).groupBy("handle").agg(F.sum("cnt").alias("cnt"), F.sum("importance").alias("importance"))
        both = self.edges.unionByName(edges).groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))
        return replace(self, nodes=stored(nodes, "attention"), edges=stored(both, "attention"))

    def correlate(self, sets: DataFrame) -> Attention:
        """sets: handles, an array per set; sets of fewer than two handles don't count. All ordered pairs of a set gain one."""
        sets = sets.select(F.array_distinct("handles").alias("handles")).where(F.size("handles") >= 2)
        counts = sets.select(F.explode("handles").alias("handle")).groupBy("handle").agg(F.count(F.lit(1)).alias("cnt"))
        pairs = sets.select(F.explode("handles").alias("src"), "handles").select("src", F.explode("handles").alias("dst")).where("src <> dst")
        return self._merged(counts, pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt")))

    def correlate_asymmetric(self, lists: DataFrame) -> Attention:
        """lists: handles, an array per list. The first handle of each gains an edge to every other."""
        lists = lists.where(F.size("handles") >= 2)
        counts = lists.select(F.explode("handles").alias("handle")).groupBy("handle").agg(F.count(F.lit(1)).alias("cnt"))
        pairs = lists.select(F.get("handles", F.lit(0)).alias("src"), F.explode(F.slice("handles", 2, 1 << 30)).alias("dst"))
        return self._merged(counts, pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt")))

    def set_determiners(self, lists: DataFrame) -> Attention:
        """lists: handles; the importance of each first handle is determined by the others too."""
        pairs = lists.select(F.get("handles", F.lit(0)).alias("handle"), F.explode(F.slice("handles", 2, 1 << 30)).alias("determiner"))
        both = self.determiners.unionByName(pairs).distinct()
        named = pairs.select("handle").unionByName(pairs.select(F.col("determiner").alias("handle"))).distinct()
        new = named.join(self.nodes, "handle", "left_anti").select("handle", F.lit(0).cast("long").alias("cnt"), F.lit(0.0).alias("importance"))
        return replace(self, determiners=stored(both, "attention"), nodes=stored(self.nodes.unionByName(new), "attention"))

    # Reading it

    def importance(self, rule: str = "average", max_depth: int = 32) -> DataFrame:
        """handle, importance: own and determiners' by rule average, greatest or product. Determiners in a circle are an error.

        Handles are settled from those without determiners upwards, one join a level; a handle settles when all its
        determiners have.
        """
        own = self.nodes.select("handle", F.col("importance").alias("own"))
        if not self.determiners.limit(1).count():
            return own.select("handle", F.col("own").alias("importance"))
        # A determiner outside the network counts with 0.
        names = own.unionByName(self.determiners.select(F.col("determiner").alias("handle"), F.lit(0.0).alias("own"))).groupBy("handle").agg(F.sum("own").alias("own"))
        open_ = stored(names.join(self.determiners.select("handle").distinct(), "handle", "left_semi"), "attention")
        settled = stored(names.join(self.determiners.select("handle").distinct(), "handle", "left_anti").select("handle", F.col("own").alias("importance")), "attention")
        combined = {
            "average": (F.col("own") + F.sum("importance")) / (F.count(F.lit(1)) + 1),
            "greatest": F.greatest(F.col("own"), F.max("importance")),
            "product": F.col("own") * F.product("importance"),
        }[rule]
        for _ in range(max_depth):
            if not open_.limit(1).count():
                return settled
            known = open_.join(self.determiners, "handle").join(settled.withColumnRenamed("handle", "determiner"), "determiner", "left")
            now = known.groupBy("handle", "own").agg(combined.alias("importance"), F.count("importance").alias("n"), F.count(F.lit(1)).alias("all")).where("n = all").select("handle", "importance")
            settled = stored(settled.unionByName(now), "attention")
            left = stored(open_.join(settled, "handle", "left_anti"), "attention")
            if left.count() == open_.count():
                break
            open_ = left
        raise ValueError("determiners form a circle or are too deep")

    # Stimulation

    def stimulate(self, counts: DataFrame, conserve: bool = False) -> Attention:
        """One cycle of rent, wages and spreading. counts: handle, n; ignored with fewer than one handle.

        A wage for a handle outside the network is lost, and what a node without neighbours would spread too, unless
        conserve is set: then such wages aren't owed and such nodes keep theirs.
        """
        known = self.nodes.select("handle")
        paid = counts.groupBy("handle").agg(F.sum("n").alias("n"))
        if conserve:
            paid = paid.join(known, "handle", "left_semi")
        total = paid.agg(F.sum("n")).first()[0]
        if not total:
            return self
        r = self.rates
        rent = self.nodes.agg(F.coalesce(F.sum("importance"), F.lit(0.0))).first()[0] * r.rent
        pool = rent + self.tokens
        weighed = self.edges.join(self.nodes.select(F.col("handle").alias("src"), F.col("cnt").alias("src_cnt")), "src").select("src", "dst", (F.col("cnt") / F.col("src_cnt")).alias("w"))
        by_src = weighed.groupBy("src").agg(F.sum("w").alias("all_w"), F.count(F.lit(1)).alias("arity"))
        largest = by_src.agg(F.max("arity")).first()[0] or 1
        wage = F.coalesce(F.col("n") * F.lit(pool) / F.lit(float(total)), F.lit(0.0))
        rate = F.lit(r.spread_low) + (r.spread_high - r.spread_low) * F.coalesce("arity", F.lit(0)) / F.lit(float(largest))
        spends = F.col("all_w").isNotNull() if conserve else F.lit(True)
        updated = self.nodes.join(paid, "handle", "left").withColumn("importance", F.col("importance") * (1 - r.rent) + wage)
        updated = updated.join(by_src.withColumnRenamed("src", "handle"), "handle", "left").withColumn("spread", F.when(spends, F.col("importance") * rate).otherwise(0.0))
        shares = weighed.join(updated.where(F.col("all_w").isNotNull()).select(F.col("handle").alias("src"), "spread", "all_w"), "src")
        received = shares.groupBy(F.col("dst").alias("handle")).agg(F.sum(F.col("spread") * F.col("w") / F.col("all_w")).alias("received"))
        nodes = updated.join(received, "handle", "left").select("handle", "cnt", (F.col("importance") - F.col("spread") + F.coalesce("received", F.lit(0.0))).alias("importance"))
        return replace(self, nodes=stored(nodes, "attention"), tokens=0.0)

    # Files

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        for name in ("nodes", "edges", "determiners"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(self.tokens,)], "tokens double").write.mode("overwrite").parquet(f"{path}/pool")

    @staticmethod
    def load(spark: SparkSession, path: str, rates: Rates = Rates()) -> Attention:
        nodes, edges, determiners, pool = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "determiners", "pool"))
        return Attention(nodes, edges, determiners, pool.first()[0], rates)

    def replay(self, lines: DataFrame) -> Attention:
        """From rows of text: DET and COR with lists of handles, ACT with handles that one stimulation counts."""
        parts = lines.select(F.split(F.trim("value"), " +").alias("p")).select(F.get("p", F.lit(0)).alias("kind"), F.slice("p", 2, 1 << 30).alias("handles"))
        of = lambda kind: parts.where(F.col("kind") == kind).select("handles")
        state = self.set_determiners(of("DET")).correlate_asymmetric(of("COR"))
        return state.stimulate(of("ACT").select(F.explode("handles").alias("handle")).groupBy("handle").agg(F.count(F.lit(1)).alias("n")))


def context_lines(determiners: DataFrame, correlations: DataFrame, stimuli: DataFrame) -> DataFrame:
    """value: what replay() reads, from arrays of handles."""
    line = lambda df, kind: df.select(F.concat_ws(" ", F.lit(kind), F.col("handles")).alias("value"))
    return line(determiners, "DET").unionByName(line(correlations, "COR")).unionByName(line(stimuli, "ACT"))
