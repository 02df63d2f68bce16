"""Approximate nearest neighbours by inner product: a forest of random-projection trees with one shared priority queue.

Vectors get a further component so that all have the largest norm; nearness by inner product then is nearness by angle.
Trees are grown on a bounded sample (MAX_SAMPLE distinct vectors, in the order of a hash of vec_id): each node splits its
share of the sample at the median projection on the difference of two of its vectors, of DRAWS such directions the one
along which the share spreads most. Every vector is routed down every tree. A query keeps one queue of nodes over all
trees, by the sum of the squared margins that it crossed, and visits the next leaf until it has looked at its share of the
rows. That share is what queries of the sample need for TARGET of their true neighbours, so vectors without structure are
searched far and clustered ones little; trees are only so deep that a query visits about MAX_VISITS leaves.

Leaves are joined with their visitors in blocks of bounded size on either side, whose products are formed at once. A
candidate that a query meets in several trees counts in the first of them only. The best of a block get their scores anew,
summed in one order whatever the block, and the best over all blocks are ranked.

Equal vectors are indexed once, with their k + 1 least ids, and equal queries are searched once. Vectors that are null or
zero, hold null or non-finite components, or have another length than most (of equally frequent lengths the least, as
vectors of different lengths have no inner product) take no part, neither do null ids. Rows equal in vec_id and vector
count once; a vec_id with several vectors has a list for each. Ties go to the smaller vec_id; with fewer candidates than
k all are returned; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, ship, stored

K, EVERY = 20, 20
#: Trees of the forest, least rows aimed at in a leaf, leaves that a query may visit, share of true neighbours aimed at.
TREES, LEAF, MAX_VISITS, TARGET = 6, 50, 128, 0.93
#: Vectors that trees are grown on, of them queries that choose the share, candidates and queries of a block, directions drawn.
MAX_SAMPLE, MAX_TRIALS, BLOCK, QUERIES, DRAWS, SEED = 32_768, 200, 4096, 1024, 4, 5


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in heap order: unit directions and thresholds of the inner nodes."""

    directions: np.ndarray  # trees, nodes, dimensions
    thresholds: np.ndarray  # trees, nodes
    norm: float  # the largest of any vector

    @property
    def depth(self) -> int:
        return (self.thresholds.shape[1] + 1).bit_length() - 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest]) / self.norm

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        y = self.lifted(x)
        out = np.zeros((len(x), len(self.directions)), np.int64)
        for t in range(len(self.directions)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", y, self.directions[t, node]) > self.thresholds[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out

    def visits(self, x: np.ndarray, counts: np.ndarray, rows: float) -> Iterator[tuple[int, int, int]]:
        """(row, tree, leaf) of the leaves that each query row visits until it has looked at rows; counts: rows by tree and leaf."""
        inner = 2**self.depth - 1
        y = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
        for i in range(len(x)):
            margins = (self.directions @ y[i] - self.thresholds).tolist()
            queue = [(0.0, t, 0) for t in range(len(margins))]
            looked = 0
            while queue and looked < rows:
                crossed, t, node = heapq.heappop(queue)
                while node < inner:
                    m = margins[t][node]
                    heapq.heappush(queue, (crossed + m * m, t, 2 * node + 1 + (m <= 0)))
                    node = 2 * node + 1 + (m > 0)
                if counts[t, node - inner]:
                    looked += int(counts[t, node - inner])
                    yield i, t, node - inner

    def counts(self, leaves: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(leaves[:, t], minlength=2**self.depth) for t in range(leaves.shape[1])])

    def share_needed(self, sample: np.ndarray, k: int, target: float, trials: int) -> float:
        """Rows to look at, as a multiple of all rows, for target of the k true neighbours within the sample."""
        leaves = self.leaves(sample)
        counts = self.counts(leaves)
        queries = sample[:trials]
        scores = queries @ sample.T
        scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
        true = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
        found_at = np.full(true.shape, np.inf)
        looked, last = 0, -1
        for i, t, leaf in self.visits(queries, counts, np.inf):
            looked = counts[t, leaf] + (looked if i == last else 0)
            last = i
            here = leaves[true[i], t] == leaf
            found_at[i, here] = np.minimum(found_at[i, here], looked)
        return float(np.quantile(found_at, target)) / len(sample) if found_at.size else 1.0


def grow(sample: np.ndarray, norm: float, depth: int, trees: int = TREES, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    n_nodes = 2**depth - 1
    forest = Forest(np.zeros((trees, n_nodes, sample.shape[1] + 1)), np.zeros((trees, n_nodes)), norm)
    y = forest.lifted(sample)
    for t in range(trees):
        shares: list[np.ndarray] = [np.arange(len(y))]
        for node in range(n_nodes):
            mine = shares[node]
            if len(mine) > 1:
                ends = np.stack([rng.choice(mine, 2, replace=False) for _ in range(DRAWS)])
                drawn = y[ends[:, 0]] - y[ends[:, 1]]
            else:
                drawn = rng.normal(size=(1, y.shape[1]))
            drawn = drawn / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-12)
            spread = (y[mine[:1024]] @ drawn.T).std(axis=0) if len(mine) else np.zeros(1)
            direction = drawn[int(spread.argmax())]
            projected = y[mine] @ direction
            threshold = float(np.median(projected)) if len(mine) else 0.0
            forest.directions[t, node], forest.thresholds[t, node] = direction, threshold
            shares += [mine[projected <= threshold], mine[projected > threshold]]
            shares[node] = mine[:0]
    return forest


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("embedding")).where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (sizes["d"] if sizes else 0))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, trees: int = TREES, leaf: int = LEAF, target: float = TARGET, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for each row of vectors (vec_id, embedding) whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    ship(spark)
    same = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.reverse("embedding"), F.lit(1)).alias("b"))
    rows = stored(usable(vectors).select("vec_id", "embedding", same.alias("digest")), "vectors")
    # The least ids of equal vectors: the limit on the rank is applied before the shuffle too, so a common vector stays small.
    by_id = Window.partitionBy("digest").orderBy("vec_id")
    least = rows.select("digest", "vec_id").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    members = stored(least.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.array_distinct(F.array_sort(F.collect_list("vec_id"))).alias("ids")), "vector-members")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "digest").distinct()
    first = members.select("digest", F.col("rep").alias("vec_id"), "ids")
    with_query = asked.select("digest").distinct().withColumn("asked", F.lit(True))
    reps = rows.join(first, ["digest", "vec_id"]).join(with_query, "digest", "left").select(F.col("vec_id").alias("rep"), "embedding", F.coalesce("asked", F.lit(False)).alias("asked")).dropDuplicates(["rep"])
    reps = stored(reps, "vector-reps")
    n, norm = reps.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r[0] for r in reps.select("embedding").orderBy(F.xxhash64("rep"), "rep").limit(max_sample).collect()])
    depth = max(0, min(int(np.ceil(np.log2(max(n / leaf, 1)))), int(np.log2(max(len(sample) / 8, 1)))))
    forest = grow(sample, float(norm), depth, trees)
    share = forest.share_needed(sample, k, target, MAX_TRIALS)
    while depth and share * 2**depth > MAX_VISITS:
        depth = min(depth - 1, max(0, int(np.log2(MAX_VISITS / share))))
        forest = grow(sample, float(norm), depth, trees)
        share = forest.share_needed(sample, k, target, MAX_TRIALS)
    shared = spark.sparkContext.broadcast(forest)  # as large as the sample allows
    leaves_n = 2**depth

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                found = shared.value.leaves(np.stack(b["embedding"].tolist()))
                yield pd.DataFrame({"rep": b["rep"], "embedding": b["embedding"], "leaves": list(found.astype(np.int32)), "asked": b["asked"]})

    routed = stored(reps.mapInPandas(route, "rep long, embedding array<double>, leaves array<int>, asked boolean"), "vector-leaves")
    in_leaf = routed.select("rep", F.posexplode("leaves").alias("tree", "leaf"))

    def by_leaf(rows: DataFrame) -> np.ndarray:
        out = np.zeros((trees, leaves_n), np.int64)
        for r in rows.groupBy("tree", "leaf").count().collect():  # at most trees times 2 ** depth rows
            out[r["tree"], r["leaf"]] = r["count"]
        return out

    counts = by_leaf(in_leaf)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                seen = np.zeros((len(b), trees * leaves_n), bool)
                for i, t, f in shared.value.visits(np.stack(b["embedding"].tolist()), counts, share * n):
                    seen[i, t * leaves_n + f] = True
                yield pd.DataFrame({"rep": b["rep"], "embedding": b["embedding"], "visited": [np.flatnonzero(x).astype(np.int32) for x in seen], "seen": [np.packbits(x).tobytes() for x in seen]})

    if not routed.where("asked").limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = stored(routed.where("asked").select("rep", "embedding").mapInPandas(visit, "rep long, embedding array<double>, visited array<int>, seen binary"), "vector-visits")
    visits = asking.withColumn("at", F.explode("visited")).withColumns({"tree": F.floor(F.col("at") / leaves_n).cast("int"), "leaf": (F.col("at") % leaves_n).cast("int")})
    visitors = by_leaf(visits)
    blocks, parties = np.maximum(1, -(-counts // BLOCK)), -(-visitors // QUERIES)
    # How many blocks of candidates and of queries a leaf has: at most trees times 2 ** depth rows, however many vectors.
    known = [(t, f, int(blocks[t, f]), int(parties[t, f])) for t in range(trees) for f in range(leaves_n) if parties[t, f]]
    sizes = F.broadcast(spark.createDataFrame(known, "tree int, leaf int, blocks int, parties int"))
    task = ["tree", "leaf", "block", "party"]
    own, other = lambda m: F.pmod(F.xxhash64("rep"), F.col(m)).cast("int"), lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    queries = visits.select("rep", "embedding", "seen", "tree", "leaf").join(sizes, ["tree", "leaf"]).withColumn("party", own("parties")).withColumn("block", other("blocks"))
    queries = queries.select("rep", "embedding", *task, "seen", F.lit(None).cast("array<int>").alias("leaves"))
    placed = routed.select("rep", "embedding", "leaves", F.posexplode("leaves").alias("tree", "leaf")).join(sizes, ["tree", "leaf"]).withColumn("block", own("blocks")).withColumn("party", other("parties"))
    placed = placed.select("rep", "embedding", *task, F.lit(None).cast("binary").alias("seen"), "leaves")

    def best(task: pd.DataFrame) -> pd.DataFrame:
        q, c = task[task["seen"].notna()], task[task["seen"].isna()]
        if not len(q) or not len(c):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "candidate": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, y = np.stack(c["embedding"].tolist()), np.stack(q["embedding"].tolist())
        seen, leaves = np.stack([np.unpackbits(np.frombuffer(s, np.uint8)) for s in q["seen"]]), np.stack(c["leaves"].tolist())
        rough = y @ x.T
        for t in range(int(task["tree"].iloc[0])):
            rough[seen[:, t * leaves_n + leaves[:, t]] > 0] = -np.inf
        # All that may tie with the last of the best come along, and none that an earlier tree has shown.
        least = np.partition(rough, -k - 1, axis=1)[:, [-k - 1]] if len(c) > k + 1 else np.full((len(q), 1), -np.inf)
        row, column = np.nonzero((rough >= least - 1e-9 * (1 + np.abs(y).sum(axis=1, keepdims=True) * np.abs(x).max())) & (rough > -np.inf))
        return pd.DataFrame({"query": q["rep"].to_numpy()[row], "candidate": c["rep"].to_numpy()[column], "score": (y[row] * x[column]).sum(axis=1)})

    found = queries.unionByName(placed).groupBy(*task).applyInPandas(best, "query long, candidate long, score double")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")
    expanded = found.join(members.select(F.col("rep").alias("candidate"), "ids"), "candidate").select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = expanded.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = stored(ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")), "vector-found")
    for used in (routed, asking, reps):
        discard(used)
    wanted = asked.join(members.select("digest", F.col("rep").alias("query")), "digest").join(lists, "query").select(F.col("vec_id").alias("query_id"), "found")
    others = wanted.select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("p", "f")).select("query_id", (F.col("p") + 1).alias("rank"), "f.vec_id", "f.score")
