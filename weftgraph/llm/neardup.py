r"""N-gram Jaccard join by MinHash banding: all documents of similarity THRESHOLD or more are linked.

Words are `[^\x20\x09-\x0D]+`, unchanged; a text's set is its distinct five-word n-grams, or all its words as one n-gram
if it has fewer. N-grams compare by 64-bit hashes. Equal texts are one node, weighted by its copies, so copies are never
paired. Band and row counts are chosen for the target recall at the threshold. Band hashes are shuffled; texts of one
bucket are candidates of each other, and each bucket ties its members to its least one, which parts the texts into
components that no candidate pair leaves.

Candidates are verified on the full sets, by counting shared n-grams in tasks of bounded size. A component that has no
more pairs than its buckets have together, as groups of near copies have, is verified as a whole, so that no pair comes
twice; any other component, as dissimilar texts chained by chance, is verified bucket by bucket, and a pair counts in
the first band that it shares. So the work is never more than that of the candidate pairs. What is larger than a block
takes a task for each pair of its blocks. Tasks give links per text and edges of a spanning forest, never pairs, and
classes are the components of verified links.

Null, empty and blank texts have no n-grams, hence no links, and are classes of their own. A class's id is its least
doc_id. Repeated rows are copies. Other columns of the input play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, join_hot, ship_texts, stored
from .graphs import components
from .wordhash import U, batched, gram_hashes, mix64, word_hashes

GRAM, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.99999, 160
#: Texts of one block and n-grams counted at a time when a task verifies its pairs; a task holds two blocks at most.
BLOCK, COLUMNS = 400, 2048
#: Linked pairs whose bands are compared at a time.
PAIRS = 1 << 16


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands reach the recall within max_hashes."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def grams_of(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of a text's n-grams, with repetitions."""
    if not len(words):
        return words
    return gram_hashes(words, min(n, len(words)))


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, digest of the text, and an array of its band hashes, empty without n-grams."""
    mult = _multipliers(bands * rows)
    shift = mix64(mult)
    factor = _multipliers(bands * rows + rows)[-rows:]

    def bands_of(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for places, hashes, at in batched([t.encode("utf-8", "surrogatepass") for t in texts]):
            grams = [grams_of(hashes[at[k] : at[k + 1]]) for k in range(len(places))]
            filled = [k for k, g in enumerate(grams) if len(g)]
            if not filled:
                continue
            flat = np.concatenate([grams[k] for k in filled])
            starts = np.cumsum([0] + [len(grams[k]) for k in filled])[:-1]
            least = np.empty((len(filled), bands * rows), U)
            for j in range(bands * rows):
                least[:, j] = np.minimum.reduceat(flat * mult[j] + shift[j], starts)
            keys = mix64((least.reshape(len(filled), bands, rows) * factor).sum(axis=2, dtype=U) + np.arange(bands, dtype=U)).view(np.int64)
            for k, row in zip(filled, keys, strict=True):
                out[places[k]] = row
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "bands": bands_of([t or "" for t in batch["text"]])})

    return docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text").mapInPandas(run, "doc_id long, digest string, bands array<long>")


def _verify(names: np.ndarray, weights: np.ndarray, side: np.ndarray, texts: list[str], threshold: float, bands: np.ndarray | None = None, band: int = 0) -> pd.DataFrame:
    """node, root, text_links, links of one task. side: 0, or 0 and 1 if only pairs of both sides are asked for. With
    bands, the band hashes by text, only pairs whose first shared band is band are asked for."""
    sets = [np.unique(grams_of(word_hashes(t.encode("utf-8", "surrogatepass")))) for t in texts]
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    both = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        for low in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, (low, low + COLUMNS))
            part = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            both += part @ part.T
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    if side.any():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    if bands is not None:
        a, b = np.nonzero(linked)
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            linked[x, y] = (bands[x] == bands[y]).argmax(axis=1) == band
    root = np.arange(n)
    for i in range(n):  # each unvisited text spreads over what it is linked to
        if root[i] == i and linked[i].any():
            front = np.zeros(n, bool)
            front[i] = True
            seen = front
            while front.any():
                front = linked[front].any(axis=0) & ~seen
                seen = seen | front
            root[seen] = i
    return pd.DataFrame({"node": names, "root": names[root], "text_links": linked.sum(axis=1).astype(np.int64), "links": (linked * weights[None, :]).sum(axis=1).astype(np.int64)})


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """doc_id and digest of every row of docs (doc_id, text), and per digest: class_id, first_id (its own least doc_id), copies,
    has_grams, links (weighted by copies), n_text_links and keeps, true for one digest of each class."""
    ship_texts(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    marks = stored(sketches(docs, bands, rows), "sketches")
    found = marks.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = stored(found.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = stored(keys.groupBy("band", "key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = stored(join_hot(keys, buckets.withColumn("times", F.col("n")), ["band", "key"], "times", keys.count()), "members")
    # A text's buckets are tied through the least of their least members, so ties are between few least members only.
    tied = stored(members.groupBy("node").agg(F.min("least").alias("center"), F.collect_set("least").alias("centers")), "ties")
    edges = tied.select(F.col("center").alias("a"), F.explode("centers").alias("b")).where(F.col("a") != F.col("b")).distinct()
    tie = components(edges)
    parts = stored(tied.select("node", "center").join(tie.withColumnRenamed("node", "center"), "center", "left").select("node", F.coalesce("component", "center").alias("component")), "parts")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    squares = buckets.join(tie.withColumnRenamed("node", "least"), "least", "left").groupBy(F.coalesce("component", "least").alias("component")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    dense = (F.col("n") <= block) | (F.col("n").cast("double") * F.col("n") <= F.col("squares"))
    kinds = stored(sizes.join(squares, "component").select("component", "n", dense.alias("dense")), "component-sizes")
    parts_of = join_hot(parts, kinds.withColumn("times", F.col("n")), ["component"], "times", nodes.count())
    parts_of = stored(parts_of, "part-sizes")
    # A group is a component as a whole (band -1) or a bucket.
    whole = parts_of.where("dense").select("node", F.lit(-1).alias("band"), F.col("component").alias("key"), "n")
    split = members.select("node", "band", "key", "n").join(parts_of.where("not dense").select("node"), "node", "left_semi")
    groups = whole.unionByName(split).select("node", "band", "key", F.ceil(F.col("n") / block).cast("int").alias("m"))
    groups = groups.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    # A task for each pair of chunks (low <= high); a chunk takes part in one task for each chunk of its group.
    tasks = groups.select("node", "band", "key", "chunk", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")).select(
        "node", "band", "key", "m", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    )
    by_band = F.when(F.col("band") >= 0, F.col("bands")).alias("bands")
    wanted = stored(tasks.join(nodes, "node").select("digest", "first_id", "copies", "node", "band", "key", "m", "chunk", "low", "high", by_band), "tasks")
    # One text per digest: of its rows, one with the least doc_id. Texts are shuffled at every size, as the list grows with them.
    texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "doc_id", "text")
    needed = wanted.select("digest", "first_id").distinct()
    picked = texts.join(needed.hint("merge"), (texts["digest"] == needed["digest"]) & texts["doc_id"].eqNullSafe(needed["first_id"]), "left_semi").dropDuplicates(["digest"]).select("digest", "text")
    task_key = ["band", "key", "low", "high"]
    inputs = wanted.join(picked, "digest").select(*task_key, "chunk", "m", "node", "copies", "bands", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(held: list[pd.DataFrame]) -> pd.DataFrame:
            task = pd.concat(held) if len(held) > 1 else held[0]
            band, low, high = (int(task[c].iloc[0]) for c in ("band", "low", "high"))
            side = (task["chunk"].to_numpy() == high).astype(np.int8) if low != high else np.zeros(len(task), np.int8)
            own = np.stack(task["bands"].tolist()) if band >= 0 else None
            out = _verify(task["node"].to_numpy(), task["copies"].to_numpy(), side, task["text"].tolist(), threshold, own, band)
            return out.assign(whole=bool(band < 0 and task["m"].iloc[0] == 1))

        held: list[pd.DataFrame] = []
        last = None
        ready: list[pd.DataFrame] = []
        for batch in batches:
            change = (batch[task_key] != batch[task_key].shift()).any(axis=1).to_numpy()
            cuts = [*np.flatnonzero(change).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.iloc[a:b]
                key = tuple(part[task_key].iloc[0])
                if held and key != last:
                    ready.append(done(held))
                    held = []
                held.append(part)
                last = key
            if ready:
                yield pd.concat(ready)
                ready = []
        if held:
            yield done(held)

    parts_n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(
        inputs.repartition(parts_n, *task_key).sortWithinPartitions(*task_key, "node").mapInPandas(run, "node long, root long, text_links long, links long, whole boolean"), "links"
    )
    # Components of one task have their classes; the chunks of others are tied together by their forests' edges.
    counts = found.groupBy("node").agg(F.sum("text_links").alias("text_links"), F.sum("links").alias("links"), F.max(F.when(F.col("whole"), F.col("root"))).alias("root"))
    wide = found.where(~F.col("whole") & (F.col("node") != F.col("root")))
    if wide.limit(1).count():
        tied = components(wide.select(F.col("node").alias("a"), F.col("root").alias("b")))
        counts = counts.join(tied, "node", "left").select("node", "text_links", "links", F.coalesce("root", "component").alias("root"))
    facts = nodes.select("digest", "node", "first_id", "copies", (F.size("bands") > 0).alias("has_grams")).join(counts, "node", "left")
    facts = facts.withColumn("root", F.coalesce("root", "node"))
    leads = facts.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "node")).alias("lead"))
    named = facts.join(leads, "root").select(
        "digest", F.col("lead.first_id").alias("class_id"), "first_id", "copies", "has_grams", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).cast("long").alias("n_text_links"),
        (F.col("node") == F.col("lead.node")).alias("keeps"),
    )
    named = stored(named, "classes")
    for used in (buckets, members, tied, parts, kinds, parts_of, tie, wanted, found, nodes):
        discard(used)
    return marks.select("doc_id", "digest"), named


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, class_id, n_links (documents it is similar to, copies included) and
    n_text_links (other texts it is similar to)."""
    marks, named = text_classes(docs, threshold, recall, block)
    facts = named.drop("first_id", "keeps").withColumn("times", F.col("copies"))
    return join_hot(marks, facts, ["digest"], "times", marks.count()).select(
        "doc_id",
        F.when(F.col("has_grams"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("has_grams"), F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        "n_text_links",
    )


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs with one row of each class, that of the least doc_id; texts without n-grams all stay."""
    marks, named = text_classes(docs.select("doc_id", "text"), threshold, recall, block)
    discard(marks)
    digest, first_id = fresh(docs.columns, "digest", "first_id")
    kept = named.where(F.col("keeps") & F.col("has_grams")).select(F.col("digest").alias(digest), F.col("first_id").alias(first_id))
    has_words = F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    rows = docs.where(has_words).withColumn(digest, F.md5("text"))
    # By text and doc_id, so that the copies of a text don't meet; rows equal in both are one row.
    picked = rows.join(kept.hint("merge"), (rows[digest] == kept[digest]) & F.col("doc_id").eqNullSafe(F.col(first_id)), "left_semi").dropDuplicates([digest])
    return docs.where(~has_words).unionByName(picked.select(docs.columns))


#: The same over a view documents: every pair that shares an n-gram, and classes by reachability.
NEARDUP_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, md5(array_to_string(w[i:i + {GRAM - 1}], ' ')) AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - {GRAM - 2}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE c >= {THRESHOLD} * (nx.n + ny.n - c) - 1e-6),
reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
class AS (SELECT x, min(doc_id) AS class_id FROM reach JOIN d ON d.r = y GROUP BY x),
links AS (SELECT x, count(*) AS n_links, count(DISTINCT CASE WHEN a.t <> b.t THEN b.t END) AS n_text_links FROM l JOIN d a ON a.r = x JOIN d b ON b.r = y GROUP BY x)
SELECT d.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_text_links, 0) AS BIGINT) AS n_text_links
FROM d JOIN class ON class.x = d.r LEFT JOIN links ON links.x = d.r"""
