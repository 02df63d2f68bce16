r"""Substring dedup by De Bruijn compaction: words covered by a repeated window of WINDOW words are removed.

Words are `[^\x20\x09-\x0D]+`, unchanged. Every window is an edge of a De Bruijn graph between its first and last
WINDOW - 1 words. As only repeated edges matter, edges are not shuffled one by one: an edge belongs to the least of the
hashes of its KMER-word k-mers, equal edges belong to equal keys, and a text's consecutive edges of one key form a run.
Texts first send just their keys; only runs of keys that occur twice send their edges. A run whose whole content
recurs is a repeated stretch of graph; such runs are joined to their followers, and where a run has one follower and
that one predecessor, nonbranching paths are compacted by pointer jumping through joins. A path's place in a
text then follows from the run's place in the path, and spans are verified as gapless in source coordinates. Runs that
recur in part, at the ends of repeated passages, are compared edge by edge.

Edges compare by 64-bit hashes within equal 64-bit keys. Equal texts are one text: if it has a window it goes as a
whole. A null text has no words. Repeated rows are copies, so each goes. Texts shorter than a window stay as they are.
Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, join_hot, ship, stored
from .wordhash import U, batched, gram_hashes, mix64, sliding_min

WINDOW, KMER = 35, 16


class Runs:
    """The runs of one text: key, first edge and edges of each."""

    def __init__(self, words: np.ndarray, window: int, kmer: int) -> None:
        self.edges = gram_hashes(words, window)
        keys = sliding_min(mix64(gram_hashes(words, kmer) ^ U(kmer)), window - kmer + 1)[: len(self.edges)]
        self.starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[self.starts]
        self.ends = np.append(self.starts[1:], len(keys))

    def inner_repeats(self) -> np.ndarray:
        """Whether a run holds an edge twice, at any distance: a key goes on as long as its k-mer comes back soon enough."""
        twice = np.zeros(len(self.starts), bool)
        in_order = np.sort(self.edges)
        if (in_order[1:] == in_order[:-1]).any():
            run = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
            by = np.lexsort((self.edges, run))
            edge, run = self.edges[by], run[by]
            twice[run[1:][(edge[1:] == edge[:-1]) & (run[1:] == run[:-1])]] = True
        return twice


def _runs(texts: list[str | None], window: int, kmer: int) -> Iterator[tuple[int, int, Runs]]:
    """(place, number of words, runs) of every text."""
    for places, hashes, at in batched([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        for k, place in enumerate(places):
            words = hashes[at[k] : at[k + 1]]
            yield place, len(words), Runs(words, window, kmer)


def _kept_hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def text_keys(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, digest, n_words, full_sha256 of all words, keys of the text's runs and those (twice) that recur within it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            n, keys, twice = [0] * len(texts), [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
            for place, count, runs in _runs(texts, window, kmer):
                kinds, first, times = np.unique(runs.keys, return_index=True, return_counts=True)
                inner = np.unique(runs.keys[runs.inner_repeats()])
                n[place], keys[place] = count, kinds.view(np.int64)
                twice[place] = np.union1d(kinds[times > 1], inner).view(np.int64)
            shas = [_kept_hash(t.encode("utf-8", "surrogatepass").split()) for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "n_words": n, "full_sha256": shas, "keys": keys, "twice": twice})

    ship(docs.sparkSession)
    some = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    return some.mapInPandas(run, "doc_id long, digest string, n_words long, full_sha256 string, keys array<long>, twice array<long>")


def key_runs(texts: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """texts: node, text, wanted keys. Its runs of those keys: key, node, start, n, content (hash of the edges), inner, edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, wanted = batch["node"].to_numpy(), batch["wanted"].tolist()
            for at in range(0, len(batch), 200):
                rows = []
                for place, _, runs in _runs(batch["text"].iloc[at : at + 200].tolist(), window, kmer):
                    mine = np.isin(runs.keys, np.asarray(wanted[at + place]).view(U))
                    inner = runs.inner_repeats()
                    for r in np.flatnonzero(mine).tolist():
                        edges = runs.edges[runs.starts[r] : runs.ends[r]]
                        place_mix = mix64(edges + np.arange(1, len(edges) + 1, dtype=U) * U(0x9E3779B97F4A7C15))
                        rows.append((runs.keys[r].view(np.int64), nodes[at + place], int(runs.starts[r]), len(edges), int(place_mix.sum(dtype=U).view(np.int64)), bool(inner[r]), edges.view(np.int64)))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "node", "start", "n", "content", "inner", "edges"])

    return texts.select("node", "text", "wanted").mapInPandas(run, "key long, node long, start int, n int, content long, inner boolean, edges array<long>")


def compacted(runs: DataFrame) -> DataFrame:
    """kind, path (the kind of its first run), offset in edges from there and times, for the kinds of runs (node, start, n, kind).

    A kind follows another if it begins where that one ends in some text. Links that neither fork nor join are followed
    back along every text first, then from text to text by pointer jumping, one join a round over what still moves. Jumps
    double, so after as many rounds as the number of kinds has binary digits only circles still move, and nothing else
    leads into or out of those. A circle has no first run, so each of its kinds stands for itself.
    """
    by = Window.partitionBy("node").orderBy("start")
    near = runs.select("kind", "node", "start", F.lag("kind").over(by).alias("above"), F.lag(F.col("start") + F.col("n")).over(by).alias("above_end"))
    near = near.withColumn("follows", F.coalesce((F.col("above_end") == F.col("start")) & (F.col("above") != F.col("kind")), F.lit(False)))
    links = near.where("follows").select("above", "kind").distinct()
    forks = links.groupBy("above").agg(F.count(F.lit(1)).alias("out"), F.first("kind").alias("kind")).where("out = 1")
    joins = links.groupBy("kind").agg(F.count(F.lit(1)).alias("in")).where("in = 1")
    times = stored(runs.groupBy("kind").agg(F.count(F.lit(1)).alias("times")), "kinds")
    single = forks.join(joins, "kind").join(times, "kind").select("kind", F.lit(True).alias("single"), "times")
    # Along each text, a stretch of such links begins at its first run; of all texts, the one that reaches back farthest counts.
    total = times.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count(F.lit(1))).first()
    marked = join_hot(near, stored(single, "kinds-single"), ["kind"], "times", total[0], "left").withColumn("stretch", F.sum(F.when(F.col("follows") & F.col("single"), 0).otherwise(1)).over(by))
    within = Window.partitionBy("node", "stretch").orderBy("start")
    reach = marked.select("kind", F.first("kind").over(within).alias("above"), (F.col("start") - F.first("start").over(within)).cast("long").alias("offset"))
    reach = reach.groupBy("kind").agg(F.max(F.struct("offset", "above")).alias("r")).select("kind", "r.above", F.when(F.col("r.above") == F.col("kind"), F.lit(0).cast("long")).otherwise(F.col("r.offset")).alias("offset"))
    moving = stored(reach, "paths")
    written, settled = [moving], []
    for _ in range(total[1].bit_length() + 1):
        every = moving
        for done in settled:
            every = every.unionByName(done)
        up = every.select(F.col("kind").alias("above"), F.col("above").alias("higher"), F.col("offset").alias("more"))
        then = stored(moving.join(up, "above").select("kind", F.col("higher").alias("above"), (F.col("offset") + F.col("more")).alias("offset"), (F.col("higher") != F.col("above")).alias("moved")), "paths")
        written.append(then)
        settled.append(then.where("not moved").drop("moved"))
        moving = then.where("moved").drop("moved")
        if not moving.limit(1).count():
            break
    found = moving.select("kind", F.col("kind").alias("above"), F.lit(0).cast("long").alias("offset"))
    for done in settled:
        found = found.unionByName(done)
    out = stored(found.select("kind", F.col("above").alias("path"), "offset").join(times, "kind"), "paths")
    for used in (*written, times):
        discard(used)
    return out


def repeated_spans(runs: DataFrame) -> DataFrame:
    """node, start, n: the repeated edges of every text, as spans. runs: of key_runs(), all runs of each of its keys."""
    light = runs.select("key", "content", "node", "start", "n", "inner")
    same = stored(light.groupBy("key", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("node", "start")).alias("first"), F.max("inner").alias("inner")), "runs-same")
    # Whole runs that recur: compacted to paths, then to spans.
    again = same.where("times > 1").select("key", "content", "times")
    whole = join_hot(light.drop("inner"), again, ["key", "content"], "times", runs.count()).select(F.xxhash64("key", "content").alias("kind"), "node", "start", "n")
    whole = stored(whole, "runs-whole")
    paths = compacted(whole)
    placed = join_hot(whole, paths, ["kind"], "times", whole.count()).withColumn("begin", F.col("start") - F.col("offset"))
    spans = placed.groupBy("node", "path", "begin").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.sum("n").alias("n"), F.collect_list(F.struct("start", "n")).alias("parts"))
    # In source coordinates a path's runs must lie end to end; those that don't stand for themselves.
    gapless = F.col("end") - F.col("start") == F.col("n")
    spans = spans.select("node", F.explode(F.when(gapless, F.array(F.struct("start", F.col("n").cast("int").alias("n")))).otherwise(F.col("parts"))).alias("s")).select("node", "s.start", "s.n")
    # Runs that occur once may share edges with other runs of their key, or hold one twice.
    mixed = same.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least"), F.max("inner").alias("inner")).where("(kinds > 1 and least = 1) or inner").select("key", "kinds")
    parts = join_hot(same, stored(mixed, "runs-mixed-keys"), ["key"], "kinds", same.count()).select("key", "first.node", "first.start", "times")
    edges = stored(runs.select("key", "node", "start", "edges").join(parts, ["key", "node", "start"]).select("key", "node", "start", "times", "edges"), "runs-mixed")
    single = edges.select("key", "times", F.explode("edges").alias("edge"))
    again = stored(single.groupBy("key", "edge").agg(F.sum("times").alias("times")).where("times > 1"), "edges-again")
    alone = edges.where("times = 1").select("key", "node", "start", F.posexplode("edges").alias("place", "edge"))
    total = again.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    found = join_hot(alone, again, ["key", "edge"], "times", total).select("node", (F.col("start") + F.col("place")).alias("start"), F.lit(1).alias("n"))
    return spans.unionByName(found)


def _without(texts: DataFrame, window: int) -> DataFrame:
    """texts: digest, text, spans. digest, n_removed, kept_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, text, spans in zip(batch["digest"], batch["text"], batch["spans"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                change = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    change[s["start"]] += 1
                    change[s["start"] + s["n"] + window - 1] -= 1
                gone = np.cumsum(change)[:-1] > 0
                rows.append((digest, int(gone.sum()), _kept_hash([words[i] for i in np.flatnonzero(~gone).tolist()])))
            yield pd.DataFrame(rows, columns=["digest", "n_removed", "kept_sha256"])

    return texts.select("digest", "text", "spans").mapInPandas(run, "digest string, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256."""
    marks = stored(text_keys(docs, window, kmer), "substrings")
    texts = marks.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"), F.first("twice").alias("twice"))
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "substring-texts")
    keys = texts.select("node", F.explode("keys").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "substring-keys")
    wanted = join_hot(keys, shared, ["key"], "n", keys.count()).unionByName(texts.select("node", F.explode("twice").alias("key")))
    wanted = texts.select("node", "digest", "first_id", "copies").join(wanted.groupBy("node").agg(F.collect_set("key").alias("wanted")), "node")
    # One text per digest, with the keys that it shares: of its rows, one with the least doc_id, so that copies don't meet.
    some = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("d"), "doc_id", "text")
    picked = some.join(wanted.hint("merge"), (F.col("d") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["digest"])
    held = stored(picked.select("digest", "node", "copies", "text", "wanted"), "substring-held")
    runs = stored(key_runs(held, window, kmer), "substring-runs")
    spans = repeated_spans(runs).groupBy("node").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    changed = stored(_without(held.where("copies = 1").select("node", "digest", "text").join(spans, "node"), window), "substring-kept")
    for used in (runs, held, shared):
        discard(used)
    none = F.lit(None)
    facts = changed.select("digest", "n_removed", "kept_sha256", F.lit(False).alias("copied"), F.lit(1).cast("long").alias("times")).unionByName(
        texts.where("copies > 1").select("digest", none.cast("long").alias("n_removed"), none.cast("string").alias("kept_sha256"), F.lit(True).alias("copied"), F.col("copies").alias("times"))
    )
    out = join_hot(marks.select("doc_id", "digest", "n_words", "full_sha256"), stored(facts, "substring-facts"), ["digest"], "times", marks.count(), "left")
    all_gone = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= window)
    return out.select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "full_sha256")).alias("kept_sha256"),
    )


#: The same over a view documents: every window counted, every word of a repeated one marked.
SUBSTRINGS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
again AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM x JOIN again USING (g))),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r) LEFT JOIN lost USING (r)"""
