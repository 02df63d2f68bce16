"""Toxicity: a logistic regression over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (ORDERS) of a text's lower-case characters, runs of white space as one space and a
space at either end. Counted over the training texts, those whose shares of texts differ surely between the labels (by the
root of the likelihood ratio statistic) are kept, at most MAX_FEATURES of the surest; a present feature has its log-count
ratio as value. Weights minimise
the regularised logistic loss on the driver, over a bounded sample: at most MAX_TRAIN texts of either label, taken in the
order of a seeded hash of doc_id. The intercept is moved from the sample's share of label 1 to that of all training labels.

Labels are learnt only from rows whose crc32(doc_id) modulo 4 is not HELD_OUT. A null text counts as empty; empty texts
score by the intercept. Without usable labels of both kinds every score is the share of label 1, or 0. Repeated labels of
a document count once, by the larger; null labels don't count. Other columns of the input play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, ship_texts, stored
from .wordhash import mix64

ORDERS = (4, 5, 6, 7)
HELD_OUT, THRESHOLD = 2, 0.3
MAX_TRAIN, MAX_FEATURES, MIN_COUNT, MIN_ROOT, SEED = 4000, 4096, 4, 4.5, 11
SMOOTHING, PENALTY, STEPS = 1.0, 1e-3, 300
#: Characters handled at a time.
CHUNK = 1 << 19
_SPACES = re.compile(r"\s+")


@dataclass(frozen=True)
class Model:
    """hashes: of the features, sorted; weights: what each adds to the log odds."""

    hashes: np.ndarray
    weights: np.ndarray
    intercept: float


def normal(text: str | None) -> str:
    return " " + _SPACES.sub(" ", (text or "").lower()).strip() + " "


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    h = np.full(max(len(codes) - order + 1, 0), order, np.uint64)
    for k in range(order):
        h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - order + 1 + k]
    return mix64(h)


def _chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of joined texts and where each one's place in texts; a zero parts neighbours. Long texts come in parts that overlap."""
    held: list[tuple[int, str]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("\0".join(t for _, t in held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat([i for i, _ in held], [len(t) + 1 for _, t in held])[: len(codes)]
        return codes, owner

    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK + max(ORDERS) - 1]
            if held and size + len(part) > CHUNK:
                yield flush()
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield flush()


def distinct_grams(texts: list[str]) -> Iterator[np.ndarray]:
    """N-grams of texts, each as often as texts hold it. A text of several chunks is counted by itself, over all of them."""
    short = [t for t in texts if len(t) <= CHUNK]
    for _, grams in _pairs(short):
        yield grams
    for text in texts:
        if len(text) > CHUNK:
            yield np.unique(np.concatenate([np.unique(grams) for _, grams in _pairs([text])]))


def _pairs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, n-gram) pairs, each pair once within a chunk."""
    for codes, owner in _chunks(texts):
        for order in ORDERS:
            h = _grams(codes, order)
            place = owner[: len(h)]
            whole = (place == owner[order - 1 : order - 1 + len(h)]) & (np.lib.stride_tricks.sliding_window_view(codes, order).min(axis=1) > 0) if len(h) else np.zeros(0, bool)
            place, h = place[whole], h[whole]
            # One 64-bit value a pair: equal pairs agree in it.
            _, first = np.unique(h ^ mix64(place.astype(np.uint64) + np.uint64(1)), return_index=True)
            yield place[first], h[first]


class Lookup:
    """Finds features among n-grams by a table over hash prefixes, then by the sorted hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.marked = np.zeros(1 << 20, bool)
        self.marked[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (place of the text, feature) pairs."""
        places, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for codes, owner in _chunks(texts):
            for order in ORDERS:
                h = _grams(codes, order)
                near = np.flatnonzero(self.marked[(h >> np.uint64(44)).astype(np.int64)])
                at = np.searchsorted(self.hashes, h[near])
                hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[near]
                near, at = near[hit], at[hit]
                whole = owner[near] == owner[near + order - 1]
                places.append(owner[near[whole]].astype(np.int64))
                features.append(at[whole])
        both = np.unique(np.concatenate(places) * np.int64(len(self.hashes) + 1) + np.concatenate(features))
        return both // (len(self.hashes) + 1), both % (len(self.hashes) + 1)


def _counts(sample: DataFrame) -> DataFrame:
    """gram, n0, n1: texts of either label that hold it; counted up within each batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label in (0, 1):
                texts = [normal(t) for t in batch["text"][batch["toxic"] == label]]
                for grams in distinct_grams(texts):
                    kinds, n = np.unique(grams, return_counts=True)
                    yield pd.DataFrame({"gram": kinds.view(np.int64), "n0": n * (label == 0), "n1": n * (label == 1)})

    return sample.select("text", "toxic").mapInPandas(run, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit_weights(rows: np.ndarray, features: np.ndarray, values: np.ndarray, labels: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the regularised logistic loss, by accelerated gradient steps. values: of each feature."""
    n = len(labels)
    v = values[features]
    size = np.bincount(rows, weights=v * v, minlength=n)
    rate = 1.0 / (0.25 * (size.mean() + 3 * size.std() + 1) + penalty)
    w, b = np.zeros(len(values)), 0.0
    wm, bm = w, b
    for step in range(steps):
        odds = np.bincount(rows, weights=v * wm[features], minlength=n) + bm
        gap = 1 / (1 + np.exp(-odds)) - labels
        w_next = wm - rate * (np.bincount(features, weights=v * gap[rows], minlength=len(values)) / n + penalty * wm)
        b_next = bm - rate * gap.mean()
        speed = step / (step + 3)
        wm, bm = w_next + speed * (w_next - w), b_next + speed * (b_next - b)
        w, b = w_next, b_next
    return w, b


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labels that may be learnt from."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, seed: int = SEED) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    ship_texts(docs.sparkSession)
    known = training_labels(labels)
    share = known.agg(F.avg("toxic")).first()[0]
    none = np.zeros(0, np.uint64), np.zeros(0)
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id")))
    picked = [known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(max_train) for label in (0, 1)]
    # At most 2 * max_train rows: bounded by the parameter. Of several texts of a document the least counts.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = stored(texts, "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not share or share == 1 or len(sizes) < 2:
        p = min(max(share or 0.0, 1e-6), 1 - 1e-6)
        return Model(*none, float(np.log(p / (1 - p))) if share else -50.0)
    p, q = (F.col(f"n{k}") + SMOOTHING for k in (1, 0))
    ratio = F.log(p / (sizes[1] + 2 * SMOOTHING)) - F.log(q / (sizes[0] + 2 * SMOOTHING))
    both = sizes[0] + sizes[1]
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    held = F.col("n0") + F.col("n1")
    statistic = sum((part(F.col(f"n{k}"), held * sizes[k] / both) + part(sizes[k] - F.col(f"n{k}"), (both - held) * sizes[k] / both) for k in (0, 1)), F.lit(0.0))
    counted = _counts(sample).where(F.col("n0") + F.col("n1") >= MIN_COUNT).withColumns({"ratio": ratio, "root": F.sqrt(F.greatest(2 * statistic, F.lit(0.0)))})
    surest = counted.where(F.col("root") >= MIN_ROOT).orderBy(F.desc("root"), "gram").limit(max_features).select("gram", "ratio").toPandas()
    if surest.empty:
        discard(sample)
        return Model(*none, float(np.log(share / (1 - share))))
    hashes = surest["gram"].to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    hashes, ratios = hashes[by_hash], surest["ratio"].to_numpy()[by_hash]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = Lookup(hashes)
        for batch in batches:
            places, found = lookup.pairs([normal(t) for t in batch["text"]])
            ends = np.searchsorted(places, np.arange(len(batch) + 1))
            yield pd.DataFrame({"toxic": batch["toxic"], "found": [found[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:], strict=False)]})

    held = sample.select("doc_id", "text", "toxic").mapInPandas(run, "toxic int, found binary").toPandas()
    lists = [np.frombuffer(x, np.int32) for x in held["found"]]
    labels_of = held["toxic"].to_numpy(float)
    w, b = fit_weights(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists), ratios, labels_of)
    sampled = labels_of.mean()
    shift = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    discard(sample)
    return Model(hashes, w * ratios, float(b + shift))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs (with text) with score and predicted under names, row for row; columns of the input that are called so are replaced."""
    ship_texts(docs.sparkSession)
    docs = docs.drop(*names)

    @F.pandas_udf("score double, predicted int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookup = Lookup(model.hashes) if len(model.hashes) else None
        for texts in batches:
            odds = np.full(len(texts), model.intercept)
            if lookup:
                for at in range(0, len(texts), 512):
                    part = [normal(t) for t in texts.iloc[at : at + 512]]
                    places, found = lookup.pairs(part)
                    odds[at : at + len(part)] += np.bincount(places, weights=model.weights[found], minlength=len(part))
            p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pd.DataFrame({"score": p, "predicted": (p >= threshold).astype(np.int32)})

    both = fresh(docs.columns, "toxic")[0]
    out = docs.withColumn(both, scored(F.col("text")))
    return out.select(*docs.columns, F.col(f"{both}.score").alias(names[0]), F.col(f"{both}.predicted").alias(names[1]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
