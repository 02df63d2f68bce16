"""The classifier and the packing against plain versions of themselves."""

import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import packing, toxicity


def naive_best_fit(sizes, capacity):
    """Free space of each bin: every size, largest first, goes where it leaves least."""
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [f for f in free if f >= s]
        if fits:
            free[free.index(min(fits))] -= s
        else:
            free.append(capacity - s)
    return sorted(free)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.choice([rng.randint(1, 1024), rng.randint(1, 40), 512, 1024]) for _ in range(400)])
    bins = packing.best_fit(sizes)
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert sorted(1024 - int(sizes[b].sum()) for b in bins) == naive_best_fit(sizes.tolist(), 1024)


def test_merged_packing_against_one_best_fit(spark):
    rng = random.Random(11)
    sizes = [min(1023, int(rng.lognormvariate(5, 1)) + 1) for _ in range(4000)] + [600] * 900  # a third of all of one length
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    best = len(naive_best_fit(sizes, 1024))
    assert packing.pack(pieces).select("sequence_id").distinct().count() == best
    rows = packing.pack(pieces, block=500, fan_in=4).toPandas()
    assert sorted(rows["doc_id"]) == list(range(len(sizes)))
    assert rows["sequence_id"].nunique() <= 1.02 * best + 1


def grams_of(text):
    t = toxicity.normal(text)
    return {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}


def hash_of(gram):
    return int(toxicity._grams(np.array([ord(c) for c in gram], np.uint64), len(gram))[0])


def root(n0, n1, t0, t1):
    """Of the likelihood ratio statistic of a 2 by 2 table."""
    held, total = n0 + n1, t0 + t1
    cells = [(n0, held * t0 / total), (n1, held * t1 / total), (t0 - n0, (total - held) * t0 / total), (t1 - n1, (total - held) * t1 / total)]
    return max(2 * sum(seen * np.log(seen / expected) for seen, expected in cells if seen), 0) ** 0.5


def test_classifier(spark, docs_of):
    rng = random.Random(5)
    calm, rude = "river stone cloud meadow paper window Straße".split(), "idiot moron scum".split()
    texts, toxic = [], []
    for i in range(200):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 25))]
        toxic.append(int(i % 4 == 0))
        if toxic[-1] or i % 19 == 0:  # some clean texts hold a rude word too
            words[rng.randrange(len(words))] = rng.choice(rude)
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = toxicity.train(docs_of(texts), labels)

    used = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    sets = [grams_of(t) for t in texts]
    t1 = sum(toxic[i] for i in used)
    t0 = len(used) - t1
    chosen = {}
    for g in set().union(*(sets[i] for i in used)):
        n1 = sum(toxic[i] for i in used if g in sets[i])
        n0 = sum(g in sets[i] for i in used) - n1
        if n0 + n1 >= toxicity.MIN_COUNT and root(n0, n1, t0, t1) >= toxicity.MIN_ROOT:
            chosen[g] = np.log((n1 + 1) / (t1 + 2)) - np.log((n0 + 1) / (t0 + 2))
    assert chosen and sorted(hash_of(g) for g in chosen) == model.hashes.tolist()

    # Scores are the sum of the weights of what a text holds.
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    odds = [model.intercept + sum(weight[hash_of(g)] for g in s & chosen.keys()) for s in sets]
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(texts), model).collect()}
    assert [scored[i] for i in range(200)] == pytest.approx((1 / (1 + np.exp(-np.array(odds)))).tolist())

    # The weights come near the least loss, which Newton's steps find.
    names = sorted(chosen, key=hash_of)
    x = np.array([[chosen[g] * (g in sets[i]) for g in names] + [1.0] for i in used])
    y = np.array([toxic[i] for i in used], float)
    ridge = np.diag([toxicity.PENALTY] * len(names) + [0.0])
    loss = lambda w: np.mean(np.logaddexp(0, x @ w) - y * (x @ w)) + w @ ridge @ w / 2
    best = np.zeros(len(names) + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ best))
        best -= np.linalg.solve(x.T * (p * (1 - p)) @ x / len(y) + ridge + 1e-12 * np.eye(len(best)), x.T @ (p - y) / len(y) + ridge @ best)
    # The sample holds all training labels, so the intercept isn't moved.
    got = np.array([weight[hash_of(g)] / chosen[g] for g in names] + [model.intercept])
    assert loss(best) <= loss(got) <= loss(best) + 0.01
