"""Near duplicates, repeated passages, toxicity and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftgraph.llm import neardup, packing, substrings, toxicity
from weftgraph.llm.wordhash import gram_hashes, sliding_min, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(t):
    return WORD.findall(t or "")


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    base, passage = text(120), text(50)
    near = []
    for _ in range(9):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    mixed = [text(40) + " " + passage + " " + text(30) for _ in range(4)]
    return [None, "", " \n", "a b", "a b", "a  b", base, base, *near, *mixed, text(200), "z " * 90, passage, text(34), "x y " * 30 + text(10)]


def near_by_force(texts, ids):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = defaultdict(set)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(i)
    return Counter((ids[i], min(ids[k] for k in g), len(links[i]), len({texts[k] for k in links[i]} - {texts[i]})) for g in groups.values() for i in g)


@pytest.mark.parametrize("block", [400, 4])
def test_near_duplicates(docs_of, block):
    texts = corpus(1)
    got = Counter(tuple(r) for r in neardup.near_duplicates(docs_of(texts, 100, extra=True), block=block).select("doc_id", "class_id", "n_links", "n_text_links").collect())
    assert got == near_by_force(texts, range(100, 100 + len(texts)))


def test_near_duplicates_in_a_chain(docs_of, monkeypatch):
    """Windows over one long text: neighbours share bands though they aren't similar, so they chain; near copies lie among them."""
    rng = random.Random(4)
    words = [f"c{rng.randint(0, 10**6)}" for _ in range(1200)]
    texts = [" ".join(words[i : i + 80]) for i in range(0, 1100, 20)]
    for k in (3, 3, 9, 20):
        w = texts[k].split()
        w[rng.randrange(80)] = f"edit{rng.randint(0, 99)}"
        texts.append(" ".join(w))
    want = near_by_force(texts, range(len(texts)))
    assert sum(r[2] for r in want) == 8  # four pairs, among windows of which neighbours only share 0.58
    whole = []
    plain = neardup.components
    monkeypatch.setattr(neardup, "components", lambda edges: whole.append(1) or plain(edges))
    for block in (400, 8):
        assert Counter(tuple(r) for r in neardup.near_duplicates(docs_of(texts), block=block).collect()) == want
    assert len(whole) == 3  # with blocks of 8 the chain is verified by buckets, whose forests are tied together


def test_near_duplicates_kept(docs_of):
    docs = docs_of(corpus(1), 100)
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    classes = {r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_banding_reaches_its_recall():
    b, r = neardup.banding()
    assert 1 - (1 - 0.8**r) ** b >= neardup.RECALL
    assert b * r <= neardup.MAX_HASHES


def substrings_by_force(texts, ids, window=35):
    ws = [words_of(t) for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = Counter()
    for d, w in zip(ids, ws, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    return out


def test_substrings(docs_of):
    texts = corpus(2)
    got = Counter(tuple(r) for r in substrings.substring_dedup(docs_of(texts, extra=True)).collect())
    assert got == substrings_by_force(texts, range(len(texts)))
    assert substrings.substring_dedup(docs_of(texts).limit(0)).count() == 0


def periodic(seed):
    rng = random.Random(seed)
    words = lambda tag, n: [f"{tag}{seed}_{rng.randint(0, 10**9)}" for _ in range(n)]
    # A sentence of p words repeated on its own, at a distance of p from 1 to beyond the window, each in a text of its own.
    yield from (" ".join([*words("a", 7), *words("s", p) * times, *words("z", 5)]) for p in (1, 5, 19, 20, 21, 25, 34, 35, 40) for times in (2, 3, 4))
    # Rows of a table with a field that changes in turn or in cycles: runs of one key with equal edges rows apart.
    for width, cycle in ((10, 2), (18, 2), (19, 2), (9, 3), (7, 5), (12, 4)):
        row, field = words("r", width), words("f", cycle)
        yield " ".join(w for i in range(4 * cycle + 3) for w in [*row, field[i % cycle]])


def test_substrings_in_circles(docs_of, monkeypatch):
    """Passages that follow each other in a circle, A B, B C and C A, besides long ones that don't."""
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"p{rng.randint(0, 10**9)}" for _ in range(60)) for _ in range(4))
    long = " ".join(f"q{rng.randint(0, 10**9)}" for _ in range(2000))
    texts = [f"{a} {b}", f"{b} {c}", f"{c} {a}", f"x {d} y", f"u {d} v {d}", long + " one", "two " + long]
    written, seen = [], []
    plain, jumps = substrings.stored, substrings.compacted
    monkeypatch.setattr(substrings, "stored", lambda df, name: written.append(name) or plain(df, name))
    monkeypatch.setattr(substrings, "compacted", lambda runs: seen.append(jumps(runs)) or seen[-1])
    got = Counter(tuple(r) for r in substrings.substring_dedup(docs_of(texts)).collect())
    assert got == substrings_by_force(texts, range(len(texts)))
    assert written.count("paths") <= 12
    longest = seen[0].groupBy("path").count().agg({"count": "max"}).first()[0]
    assert longest > 50  # the long text's path is whole though there are circles


def test_substrings_within_a_run(docs_of):
    texts = list(periodic(3))
    got = Counter(tuple(r) for r in substrings.substring_dedup(docs_of(texts)).collect())
    assert got == substrings_by_force(texts, range(len(texts)))
    sentence = " ".join(f"only{i}" for i in range(20))
    got = substrings.substring_dedup(docs_of([" ".join([sentence] * 3)])).first()
    assert (got["n_words"], got["n_removed"]) == (60, 60)


def test_word_hashes():
    rng = random.Random(5)
    for n in (1, 2, 5, 35):
        seen = {}
        for _ in range(40):
            t = "".join(rng.choice(["a", "bb", "é", " ", "  ", "\n"]) for _ in range(150))
            w = words_of(t)
            h = word_hashes(t.encode())
            assert len(h) == len(w)
            for i, g in enumerate(gram_hashes(h, n)):
                assert seen.setdefault(tuple(w[i : i + n]), g) == g
        assert len(set(seen.values())) == len(seen)
    x = np.array([rng.random() for _ in range(50)])
    assert sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(44)]


def test_long_words_and_segments(monkeypatch):
    from weftgraph.llm import wordhash

    text = (b"ab " * 50 + b"c" * 300 + b" d\n") * 20
    whole = word_hashes(text)
    monkeypatch.setattr(wordhash, "SEGMENT", 64)
    assert word_hashes(text).tolist() == whole.tolist()


def test_toxicity(spark, docs_of):
    rng = random.Random(3)
    calm, rude = ["river", "stone", "cloud", "meadow", "paper", "window"], ["idiot", "moron", "scum"]
    texts, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        w = [rng.choice(calm) for _ in range(30)]
        if toxic:
            w[rng.randrange(30)] = rng.choice(rude)
            w[rng.randrange(30)] = rng.choice(rude)
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    texts += [None, "", "x" * 600_000 + " idiot moron"]
    labels_df = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = docs_of(texts, extra=True)
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels_df).collect()}
    assert len(rows) == len(texts)
    for i, toxic in labels:
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert rows[i]["predicted"] == toxic
    assert rows[240]["score"] == rows[241]["score"] < 0.3
    assert rows[242]["predicted"] == 1
    assert toxicity.toxicity_scores(docs.limit(0), labels_df).count() == 0
    none = toxicity.toxicity_scores(docs, labels_df.limit(0))
    assert {r["predicted"] for r in none.collect()} == {0}


def test_toxicity_learns_from_no_held_out_label(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    used = {r["doc_id"] for r in toxicity.training_labels(labels).collect()}
    assert used == {i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_packing(docs_of):
    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(6)
    texts = [None, "", "x " * 3000, "a\n\n  b <|endoftext|> c", "日本 é", *[" ".join(rng.choice(["alpha", "beta,", "gamma.\nNow", "δ", "12"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]]
    rows = packing.pack_documents(docs_of(texts, extra=True)).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, part in rows.groupby("doc_id"):
        ids = plain.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        part = part.sort_values("piece")
        assert part["length"].sum() == len(ids) and (part["length"].iloc[1:] == 1024).all()
        assert part["start"].tolist() == (part["length"].cumsum() - part["length"]).tolist()
        for r in part.itertuples():
            assert zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    by = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert by["length"].sum().max() <= 1024
    assert (by["length"].cumsum() - rows.sort_values(["sequence_id", "offset"])["length"] == rows.sort_values(["sequence_id", "offset"])["offset"]).all()
    assert rows["sequence_id"].nunique() <= int(np.ceil(rows["length"].sum() / 1024)) + 1
    assert packing.pack_documents(docs_of(texts).limit(0)).count() == 0


def test_packing_in_many_rounds(spark):
    rng = random.Random(7)
    pieces = spark.createDataFrame([(i, 0, 0, rng.randint(1, 900), i) for i in range(600)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, block=40, fan_in=2).toPandas()
    assert sorted(rows["doc_id"]) == list(range(600))
    assert rows.groupby("sequence_id")["length"].sum().max() <= 1024
    assert rows["sequence_id"].nunique() <= 1.1 * rows["length"].sum() / 1024 + 1  # blocks of 40 pieces fill less well
    whole = packing.pack(pieces).toPandas()
    assert whole["sequence_id"].nunique() <= 1.02 * rows["length"].sum() / 1024 + 1


def test_cached_ids_equal_plain_ids():
    tokenizer = packing.tokenizer_of()
    rng = random.Random(8)
    for _ in range(1500):
        t = "".join(rng.choice(["a", "é", " ", "\n", "  ", "'s", "12", ".", "\t", "<|endoftext|>", "日本", " b", "\x1c", "　"]) for _ in range(rng.randint(0, 20)))
        assert np.frombuffer(tokenizer.encode([t])[0], "<u4").tolist() == tokenizer.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_forgets_with_its_task(spark, docs_of):
    import pandas as pd

    tokenizer = packing.tokenizer_of()
    tokenizer.encode(["a word, word. word; an odd-word"])
    assert "word" in tokenizer.chunks and " word" not in tokenizer.parts  # no word is kept twice
    tokenizer.forget()
    assert not (tokenizer.chunks or tokenizer.parts or tokenizer.chunks.older or tokenizer.parts.older)
    assert packing.token_pieces(docs_of([f"some words, number{i} and-so on" for i in range(400)])).count() == 400

    def held(batches):
        for _ in batches:
            yield pd.DataFrame({"n": [sum(len(c) + len(c.older) for t in packing._tokenizers.values() for c in (t.chunks, t.parts))]})

    assert spark.range(0, 400, 1, 8).mapInPandas(held, "n long").agg({"n": "max"}).first()[0] == 0


def test_texts_go_to_python_in_small_batches(spark, docs_of):
    import pandas as pd

    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", docs_of(["one text"])
    before = spark.conf.get(key)
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    try:
        for f in (neardup.near_duplicates, packing.token_pieces, packing.pack_documents, lambda d: toxicity.score(d, model)):
            for usual in ("10000", "0"):
                spark.conf.set(key, usual)
                f(docs)
                most = spark.range(0, 5000, 1, 1).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").agg({"n": "max"}).first()[0]
                assert most <= 1024
        spark.conf.set(key, "100")
        packing.token_pieces(docs)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)
