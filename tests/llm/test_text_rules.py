"""Licences, quality and personal data against plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from weftgraph.llm import licenses, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " \n\t", "one", "a b c d e f g h i j k", "same words here now ok " * 30, "x" * 30000, "é 日本 \U0001f600 word " * 40]


def brute_license(text):
    text = text or ""
    units = {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text}
    best = {}
    for u in units:
        g = licenses.bigrams(u)
        dice = lambda b: 2 * len(g & b) / (len(g) + len(b))
        minus, name = min((-dice(licenses.bigrams(t)), name) for name, texts in licenses.TEMPLATES.items() for t in texts)
        if -minus >= licenses.THRESHOLD:
            best[name] = max(best.get(name, 0), -minus)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def test_licenses(docs_of):
    mit = licenses.TEMPLATES["MIT"]
    texts = [*EDGES, "x y\nReleased under the MIT License.\nz", "released, UNDER the mit license", "under the license", mit[2], mit[2].replace(". ", ".\n"), f"intro\n\n{mit[2]}\n \nLicensed under CC BY-NC 4.0.", "license " * 5000, "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    rows = {r["doc_id"]: r for r in licenses.license_scan(docs_of(texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        want = brute_license(t)
        assert rows[i]["licenses"] == ",".join(n for n, _ in want), t
        assert rows[i]["n_licenses"] == len(want)
        assert rows[i]["dice"] == (pytest.approx(want[0][1], abs=1e-6) if want else None)


def test_each_notice_is_its_own_licence(docs_of):
    """Siblings differ by a word or two, so a notice reaches the threshold with several licences but counts for its own."""
    texts = [(name, t) for name, own in licenses.TEMPLATES.items() for t in own]
    # A text that goes through its notice twice has as many distinct bigrams with nearly twice the words.
    doubled = [(name, f"{t} {t}") for name, t in texts]
    rows = {r["doc_id"]: r for r in licenses.license_scan(docs_of([t for _, t in texts + doubled])).collect()}
    for i, (name, t) in enumerate(texts + doubled):
        assert (rows[i]["license"], rows[i]["n_licenses"]) == (name, 1), t


def test_licenses_match_sql(docs_of):
    texts = [*EDGES, *(t for own in licenses.TEMPLATES.values() for t in own), "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC-SA 4.0.\n\nLicensed under the MIT license, version 2."]
    got = sorted(tuple(r) for r in licenses.license_scan(docs_of(texts)).collect())
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    columns = "doc_id, license, dice, n_licenses, licenses"
    assert got == sorted(duckdb.sql(f"SELECT {columns} FROM ({licenses.license_sql()})").fetchall())


def test_anchors_are_needed():
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            g = licenses.bigrams(t)
            chosen = licenses.anchors(g)
            left = {x for x in g if not chosen & set(x.split())}
            assert len(left) < licenses.THRESHOLD / (2 - licenses.THRESHOLD) * len(g) - 1e-9


def brute_base(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def test_quality(spark):
    rng = np.random.default_rng(4)
    vowel, rest = list("aeiou"), list("bcdfglmnprst")
    word = lambda: "".join(rng.choice(rest if k % 2 else vowel) for k in range(rng.integers(2, 8)))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(150)]
    odd = [" ".join(word().upper() + "!!" for _ in range(60)), " ".join(word() + "%%%" for _ in range(60))]
    texts = [*EDGES, *good, *odd, good[0], "a\na\nb\n \n \na"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, distance int")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(t)
    first = len(EDGES)
    assert all(got[i]["kept"] for i in range(first, first + len(good)))
    assert not any(got[i]["kept"] for i in range(first + len(good), first + len(good) + len(odd)))
    assert quality.judge(docs.limit(0)).count() == 0


def test_chi_squared():
    assert quality.chi2_quantile(0.5, 5) == pytest.approx(4.35146, abs=1e-4)
    assert quality.chi2_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-5)


def brute_estimate(x):
    """Centre and covariance by the same starts and steps over one group's integer statistics."""
    z, p = x / quality.SCALE, x.shape[1]
    floor = np.diag(np.square(quality.FLOOR))
    q = np.percentile(x, [25, 50, 75], axis=0)
    scale = quality.SHARE / quality.chi2_cdf(quality.chi2_quantile(quality.SHARE, p), p + 2)

    def step(centre, cov):
        d = np.einsum("ij,jk,ik->i", z - centre, np.linalg.inv(cov), z - centre)
        b = np.floor(16 * np.log2(1 + 16 * d))
        inner = np.array([(b < v).sum() < quality.SHARE * len(z) for v in b])
        return z[inner].mean(axis=0), floor + scale * np.cov(z[inner].T, bias=True)

    det = lambda e: round(float(np.linalg.slogdet(e[1])[1]), 9)
    middle = q[1] / quality.SCALE
    starts = [(middle, floor + np.diag(((q[2] - q[0]) / 1.349 / quality.SCALE) ** 2)), (z.mean(axis=0), floor + np.cov(z.T, bias=True)), (middle, floor)]
    for _ in range(quality.TRIAL_STEPS):
        starts = [step(*e) for e in starts]
    best = min(starts, key=det)
    for _ in range(quality.STEPS):
        last, best = best, step(*best)
        if det(last) == det(best):
            break
    return best, [det(e) for e in starts]


def test_robust_estimates_match_numpy(spark):
    """Concentration from three starts over integer sums, against the same by numpy; the starts end apart, so choosing matters."""
    rng = np.random.default_rng(1)
    plain = np.round(rng.normal(size=(400, 5)) * [90, 60, 60, 60, 80] + [1600, 100, 50, 200, 10]).astype(int)
    plain[:40] += 700
    # Two narrow lines that cross: from the sphere and from the quartiles another part of the rows is nearest.
    along = rng.normal(size=(500, 1)) * 900
    crossed = np.round(np.where(np.arange(500)[:, None] % 10 < 6, along * [1, 1, 0, 0, 0], along * [1, -1, 2, 0, 3] + [900, 0, 0, 0, 0]) + rng.normal(size=(500, 5)) * 40).astype(int)
    groups = {"plain": plain, "crossed": crossed}
    rows = spark.createDataFrame([(g, *map(int, r)) for g, x in groups.items() for r in x], "g string, " + ", ".join(f"{f} long" for f in quality.FEATURES))
    got = {r["g"]: r for r in quality.robust_estimates(rows).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        (centre, cov), dets = brute_estimate(x)
        assert [got[g][f"c_{i}"] for i in range(5)] == pytest.approx(centre.tolist(), abs=1e-9)
        inverse = np.linalg.inv(cov)
        assert [got[g][f"a_{i}_{j}"] for i in range(5) for j in range(i + 1)] == pytest.approx([inverse[i, j] for i in range(5) for j in range(i + 1)], abs=1e-6)
        assert got[g]["det"] <= min(dets) + 0.05  # whole buckets: later steps may hold a little more than their share
    assert len(set(brute_estimate(crossed)[1])) > 1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


PII_TEXTS = [
    *EDGES, "a@b.c_d@e.f x@y and a.b+c@mail1.example.com.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (988) 555-2485 +12 3", "9" * 5000,
    "IBAN DE89370400440532013000 and DE89370400440532013001", "my ssn 123-45-6789 but 123-45-6780 alone far away" + " x" * 40, "﷐ a@b.co ﷐", "\U0001f600 a@b.co 42.144.35.254", "a@b.co " * 60, "+1" + " " * 3000 + "2", "@.@ a@@b.co",
]


def test_pii(docs_of):
    rows = {r["doc_id"]: r for r in pii.pii_digest(docs_of(PII_TEXTS, extra=True)).collect()}
    for i, t in enumerate(PII_TEXTS):
        want = brute_spans(t)
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), t
        for k, kind in enumerate(PATTERNS):
            assert rows[i][f"n_{kind}"] == sum(x[1] == k for x in want)
    assert rows[len(EDGES) + 5]["spans"] == "iban:5:27"
    assert rows[len(EDGES) + 6]["spans"].startswith("ssn:7:18")


def test_redaction(docs_of):
    rows = [r["text"] for r in pii.redact(docs_of(["mail a@b.co now", None, "1.2.3.4", "no"])).orderBy("doc_id").collect()]
    assert rows == ["mail [EMAIL] now", None, "[IP]", "no"]
