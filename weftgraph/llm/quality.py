r"""Quality rules: text statistics, fixed base rules and robust multivariate outliers. No Python runs on rows.

Words are `[^\x20\x09-\x0D]+`. A null or empty text has no words and fails the base rules. Repeated rows each get a
verdict; ties in distance share a bucket and so share their fate; other columns of the input play no part.

The outlier rule estimates location and scatter per language and source by the minimum covariance determinant, from three
starts: medians with quartile ranges, means with covariances, and medians with a sphere. Concentration steps keep the
nearest three quarters of a group and estimate again. After TRIAL_STEPS of them each group goes on from the start whose
determinant is least (of equal ones the first), until no group's determinant changes, at most STEPS more. Statistics are stored as
integers, so sums don't depend on the order of rows. A step, of all starts at once, is one aggregation to a row per group, start
and distance bucket; the nearest share of a group is whole buckets. Groups with fewer than min_group usable rows borrow the
estimate of their language, and such languages that of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, let, stored, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, SHINGLE = 10, 20, 5
#: Log of mean word length; arcsine roots of the shares of symbols, upper-case letters, punctuation and repeated words.
FEATURES = ("f_len", "f_sym", "f_upper", "f_punct", "f_repeat")
SCALE = 1024
#: Least standard deviation of each statistic: smaller spreads are sampling noise of short texts.
FLOOR = (0.10, 0.08, 0.08, 0.08, 0.10)
SHARE, TRIAL_STEPS, STEPS, TAIL = 0.75, 2, 6, 1e-5
#: Groups whose estimates may be broadcast; beyond it they are joined by shuffle.
MAX_BROADCAST_GROUPS = 50_000


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def repeat_words(w: Column) -> Column:
    """Words in windows of SHINGLE words that occur twice or more in the text."""
    n = F.size(w)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(SHINGLE), F.coalesce(F.get(at, i + 1) - p, F.lit(SHINGLE))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        both = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i + 1) | F.when(i > 0, same(i, i - 1)).otherwise(False))
        return let(F.sort_array(F.transform(both, lambda i: F.get(s, i)["p"])), covered)

    hashes = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    return F.when(n <= SHINGLE, F.lit(0)).otherwise(
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), repeated)
            ),
        )
    )


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep, the base counts, base_failed and the integer statistics of FEATURES, a row per row of docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def counts(w: Column) -> Column:
        return let(
            F.array_join(w, ""),
            lambda j: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(j).cast("long").alias("word_chars"),
                F.char_length(F.regexp_replace(j, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
                F.char_length(F.regexp_replace(j, "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
                F.char_length(F.regexp_replace(j, "[^\\p{P}]+", "")).cast("long").alias("n_punct"),
            ),
        )

    base = docs.select(*keep, let(words(t), counts).alias("s")).select(*keep, "s.*")
    share = lambda n, of: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(n) / F.greatest(F.col(of), F.lit(1)))))
    values = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_upper", "word_chars"),
        share("n_punct", "word_chars"),
        share("n_repeat_words", "n_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return base.withColumns({f: F.round(v * SCALE).cast("long") for f, v in zip(FEATURES, values, strict=True)}).withColumn("base_failed", failed)


def _named(value: str) -> Column:
    """Null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(value).cast("string")), F.lit("-"))


def _joined(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Broadcast only a counted, small table; else a shuffle whose hot keys adaptive execution splits."""
    return rows.join(F.broadcast(groups) if n_groups <= MAX_BROADCAST_GROUPS else groups, "g", "left")


def _inverse(groups: DataFrame, cov: dict[tuple[int, int], Column]) -> DataFrame:
    """Columns a_i_j (i >= j) of the inverse of the covariance and det, its determinant's logarithm, by Cholesky's factor."""
    p, df = len(FEATURES), groups.withColumns({f"v_{i}_{j}": value for (i, j), value in cov.items()})
    dot = lambda pairs: " + ".join(["0D", *(f"{x} * {y}" for x, y in pairs)])

    def put(values: dict[str, str]) -> None:
        nonlocal df
        df = df.withColumns({name: F.expr(value) for name, value in values.items()})

    for j in range(p):
        rest = {i: f"v_{i}_{j} - ({dot((f'l_{i}_{k}', f'l_{j}_{k}') for k in range(j))})" for i in range(j, p)}
        put({f"l_{j}_{j}": f"sqrt(greatest({rest[j]}, 1e-9D))"})
        put({f"l_{i}_{j}": f"({rest[i]}) / l_{j}_{j}" for i in range(j + 1, p)})
    for i in range(p):
        put({f"m_{i}_{j}": ("1D" if i == j else f"-({dot((f'l_{i}_{k}', f'm_{k}_{j}') for k in range(j, i))})") + f" / l_{i}_{i}" for j in range(i + 1)})
    put({f"a_{i}_{j}": dot((f"m_{k}_{i}", f"m_{k}_{j}") for k in range(i, p)) for i in range(p) for j in range(i + 1)} | {"det": f"round(2 * ({' + '.join(f'ln(l_{i}_{i})' for i in range(p))}), 9)"})
    return df


def _shape(groups: DataFrame) -> DataFrame:
    p = len(FEATURES)
    return groups.select("g", "start", "det", *[f"c_{i}" for i in range(p)], *[f"a_{i}_{j}" for i in range(p) for j in range(i + 1)])


def squared_distance() -> Column:
    p = len(FEATURES)
    z = [F.col(f) / SCALE - F.col(f"c_{i}") for i, f in enumerate(FEATURES)]
    return sum(((1 if i == j else 2) * F.col(f"a_{i}_{j}") * z[i] * z[j] for i in range(p) for j in range(i + 1)), F.lit(0.0))


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _sums() -> list[Column]:
    """Aggregates n, s_i and s_i_j of rows' statistics."""
    own = [F.sum(f).alias(f"s_{i}") for i, f in enumerate(FEATURES)]
    return [F.count(F.lit(1)).alias("n"), *own, *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s_{i}_{j}") for i, j in PAIRS]]


def _moments(sums: DataFrame, *keys: str) -> DataFrame:
    """keys, means c_i and covariances v_i_j from n, s_i and s_i_j."""
    mean = lambda name: F.col(name).cast("double") / F.col("n")
    centres = [(mean(f"s_{i}") / SCALE).alias(f"c_{i}") for i in range(len(FEATURES))]
    return sums.select(*keys, *centres, *[((mean(f"s_{i}_{j}") - mean(f"s_{i}") * mean(f"s_{j}")) / SCALE**2).alias(f"v_{i}_{j}") for i, j in PAIRS])


def _estimates(moments: DataFrame, scale: float = 1.0) -> DataFrame:
    """Stored centres, inverse scatters and determinants of moments, which hold g and start; scatters never fall below FLOOR."""
    cov = {(i, j): (FLOOR[i] ** 2 if i == j else 0.0) + scale * F.col(f"v_{i}_{j}") for i, j in PAIRS}
    return stored(_shape(_inverse(moments, cov)), "mcd")


def _starts(rows: DataFrame) -> DataFrame:
    """The estimates that concentration starts from: start 0, 1 and 2 of each g."""
    quartiles = [F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{i}") for i, f in enumerate(FEATURES)]
    seen = stored(rows.groupBy("g").agg(*quartiles, *_sums()), "mcd-starts")
    medians = [(F.get(f"q_{i}", F.lit(1)) / SCALE).alias(f"c_{i}") for i in range(len(FEATURES))]
    spread = lambda i: ((F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / (1.349 * SCALE)) ** 2
    by_quartiles = seen.select("g", F.lit(0).alias("start"), *medians, *[(spread(i) if i == j else F.lit(0.0)).alias(f"v_{i}_{j}") for i, j in PAIRS])
    by_means = _moments(seen.withColumn("start", F.lit(1)), "g", "start")
    by_sphere = seen.select("g", F.lit(2).alias("start"), *medians, *[F.lit(0.0).alias(f"v_{i}_{j}") for i, j in PAIRS])
    out = _estimates(by_quartiles.unionByName(by_means).unionByName(by_sphere))
    discard(seen)
    return out


def _concentrated(rows: DataFrame, now: DataFrame, n_groups: int, share: float) -> DataFrame:
    """The estimates of each group's nearest share of rows, by each of its estimates."""
    p = len(FEATURES)
    # Scatter of the nearest share of a normal sample, scaled back to the whole sample's.
    scale = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    bucket = F.floor(16 * F.log2(1 + 16 * squared_distance())).cast("int")
    cells = _joined(rows, now, n_groups).groupBy("g", "start", bucket.alias("b")).agg(*_sums())
    by = Window.partitionBy("g", "start")
    inner = cells.withColumn("before", F.coalesce(F.sum("n").over(by.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(by)).where(F.col("before") < share * F.col("all"))
    names = ["n", *[f"s_{i}" for i in range(p)], *[f"s_{i}_{j}" for i, j in PAIRS]]
    return _estimates(_moments(inner.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in names]), "g", "start"), scale)


def robust_estimates(rows: DataFrame, share: float = SHARE, trial_steps: int = TRIAL_STEPS, steps: int = STEPS) -> DataFrame:
    """g, start, det, centre c_i and inverse scatter a_i_j for each group g of rows, which hold g and FEATURES."""
    now = _starts(rows)
    n_groups = now.count()
    for _ in range(trial_steps):
        before, now = now, _concentrated(rows, now, n_groups, share)
        discard(before)
    least = Window.partitionBy("g").orderBy("det", "start")
    before, now = now, stored(now.withColumn("r", F.row_number().over(least)).where(F.col("r") == 1).drop("r"), "mcd")
    discard(before)
    for _ in range(steps):
        before, now = now, _concentrated(rows, now, n_groups, share)
        moved = before.select("g", F.col("det").alias("was")).join(now, "g").where(F.col("det") != F.col("was")).limit(1).count()
        discard(before)
        if not moved:
            break
    return now


def judge(docs: DataFrame, min_group: int = 60, tail: float = TAIL, share: float = SHARE) -> DataFrame:
    """A row per row of docs (doc_id, text, lang, source): base counts, base_failed, distance (squared) and kept.

    A document is kept if it passes the base rules and its squared distance doesn't exceed the chi-squared quantile
    that a normal sample exceeds with probability tail. An empty table gives an empty result.
    """
    facts = stored(text_statistics(docs).withColumns({"g_full": F.concat_ws("/", _named("lang"), _named("source")), "g_lang": F.concat(F.lit("lang:"), _named("lang"))}), "quality")
    usable = facts.where(~F.col("base_failed"))
    sizes = stored(usable.groupBy("g_full", "g_lang").agg(F.count(F.lit(1)).alias("n")), "quality-groups")
    n_groups = sizes.count()
    langs = sizes.groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
    # Each group's name where it is large enough, else its language's, else the corpus's.
    named = sizes.join(langs, "g_lang").select("g_full", F.when(F.col("n") >= min_group, F.col("g_full")).when(F.col("n_lang") >= min_group, F.col("g_lang")).otherwise(F.lit("all")).alias("g"))
    named = stored(named, "quality-names")
    levels = F.array(F.col("g_full"), F.col("g_lang"), F.lit("all"))
    wanted = named.select("g").distinct()
    rows = usable.select(F.explode(levels).alias("g"), *FEATURES).join(F.broadcast(wanted) if n_groups <= MAX_BROADCAST_GROUPS else wanted, "g", "left_semi")
    estimates = robust_estimates(rows, share)
    limit = chi2_quantile(1 - tail, len(FEATURES))
    out = _joined(facts.join(F.broadcast(named) if n_groups <= MAX_BROADCAST_GROUPS else named, "g_full", "left"), estimates, n_groups)
    distance = F.when(F.col("base_failed"), F.lit(None).cast("double")).otherwise(F.round(squared_distance(), 9))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= limit)).alias("kept"), distance.alias("distance"),
    )
