r"""Personal data: regular expressions propose, checksums confirm, context words adjust the score. No Python runs on rows.

Positions are code points, end exclusive. A null text counts as empty. Each kind is matched on its own, leftmost and
non-overlapping; a match that its validator refuses is dropped without a second try inside it. Spans of different kinds
may overlap. Repeated rows each get their own result; other columns of the input play no part.

A marker character is put around each match and the text split at it, so positions come from piece lengths. Markers
that a text already holds count as another unassigned character of the same length, which no pattern accepts.
The patterns are possessive and anchored at run starts (or at the last match's end), which leaves the matches as they
are and keeps the time linear in the text's length and the stack flat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

MARK, STAND_IN = "﷐", "﷑"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """score: of a confirmed match; context: words nearby that add CONTEXT_BONUS to it."""

    name: str
    trigger: str
    pattern: str
    score: float
    context: str
    tag: str


CONTEXT_BONUS, CONTEXT_CHARS, KEEP_FROM = 0.3, 40, 0.5
#: In the order in which spans that start together are listed.
KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write", "[EMAIL]"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, "ip|host|server|address", "[IP]"),
    Kind("card", "[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++", 0.8, "card|visa|credit|payment", "[CARD]"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, "phone|call|tel|mobile", "[PHONE]"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.8, "iban|account|bank", "[IBAN]"),
    Kind("ssn", "[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security|tax id", "[SSN]"),
    Kind("key", "AKIA[0-9A-Z]", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", 0.8, "key|aws|access", "[KEY]"),
    Kind("secret", "(?:password|passwd|token|secret|api_key)[ ]?[=:]", r"(?<![A-Za-z0-9_])(?:password|passwd|token|secret|api_key)[ ]?[=:][ ]?\"?[A-Za-z0-9_/+-]{12,}+\"?", 0.6, "login|auth", "[SECRET]"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the decimal digits end in the right check digit."""
    chars = F.split(F.reverse(digits), "")
    doubled = F.transform(
        F.filter(chars, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the account number, first four characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97,
    )
    return F.char_length(plain).between(15, 34) & (rest == 1)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|0000$")
    return F.lit(True)


def _pieces(text: Column, kind: Kind) -> Column:
    """Outside and matches by turns, beginning outside."""
    return F.split(F.regexp_replace(text, F.lit(kind.pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def _spans_of(text: Column, kind: Kind, order: int, span: str) -> Column:
    """Array of (start, order, end, score) of one kind's kept matches."""

    def found(pieces: Column) -> Column:
        n = F.size(pieces)
        lengths = F.transform(pieces, F.char_length)
        passed = F.filter(F.sequence(F.lit(1), n - 2, F.lit(2)), lambda i: _confirmed(kind.name, F.get(pieces, i)))
        near = lambda i: F.lower(F.concat(F.right(F.get(pieces, i - 1), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(CONTEXT_CHARS))))
        score = lambda i: F.lit(kind.score) + F.when(near(i).rlike(f"\\b(?:{kind.context})"), CONTEXT_BONUS).otherwise(0.0)
        # Starts are prefix sums of the lengths: by blocks of about sqrt(n), so that no text takes quadratic time.
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

        def placed(lens: Column, block: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: total(F.slice(lens, b * block + 1, block)))
            before = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
            return let(
                before,
                lambda at: F.transform(
                    passed,
                    lambda i: let(
                        F.get(at, F.floor(i / block).cast("int")) + total(F.slice(lens, F.floor(i / block).cast("int") * block + 1, i % block)),
                        lambda s: F.struct(s.alias("start"), F.lit(order).alias("kind"), (s + F.get(lens, i)).alias("end"), score(i).alias("score")),
                    ),
                ),
            )

        spans = F.when(n < 3, F.array().cast(span)).when(
            F.size(passed) == 0, F.array().cast(span)
        ).otherwise(let(lengths, lambda lens: let(F.ceil(F.sqrt(n)).cast("int"), lambda block: placed(lens, block))))
        return F.filter(spans, lambda s: s["score"] >= KEEP_FROM)

    return F.when(text.rlike(kind.trigger), let(_pieces(text, kind), found)).otherwise(F.array().cast(span))


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii_spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with an array of (start, kind, end, score), by start and then kind (its place in kinds)."""
    span = "array<struct<start:int,kind:int,end:int,score:double>>"
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, STAND_IN)
    found = let(plain, lambda t: F.array_sort(F.concat(*[_spans_of(t, k, i, span) for i, k in enumerate(kinds)])))
    return docs.withColumn(into, found)


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every span of text replaced by its kind's tag; of overlapping spans the first is named and all are covered.

    Each span is cut out by its place, so the time grows with the text's length times its spans. A null text stays null, and
    other columns are carried along, whatever their names.
    """
    spans = fresh(docs.columns, "spans")[0]
    df = find_pii(docs, text, spans, kinds)
    tags = F.array(*[F.lit(k.tag) for k in kinds])
    state = "struct<at:int,out:array<string>>"
    t = F.col(text)
    # at: end of what is covered so far (code points); out: untouched pieces and tags by turns.
    cut = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")).cast(state)).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.get(tags, s["kind"]))).alias("out"),
            ).cast(state)
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.char_length(t))),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(t)).drop(spans)


def listed(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """A row per row of docs: counts and hash of the base spans, and all spans as text."""
    df = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("pii_spans", lambda s: s["kind"] == i)).cast("long")
    return df.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"),
        F.round(F.aggregate("pii_spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])), 6).alias("top_score"),
    )
