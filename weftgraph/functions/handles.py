"""Content-addressed identity: MD5 over type and content, as column expressions and as plan-time values."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOL, EXPRESSION = "Symbol", "Expression"
#: The longest joined string and the longest element that a handle may be made of.
MAX_JOINED, MAX_ELEMENT = 100_000, 10_000


def md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def node_handle(name: str, kind: str = SYMBOL) -> str:
    if not name or not kind:
        raise ValueError("a node needs a type and a name")
    return md5(f"{kind} {name}")


def link_handle(targets: Sequence[str], kind: str = EXPRESSION) -> str:
    joined = " ".join([md5(kind), *targets])
    if len(joined) >= MAX_JOINED or not targets:
        raise ValueError("a link needs targets, within the length limit")
    return md5(joined)


def composite_handle(elements: Sequence[str]) -> str:
    if any(len(e) > MAX_ELEMENT for e in elements):
        raise ValueError("an element of a composite is too long")
    return md5(" ".join(elements))


def node_column(name: Column, kind: str = SYMBOL) -> Column:
    return F.md5(F.concat(F.lit(f"{kind} "), name))


def link_column(targets: Column, kind: str = EXPRESSION) -> Column:
    """targets: an array of handles."""
    return F.md5(F.concat(F.lit(md5(kind) + " "), F.array_join(targets, " ")))


def sanitized(text: Column) -> Column:
    """A source value fit for a node name: trimmed, line breaks and tabs as spaces; null if empty, over 1000 bytes or not UTF-8."""
    fit = (F.octet_length(text) > 0) & (F.octet_length(text) <= 1000) & F.is_valid_utf8(text)
    return F.when(fit, F.trim(F.translate(text, "\n\t", "  ")))


def escaped(text: Column) -> Column:
    """Double quotes inside a value are escaped."""
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def share_of_letter(text: Column, letter: str) -> Column:
    """The share of a letter among the characters that are neither spaces nor double quotes."""
    plain = F.translate(text, ' "', "")
    return F.when(F.char_length(plain) > 0, (F.char_length(plain) - F.char_length(F.replace(plain, F.lit(letter), F.lit("")))) / F.char_length(plain)).otherwise(0.0)
