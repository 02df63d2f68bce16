r"""Hashes of words and word n-grams, over whole arrays at once.

Words are `[^\x20\x09-\x0D]+`, taken from the UTF-8 bytes. A word's hash is a polynomial over its bytes modulo 2**64,
then mixed; an n-gram's is a polynomial over its words' hashes, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_BASE, _WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time; a segment ends where a word ends.
SEGMENT = 1 << 18
_powers = [np.ones(1, U), np.ones(1, U)]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n + 1, base, U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def _segment_hashes(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U)
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word of a text, in order."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= 2 * SEGMENT:
        return _segment_hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_segment_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def batched(texts: Iterable[bytes], limit: int = SEGMENT) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Places of texts, all their words' hashes, and where each text's begin (one more than texts), by batches of about limit bytes."""
    places: list[int] = []
    held: list[bytes] = []
    size = 0

    def flush() -> tuple[list[int], np.ndarray, np.ndarray]:
        joined = b"\n".join(held)
        hashes = word_hashes(joined)
        if len(held) == 1:
            return places, hashes, np.array([0, len(hashes)])
        data = np.frombuffer(joined, np.uint8)
        word_starts = np.flatnonzero(~_SPACE[data] & np.concatenate([[True], _SPACE[data[:-1]]]))
        text_starts = np.cumsum([0] + [len(x) + 1 for x in held])
        return places, hashes, np.searchsorted(word_starts, text_starts)

    for i, text in enumerate(texts):
        if held and size + len(text) > limit:
            yield flush()
            places, held, size = [], [], 0
        places.append(i)
        held.append(text)
        size += len(text) + 1
    if held:
        yield flush()


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on; none for the last n - 1."""
    if len(words) < n:
        return np.zeros(0, U)
    # Blocks of 1, 2, 4 ... words, joined by the binary digits of n.
    out, width, block, block_width = None, 0, words, 1
    factor = _WORD_BASE
    left = n
    while True:
        if left & 1:
            out = block[: len(words) - n + 1] if out is None else out * factor + block[width : width + len(words) - n + 1]
            width += block_width
        left >>= 1
        if not left:
            return mix64(out)
        block = block[:-block_width] * factor + block[block_width:] if len(block) > block_width else block[:0]
        block_width *= 2
        factor = U((int(factor) ** 2 + 2) % (1 << 64))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on."""
    if len(x) < n:
        return x[:0]
    out, width = x, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])
