"""Best-fit packing of documents into token sequences, by hierarchical merging of residual bins.

A document's tokens are its tokenizer ids and an end id. Only documents longer than a sequence are cut, into pieces as
long as a sequence; the first piece takes the remainder. Pieces are packed best fit, longest first, within blocks of
bounded size; bins that are nearly full, or can't take even the smallest open bin, are emitted. The others are items of
the next round, in fewer partitions, until one block holds them all. A round that brings no progress ends the merging
and its bins are emitted as they are, so every piece is packed at any size. Between rounds the bins are a table in the
shared folder.

Null and empty texts are documents of the end id alone. Repeated rows are packed one by one. An empty table gives an
empty result. Other columns of the input play no part.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship_texts, stored

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Free tokens up to which a bin counts as nearly full; items of a block; partitions merged into one.
SLACK, BLOCK, FAN_IN = 4, 100_000, 8
FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32")
#: Entries of each generation of a cache; texts encoded together; characters of a text handled at a time.
CACHE_ENTRIES, TEXTS, SEGMENT = 500_000, 256, 1 << 20
#: Below it, what is a letter or a digit has long been settled, so that two libraries cut pre-tokens alike.
SETTLED = "\u0250"
#: Marks that often end a word and join to one pre-token.
ENDS = ".,;:!?"


class Learned(dict):
    """Bytes by key, made when first asked for, in two generations: a full one becomes the older, and what is used again moves back."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def turn(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()


def byte_names() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones of Latin-1 as they are, the others in order from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 0x100 + i for i, b in enumerate(others)}


class CachedTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, by a byte-level BPE whose pre-tokens don't see their surroundings.

    A text is cut before spaces that follow something other than white space; no pre-token of the pattern crosses such a
    cut, so the ids of the chunks, which repeat, join to the text's ids. A chunk of settled characters that isn't known
    is cut into pre-tokens, which repeat more, and the model encodes those one by one; other chunks, and texts that hold
    an added token, are encoded as they are.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise ValueError("the tokenizer changes texts before it cuts them")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pre_tokens = regex.compile(pattern)
        self.names = byte_names()
        self.near_space = re.compile(r"\s(?: |(?<= )\s)")
        self.cut = re.compile(r"(?<=\S) ")
        self.chunks, self.parts = Learned(self._chunk), Learned(self._part)

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.names))]).tobytes()

    def _chunk(self, rest: str) -> bytes:
        """The ids of a chunk of a space and the rest."""
        if not (rest.isascii() or max(rest) < SETTLED):
            return self._encoded(" " + rest)
        word = rest.rstrip(ENDS)
        if word.isalpha():  # kept as a chunk only, as what is kept twice takes twice the memory
            return self.chunks[word] + self.parts[rest[len(word) :]] if len(word) < len(rest) else self._part(" " + word)
        return b"".join([self.parts[p] for p in self.pre_tokens.findall(" " + rest)])

    def _segment(self, text: str) -> bytes:
        first, *chunks = self.cut.split(text) if self.near_space.search(text) else text.split(" ")
        return self._encoded(first) + b"".join(map(self.chunks.__getitem__, chunks))

    def _ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self._encoded(text)
        if len(text) <= SEGMENT:
            return self._segment(text)
        out, at = [], 0
        while at < len(text):
            cut = self.cut.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            # A later segment begins with a space, so its first chunk is empty and the space is its next chunk's.
            out.append(self._segment(text[at:end]))
            at = end
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        self.chunks.turn()
        self.parts.turn()
        return [self._ids(t) for t in texts]

    def forget(self) -> None:
        """Gives up what it has learned. A worker outlives its task, and what it holds would take memory from whatever runs there next."""
        self.chunks.forget()
        self.parts.forget()


_tokenizers: dict[str, CachedTokenizer] = {}


def tokenizer_of(path: str | None = None) -> CachedTokenizer:
    """One per process and file; path: by default that of TOKENIZER."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path, public_tokenizers.PATTERN)
    return _tokenizers[path]


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, given as 4 bytes each."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    ends = [*starts[1:], n]
    return [(k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(starts, ends, strict=True))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """FIELDS of every document's pieces; docs: doc_id, text."""
    ship_texts(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_of(path)
        try:
            for batch in batches:
                texts, rows = [t or "" for t in batch["text"]], []
                for at in range(0, len(texts), TEXTS):
                    for d, ids in zip(batch["doc_id"].iloc[at : at + TEXTS], tokenizer.encode(texts[at : at + TEXTS]), strict=True):
                        rows += [(d, *p) for p in pieces_of(ids + end, capacity)]
                yield pd.DataFrame(rows, columns=list(FIELDS)).astype({"doc_id": "Int64"})
        finally:
            tokenizer.forget()

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(totals: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of places in totals: best fit, largest first. Open bins are stacked by free space; a bit set finds the tightest."""
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits = 0
    for i in np.argsort(-totals, kind="stable").tolist():
        size = int(totals[i])
        fits = free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                free_bits ^= 1 << free
            bins[b].append(i)
            free -= size
        else:
            b, free = len(bins), capacity - size
            bins.append([i])
        if free:
            stacks[free].append(b)
            free_bits |= 1 << free
    return bins


def _pack_block(totals: np.ndarray, members: list[bytes], capacity: int) -> pd.DataFrame:
    bins = best_fit(totals, capacity)
    return pd.DataFrame({"total": [int(totals[b].sum()) for b in bins], "members": [b"".join([members[i] for i in b]) for b in bins]})


def _packed(rows: DataFrame, capacity: int, block: int) -> DataFrame:
    """rows: total, members. Packed by blocks of each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= block:
                both = pd.concat(held)
                yield _pack_block(both["total"].to_numpy(), both["members"].tolist(), capacity)
                held, size = [], 0
        if size:
            both = pd.concat(held)
            yield _pack_block(both["total"].to_numpy(), both["members"].tolist(), capacity)

    return rows.mapInPandas(run, "total int, members binary")


def _as_items(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            wide = np.column_stack([b["doc_id"].isna().to_numpy(np.int64), *[b[f].fillna(0).to_numpy(np.int64) for f in FIELDS]])
            yield pd.DataFrame({"total": b["length"].to_numpy(np.int32), "members": [r.tobytes() for r in wide]})

    return pieces.mapInPandas(run, "total int, members binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, fan_in: int = FAN_IN, slack: int = SLACK) -> DataFrame:
    """FIELDS of every piece with sequence_id and offset."""
    ship_texts(pieces.sparkSession)
    items = stored(_as_items(pieces), "pack-items")
    done = [items.where(F.col("total") == capacity)]
    left = items.where(F.col("total") < capacity)
    n = items.count()
    parts = max(1, -(-n // block))
    stalled = 0
    while n:
        bins = stored(_packed(left.repartition(parts, F.xxhash64("members")) if parts > 1 else left.coalesce(1), capacity, block), "pack-bins")
        state = bins.where(F.col("total") < capacity - slack).agg(F.count(F.lit(1)), F.min("total")).first()
        if parts == 1 or not state[0] or stalled >= 2:
            done.append(bins)
            break
        closed = (F.col("total") >= capacity - slack) | (F.col("total") + int(state[1]) > capacity)
        done.append(bins.where(closed))
        left = bins.where(~closed)
        now = left.count()
        stalled = stalled + 1 if now > 0.9 * n else 0
        n = now
        parts = max(1, -(-n // block), -(-parts // fan_in) if stalled == 0 else -(-n // block))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    final = stored(out, "pack-sequences").withColumn("sequence_id", F.monotonically_increasing_id())
    discard(items)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            wide = [np.frombuffer(m, np.int64).reshape(-1, 1 + len(FIELDS)) for m in b["members"]]
            if not wide:
                continue
            all_rows = np.concatenate(wide)
            df = pd.DataFrame(all_rows[:, 1:], columns=list(FIELDS))
            df["doc_id"] = df["doc_id"].astype("Int64").mask(all_rows[:, 0] == 1)
            df["sequence_id"] = np.repeat(b["sequence_id"].to_numpy(), [len(w) for w in wide])
            df["offset"] = np.concatenate([np.cumsum(w[:, 4]) - w[:, 4] for w in wide])
            yield df

    return final.select("sequence_id", "members").mapInPandas(unpack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of docs (doc_id, text)."""
    pieces = stored(token_pieces(docs, capacity), "pack-pieces")
    return pack(pieces, capacity)
