"""Packing: documents of several lengths into windows of several context sizes, hierarchically.

Each document becomes token ids with ``END`` after them. Whole windows of the largest size are cut off
its front; what is left is routed to the smallest tier that holds it. From the longest tier to the
shortest, a window opens with the longest piece of its tier, and its gap is filled with the longest
pieces that fit, from its own or shorter tiers; where none fits, a piece is cut. So windows are full
but for the last of a task. The windows of a pool are dealt out to step groups by tier and number of
pieces, so that the groups of a step have the same mix.

There is no shuffle: each task packs its own documents in pools of bounded size and carries what is
left from pool to pool. A sequence's id holds the partition's number, so a task that runs again gives
the same rows.

Defined cases: a null or empty text is the single id ``END``; repeated rows are packed each; a long
text fills windows of its own; an empty table gives no rows. A sequence whose length is a power of two
needs no padding, the last one of a task is padded to the largest size.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.llm import frames

END = 0
#: Context sizes, longest first; powers of two.
TIERS = (1024, 512, 256, 128)
#: Ids that a task gathers before it packs, and sequences of a step group.
POOL, GROUP = 1 << 20, 32

#: The vocabulary of byte_bpe_50k.json as ranks, which are the ids.
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Splits as the tokenizer's own pattern wherever ``_HARD`` does not occur, without its look-ahead.
_PLAIN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_HARD = re.compile(r"\s\s|'[stmdrvl]")

COLUMNS = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
           "offset long, tier int, step_group long")

_encoders: dict[str, tuple[tiktoken.Encoding, tiktoken.Encoding]] = {}


def encoders(path: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The full encoder and the one for plain texts; loaded once in a Python worker."""
    if path not in _encoders:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tuple(
            tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
            for name, pattern in (("full", public_tokenizers.PATTERN), ("plain", _PLAIN)))
    return _encoders[path]


def token_ids(text: str, path: str) -> np.ndarray:
    full, plain = encoders(path)
    if "<|endoftext|>" in text:
        ids = full.encode(text, allowed_special="all")
    elif _HARD.search(text):
        ids = full.encode_ordinary(text)
    else:
        ids = plain.encode_ordinary(text)
    ids.append(END)
    return np.array(ids, "<u4")


class Pool:
    """Pieces (document, start, length) by length, with a bit set for each length that is there."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.by_length.setdefault(length, []).append((doc, start))
        self.mask |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        held = self.by_length[length]
        doc, start = held.pop()
        if not held:
            self.mask &= ~(1 << length)
        return doc, start, length

    def longest(self, most: int) -> int:
        """The greatest length there is up to ``most``, or 0."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1 if self.mask else 0


def fill(pool: Pool, tiers=TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, pieces) of each window; the last window may be short."""
    for tier, below in zip(tiers, (*tiers[1:], 0)):
        while (first := pool.longest(tier)) > below:
            window, gap = [pool.take(first)], tier - first
            while gap and pool.mask:
                if fits := pool.longest(gap):
                    window.append(pool.take(fits))
                    gap -= fits
                else:
                    doc, start, length = pool.take(pool.shortest())
                    window.append((doc, start, gap))
                    pool.add(doc, start + gap, length - gap)
                    gap = 0
            yield tier, window


def pack(docs: DataFrame, ranks: str | None = None, tiers: tuple[int, ...] = TIERS,
         pool_ids: int = POOL, group: int = GROUP, ids: bool = False) -> DataFrame:
    """One row per piece; with ``ids`` also its token ids."""
    ranks = ranks or public_tokenizers.path(RANKS)
    top = tiers[0]

    def rows(batches):
        base = TaskContext.get().partitionId() << 40
        sequences = groups = 0
        texts: dict[int, tuple[int | None, np.ndarray]] = {}
        pool, whole, held, number = Pool(), [], 0, 0

        def emit(last: bool):
            nonlocal sequences, groups, pool, whole, held, texts
            windows = whole + list(fill(pool, tiers))
            pool, whole, held, kept = Pool(), [], 0, {}
            if windows and not last and sum(p[2] for p in windows[-1][1]) < windows[-1][0]:
                for doc, start, length in windows.pop()[1]:  # waits for the next pool
                    pool.add(doc, start, length)
                    kept[doc] = texts[doc]
            order = sorted(range(len(windows)), key=lambda i: (windows[i][0], len(windows[i][1])))
            parts = max(1, len(windows) // group)
            out = []
            for rank, i in enumerate(order):
                turn, place = divmod(rank, parts)
                step = base + groups + (place if turn % 2 == 0 else parts - 1 - place)
                tier, window = windows[i]
                offset = 0
                for doc, start, length in window:
                    doc_id, tokens = texts[doc]
                    piece = tokens[start:start + length]
                    out.append((doc_id, start, length, zlib.crc32(piece), len(tokens),
                                base + sequences + i, offset, tier, step, *[piece] * ids))
                    offset += length
            sequences += len(windows)
            groups += parts
            texts = kept
            if out:
                kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * ids
                names = [c.split()[0] for c in COLUMNS.split(", ")] + ["ids"] * ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for part in frames.slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                tokens = token_ids(text or "", ranks)
                texts[number] = (doc_id, tokens)
                cut = len(tokens) // top * top
                whole += [(top, [(number, start, top)]) for start in range(0, cut, top)]
                if rest := len(tokens) - cut:
                    pool.add(number, cut, rest)
                number += 1
                held += len(tokens)
                if held >= pool_ids:
                    yield from emit(False)
        yield from emit(True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, COLUMNS + ", ids array<int>" * ids)
