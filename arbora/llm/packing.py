"""Packing documents into fixed sequences by harmonic classes.

Lengths in (capacity/(k+1), capacity/k] form class k; a bin of class k takes exactly k pieces, so a piece's bin is its rank in its
class divided by k, and workers fill bins without talking to each other. A document is cut where that spares such bins more than
``PRICE`` tokens of padding: it gives up exactly capacity/i tokens, which fill class i without waste, and the rest is classed again.
No cut leaves a piece of less than ``LEAST`` tokens. What is left of each class is less than one bin; those pieces, bounded by the
capacity alone, are dealt to groups of about ``SPREAD`` by a hash and packed by best fit in each.
"""

from __future__ import annotations

import functools
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, ranked, ship, staged, unit

CAPACITY = 2048
END = 1
#: Padding that a cut must spare, tokens that it must leave on both sides, and pieces in a group of what is left of the classes.
PRICE, LEAST, SPREAD = 32, 64, 512
#: Words whose ids a worker keeps; others are encoded each time.
CACHE = 400_000
RANGE_ROWS = 20_000
#: White space other than single blanks and line feeds between words.
_ODD = ["  ", " \n", "\n\n", "\n ", *map(chr, [9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit integers.

    Its pre-tokenizer never joins a word to what follows a blank after it, so the ids of a text are those of its words, each with
    the blank or line feed before it. Words are encoded by the same vocabulary in ``tiktoken`` and kept. Texts with any other
    white space, or with two white spaces in a row, go to ``tokenizers`` whole, and so do texts that hold an added token, whose id
    stands for its literal by the file's default.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        special = {x["content"] for x in described.get("added_tokens", ())}
        self.added = sorted(special)
        # byte-level files write bytes as printable characters: those that print as themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(byte[c] for c in t): i for t, i in described["model"]["vocab"].items() if t not in special}
        self.words = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode, single = self.words.encode_ordinary, self.words._core_bpe.encode_single_piece
        mark = {x: _bytes(encode(x)) for x in ".,"}
        feed = encode("\n")

        class Cache(dict):
            def __missing__(self, unit: str) -> bytes:
                if unit[-1:] in mark and unit[-2:-1].isalnum():
                    return self[unit[:-1]] + mark[unit[-1]]  # a mark after a letter or number is a word of its own
                if unit.isalpha():
                    ids = _bytes(single(f" {unit}".encode()))
                elif unit[1:].isalpha() and unit[0] == "\n":
                    ids = _bytes(feed + single(unit[1:].encode()))
                else:
                    ids = _bytes(encode(unit if unit[:1] == "\n" else " " + unit))
                if len(self) < cache:
                    self[unit] = ids
                return ids

        self.cache = Cache()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD) or any(x in text for x in self.added):
            return _bytes(self.whole.encode(text, add_special_tokens=False).ids)
        first, *rest = text.replace("\n", " \n").split(" ")
        get = self.cache.__getitem__
        return get("\n" + first)[4:] + b"".join(map(get, rest))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    return Encoder(path)


@functools.cache
def first_cuts(capacity: int, price: int = PRICE, least: int = LEAST) -> tuple[int, ...]:
    """For each number of tokens up to the capacity, how many to cut off first so that padding and the price of cuts are least; 0 to leave them whole."""
    padding = [0.0] + [capacity / (capacity // n) - n for n in range(1, capacity + 1)]
    cost, first = padding[:], [0] * (capacity + 1)
    for n in range(2 * least, capacity + 1):
        for piece in sorted({capacity // i for i in range(2, capacity // least + 1)}, reverse=True):
            if least <= piece <= n - least and padding[piece] + cost[n - piece] + price < cost[n]:
                cost[n], first[n] = padding[piece] + cost[n - piece] + price, piece
    return tuple(first)


def lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces that ``n`` tokens are cut into."""
    full, left = divmod(n, capacity)
    out = [capacity] * full
    if full and 0 < left < LEAST and capacity // 2 >= LEAST:
        out[-1] = capacity // 2
        left += capacity - out[-1]
    first = first_cuts(capacity)
    while left:
        out.append(first[left] or left)
        left -= out[-1]
    return out


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    end = _bytes([END])
    for batch in batches:
        for part in pieces(batch, 1):
            rows = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n, at = len(ids) // 4, 0
                for size in lengths(n, capacity):
                    rows.append((key, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                    at += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)


def _best_fit(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        """Pieces of unfinished bins, longest first, each where it leaves least room."""
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        room: list[tuple[int, int]] = []
        bins, spots = [], []
        n = 0
        for size in frame["length"]:
            i = bisect_left(room, (size, -1))
            if i < len(room):
                left, b = room.pop(i)
            else:
                left, b, n = capacity, n, n + 1
            bins.append(b)
            spots.append(capacity - left)
            insort(room, (left - size, b))
        first = int(frame["spread"].iloc[0]) << 24
        return frame.assign(sequence_id=first + np.array(bins, np.int64), offset=np.array(spots, np.int64))[_NAMES]

    return pack


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = ", ".join(f"{x} long" for x in _NAMES)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is its end token alone. A document over the capacity fills whole sequences with its first tokens.
    ``sequence_id`` is class * 2**40 + bin, and group * 2**24 + bin for what was left of the classes. Repeated rows are packed like any
    others; other columns are dropped. Only pieces' facts are shuffled.
    """
    ship(docs.sparkSession)
    path = path or default_tokenizer()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = staged(rows.mapInArrow(lambda it: _cut(it, path, capacity), ", ".join(f"{x} long" for x in _NAMES[:5])))
    buckets = max(64, -(-cut.count() // RANGE_ROWS))
    order = ["doc_id", "start", "ids_crc32", "length", "doc_tokens"]
    cut = cut.withColumn("k", F.expr(f"cast({capacity} div length as int)")).withColumn("u", unit(*order))
    sizes = F.broadcast(cut.groupBy("k").agg(F.count(F.lit(1)).alias("n")))  # at most ``capacity`` classes
    placed = staged(ranked(cut, ["k"], "u", order, buckets, "rank").join(sizes, "k").withColumn("bin", F.expr("rank div k")).drop("u"))
    full = placed.filter("(bin + 1) * k <= n")
    before = W.partitionBy("k", "bin").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    full = full.select(*_NAMES[:5], F.expr("shiftleft(cast(k as bigint), 40) + bin").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    left = placed.filter("(bin + 1) * k > n")
    groups = max(1, -(-left.count() // SPREAD))
    rest = left.select(*_NAMES[:5], F.pmod(F.xxhash64(*order), F.lit(groups)).alias("spread")).groupBy("spread").applyInPandas(_best_fit(capacity), _SCHEMA)
    return full.unionByName(rest)
