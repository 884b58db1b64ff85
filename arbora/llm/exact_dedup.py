"""Exact dedup by content-defined chunk recipes.

Each text, its white space normalised, is cut where a gear hash over its last 32 bytes meets a mask, so equal passages give equal
chunks wherever they stand. Each distinct chunk is moved once, to where its hash lives, and its bytes are compared there: a hash
with one content is an identifier; contents that share a hash are numbered. A document's recipe is its ordered list of
identifiers, and texts are equal when their recipes are. Only recipes are grouped and joined, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, pieces, ship, staged
from .textvec import _BYTE

LEAST, MASK_BITS, MOST = 256, 10, 8192
#: Bytes of a chunk's hash.
HASH_BYTES = 16
_GEAR = (_BYTE >> np.uint64(32)).astype(np.uint32)


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes with each run of ASCII white space as one space; null is empty."""
    raw = (text or "").encode()
    inner = b" ".join(raw.split())
    if raw[:1].isspace():
        inner = b" " + inner
    return inner + b" " if raw[-1:].isspace() and inner != b" " else inner


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks: the first hit at least ``LEAST`` bytes on, or ``MOST`` bytes on. Empty bytes have no chunk."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    ends, start = [], 0
    block = 1 << 20
    hits: list[np.ndarray] = []
    for at in range(0, n, block):
        lead = min(at, 31)
        g = _GEAR[np.frombuffer(raw, np.uint8, min(block, n - at) + lead, at - lead)]
        for step in (1, 2, 4, 8, 16):
            shifted = g[:-step] << np.uint32(step)
            g = g.copy()
            g[step:] += shifted
        hits.append(np.flatnonzero((g[lead:] >> np.uint32(32 - MASK_BITS)) == 0) + at + 1)
    found = np.concatenate(hits)
    k = 0
    while start < n:
        k += int(np.searchsorted(found[k:], start + LEAST))
        end = int(found[k]) if k < len(found) else n
        end = min(end, start + MOST, n)
        ends.append(end)
        start = end
    return ends


def _chunks(raw: bytes) -> Iterator[bytes]:
    start = 0
    for end in cuts(raw):
        yield raw[start:end]
        start = end


def _hash(chunk: bytes, bits: int) -> bytes:
    h = hashlib.sha256(chunk).digest()[:HASH_BYTES]
    return h if bits >= 128 else (int.from_bytes(h, "big") >> (128 - bits)).to_bytes(HASH_BYTES, "big")


def _recipes(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """doc_id, SHA-256 and bytes of the normalised text, its chunks' hashes one after the other."""
    for batch in batches:
        for part in pieces(batch, 1):
            rows = []
            for text in part.column(1).to_pylist():
                raw = normalised(text)
                rows.append((hashlib.sha256(raw).hexdigest(), len(raw), b"".join(_hash(c, bits) for c in _chunks(raw))))
            sha, n, recipe = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sha), pa.array(n, pa.int64()), pa.array(recipe, pa.binary())], names=["doc_id", "text_sha256", "n_bytes", "recipe"])


def _contents(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Hash and bytes of each chunk, once for each slice of a batch."""
    for batch in batches:
        for part in pieces(batch, 0, 4 << 20):
            seen = {c: _hash(c, bits) for text in part.column(0).to_pylist() for c in _chunks(normalised(text))}
            yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.binary()), pa.array(seen, pa.binary())], names=["hash", "content"])


def _placed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its text's row, its place there, hash and bytes."""
    for batch in batches:
        for part in pieces(batch, 1):
            rows = [(r, i, _hash(c, bits), c) for r, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, c in enumerate(_chunks(normalised(text)))]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["row", "i", "hash", "content"])


def _listed(docs: DataFrame, bits: int) -> DataFrame:
    """``doc_id, text_sha256, n_bytes, recipe, row``, the recipe made of verified identifiers."""
    contents = docs.select("text").mapInArrow(lambda it: _contents(it, bits), "hash binary, content binary")
    once = contents.groupBy("hash", "content").agg(F.count(F.lit(1)).alias("n"))
    shared = staged(once.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    recipe = "doc_id long, text_sha256 string, n_bytes long, recipe binary"
    if shared.isEmpty():
        return staged(docs.select("doc_id", "text").mapInArrow(lambda it: _recipes(it, bits), recipe).withColumn("row", F.monotonically_increasing_id()))
    # Contents share a hash: number them, and put the number after the hash in each recipe that has one of them.
    docs = staged(docs.withColumn("row", F.monotonically_increasing_id()))
    numbers = contents.join(shared, "hash", "left_semi").distinct().withColumn("number", F.row_number().over(W.partitionBy("hash").orderBy("content")))
    each = docs.select("row", "text").mapInArrow(lambda it: _placed(it, bits), "row long, i int, hash binary, content binary")
    lists = each.join(numbers, ["hash", "content"], "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", F.hex("hash").alias("h"), F.coalesce("number", F.lit(1)).alias("k")))).alias("ids"))
    lists = lists.select("row", F.concat_ws(",", F.transform("ids", lambda x: F.concat_ws(":", x.h, x.k))).cast("binary").alias("recipe"))
    facts = docs.select("row", "text", "doc_id").mapInArrow(lambda it: _facts(it), "row long, doc_id long, text_sha256 string, n_bytes long")
    return staged(facts.join(lists, "row", "left").select("doc_id", "text_sha256", "n_bytes", F.coalesce("recipe", F.lit("").cast("binary")).alias("recipe"), "row"))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1):
            raw = [normalised(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([len(x) for x in raw], pa.int64())], names=["row", "doc_id", "text_sha256", "n_bytes"])


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = 128) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks`` for each row, dropped ones too.

    Texts are equal when they are after each ``[\\x20\\x09-\\x0D]+`` became one space; null and empty are equal. The smallest
    doc_id of a group stays (null counts as larger than all); of rows that repeat it, one. ``bits`` shortens chunk hashes, to test
    what happens when contents share one. The join back is on the recipe; adaptive execution splits a hot one.
    """
    ship(docs.sparkSession)
    listed = _listed(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = staged(listed.groupBy("recipe").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    return listed.join(groups, "recipe").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
        "n_bytes",
        F.floor(F.octet_length("recipe") / HASH_BYTES).alias("n_chunks"),
    )


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of equal texts (null and empty are equal) one row stays, that with the smallest id; a null id is larger than all. Rows that share
    an id are told apart by their text, and of those that share both, which may differ in other columns, one stays. An empty table
    stays empty. Rows are matched by the ids that go, fewer than those that stay: where these are few (Spark's own threshold for a
    broadcast), texts stay where they are.
    """
    gone, again, sha = free("_gone", docs), free("_again", docs), free("_sha", docs)
    decided = staged(exact_groups(docs, text, key).select("doc_id", "kept", "text_sha256"))
    ids = decided.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    drop = staged(ids.filter("not kept").select(F.col("doc_id").alias(gone)))  # a file's size is known before texts are shuffled
    stay = docs.join(drop, F.col(key).eqNullSafe(F.col(gone)), "left_anti")
    several = staged(ids.filter("kept and n > 1").select(F.col("doc_id").alias(again)))
    if several.isEmpty():
        return stay
    # ids that several rows carry: of each of their kept texts, one row
    single = stay.join(several, F.col(key).eqNullSafe(F.col(again)), "left_anti")
    squeezed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    many = stay.join(several, F.col(key).eqNullSafe(F.col(again)), "left_semi").withColumn(sha, F.sha2(squeezed.cast("binary"), 256)).dropDuplicates([key, sha])
    kept = decided.filter("kept").select(F.col("doc_id").alias(again), "text_sha256")
    return single.unionByName(many.join(kept, F.col(key).eqNullSafe(F.col(again)) & (F.col(sha) == F.col("text_sha256")), "left_semi").drop(sha))
