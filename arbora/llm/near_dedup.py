"""Near-duplicate groups by circulant MinHash.

A first permutation (the shingles' hash) scatters a document's shingles over ``UNIVERSE`` places; a second one, shifted circularly
by 0, 1, 2, ..., gives every coordinate of the signature: coordinate k is the least value of the shifted permutation over the
document's places. Five neighbouring coordinates make a band; with 36 bands a pair of similarity 0.8 is missed once in 1.6 million.

Documents with equal sets are one class from the start, and those with too many shingles of their own are linked with nothing. In
each bucket one member leads: the others are compared with it on their whole sets, never all with all. Of a bucket's other pairs only
those in different components matter, and of these only those whose differences from the leader overlap enough; an exact prefix
filter finds them, on the differences that are rarest among the leader's documents. All steps are joins and aggregations, staged in
the shared folder; sets are moved to candidates only, and the rows of a hot key are dealt to many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, hot, joined, pieces, ship, staged
from .textvec import buffer, hashes, mix, words

#: Places of the hashed shingles, bands of a signature, coordinates of a band.
UNIVERSE, BANDS, ROWS = 1 << 20, 36, 5
SEED = 5
#: Ends of links that a task unites at a time.
TOGETHER = 500_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def circulant(universe: int = UNIVERSE, length: int = BANDS * ROWS, seed: int = SEED) -> np.ndarray:
    """A seeded permutation, continued by its beginning, so that place p has the coordinates [p, p + length)."""
    pi = np.random.Generator(np.random.PCG64(seed)).permutation(universe).astype(np.uint32)
    return np.concatenate((pi, pi[:length]))


def shingles(column: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles of ``size`` words; of all its words if it has fewer."""
    data, offsets = buffer(column)
    starts, ends, first = words(data, offsets)
    h = hashes(data, starts, ends)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = min(size, b - a)
        if not n:
            out.append(h[:0])
            continue
        s = h[a : b - n + 1].copy()
        for k in range(1, n):
            s = mix(s * _MUL + h[a + k : b - n + 1 + k])
        out.append(np.unique(mix(s + np.uint64(n))))
    return out


def bands(places: np.ndarray, table: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of the signature of a set of places."""
    k = n_bands * rows
    view = np.lib.stride_tricks.sliding_window_view(table, k)
    low = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), 1024):
        np.minimum(low, view[places[i : i + 1024]].min(axis=0), out=low)
    low = low.reshape(n_bands, rows).astype(np.uint64)
    key = np.arange(1, n_bands + 1, dtype=np.uint64) * _MUL
    for c in range(rows):
        key = mix(key + low[:, c])
    return key


def _signed(size: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, size of the set, its digest, band keys; none for a set so small that only its equal is similar enough."""
        table = circulant()
        top = np.uint64(64 - (UNIVERSE.bit_length() - 1))
        for batch in batches:
            for part in pieces(batch, 1):
                sets = shingles(part.column(1), size)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                keys = [bands((mix(s * _MUL) >> top).astype(np.int64), table).view(np.int64) if len(s) > least else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingles(part.column(1), size)], pa.binary())], names=["id", "set"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, linked: whether 100 * intersection is at least ``percent`` * union on the whole sets."""
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each end of a task's links with the least id that it reaches by them; after every ``TOGETHER`` ends it begins anew."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def found() -> pa.RecordBatch:
        ids = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) >= TOGETHER:
            yield found()
            parent.clear()
    yield found()


def components(edges: DataFrame) -> DataFrame:
    """``id, comp`` for each end of ``edges(a, b)`` that has another: the least id that is reachable.

    Tasks first shorten the links that they hold. Then each id is contracted into the first of its neighbours and itself in a
    seeded random order, and the links are carried over to those, until none is left; a part of the ids goes in each round, long
    chains too. At last the contractions are looked up one after the other, the last ones first.
    """
    edges = staged(edges.select("a", "b").filter("a <> b").mapInArrow(_united, "a long, b long").distinct())
    into: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        order = lambda c: F.struct(F.xxhash64(F.lit(len(into) // 2), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        near = ends.groupBy("a").agg(F.min(order("b")).alias("near"), F.count(F.lit(1)).alias("n"))
        near = staged(near.select("a", F.least(order("a"), "near")["id"].alias("to"), "n"))
        keys = hot(near, ["a"])
        step = near.select("a", "to")
        moved = joined(edges, step, ["a"], "b", keys).select("b", F.col("to").alias("x"))
        moved = joined(moved.withColumnRenamed("b", "a"), step, ["a"], "x", keys).select("x", F.col("to").alias("y"))
        edges = staged(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        into.append(step)
    if not into:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    reached = into.pop()
    while into:
        step = into.pop()
        keys = hot(step.groupBy("to").agg(F.count(F.lit(1)).alias("n")), ["to"])
        further = reached.select(F.col("a").alias("to"), F.col("to").alias("further"))
        reached = staged(joined(step, further, ["to"], "a", keys, "left").select("a", F.coalesce("further", "to").alias("to")))
    groups = staged(reached.groupBy("to").agg(F.min("a").alias("least"), F.count(F.lit(1)).alias("n")))
    found = joined(reached, groups.select("to", "least"), ["to"], "a", hot(groups, ["to"]))
    return staged(found.select(F.col("a").alias("id"), F.least("least", "to").alias("comp")))


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shingle of a batch of sets with its number of sets and one of them."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        h, first, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(ids[first])], names=["h", "n", "id"])


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members`` with ``own``, their shingles that no other set has, without those that these alone keep from any link.

    Nobody shares an own shingle, so an intersection is at most n - own, and a union at least n.
    """
    once = sets.mapInArrow(_rare, "h long, n long, id long").groupBy("h").agg(F.sum("n").alias("n"), F.min("id").alias("id")).filter("n = 1")
    own = staged(once.groupBy("id").agg(F.count(F.lit(1)).alias("own")))
    rows = members.join(own, "id", "left").select("key", "id", "n", F.coalesce("own", F.lit(0)).alias("own"))
    return staged(rows.filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent))


def _against(percent: int):
    """Compare documents with their leaders, and give what decides whether two of a leader's documents can be linked to each other.

    Let D(d) be the difference of d's set and the leader's, both ways; then the difference of two documents is that of their D. A link
    needs a difference of at most c * (sum of sizes), c = (100 - percent) / (100 + percent), so two D must overlap by
    t = (|D(d)| + |D(e)| - c * (|d| + |e|)) / 2 at least, and share one of their first |D| - t + 1 elements in any order common to
    the leader's documents. As t is at most |D(e)| and sizes are within percent, c * (|d| + most of |e|) + 1 elements are enough for
    any partner (``most``); for one that isn't linked to the leader, whose D is larger than c * (|e| + |leader|), half of
    |D| + c * (|d| - |leader|), rounded up, is enough (``half``). A document that is linked needs partners of the second kind only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less, more = 100 - percent, 100 + percent
        for batch in batches:
            linked, differ, most, half, size = [], [], [], [], []
            for x, y, many in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                d = np.setxor1d(x, y, True)
                n, m = len(x), len(y)
                both = (n + m - len(d)) // 2
                size.append(n)
                linked.append(100 * both >= percent * (n + m - both))
                length = less * (n + 100 * n // percent) // more + 1
                half.append(max(0, -(-(len(d) * more + less * (n - m)) // (2 * more))))
                most.append(min(length, half[-1]) if linked[-1] else length)
                differ.append(d.view(np.int64) if many > 1 else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(differ, pa.list_(pa.int64())), pa.array(most, pa.int64()), pa.array(half, pa.int64()), pa.array(size, pa.int64())], names=["id", "lead", "linked", "differ", "most", "half", "n"])

    return run


def _left_over(seen: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of a leader's documents that are in different components, one of them not linked to the leader, and may be linked.

    The order of the prefix filter is by the number of the leader's documents that differ in an element; those of one document alone
    come first and are never joined. Of the elements that two D share, the first leaves t - 1 after it in both, which turns most
    other pairs away (``gap`` is |D|).
    """
    known = staged(seen.filter("size(differ) > 0").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    leads = staged(known.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.min("linked").alias("all"), (F.min("comp") == F.max("comp")).alias("one")))
    known = joined(known, leads.filter("not all and not one").select("lead"), ["lead"], "id", hot(leads, ["lead"]), "left_semi")
    marks = staged(known.select("lead", "id", "linked", "comp", "most", "half", "n", F.size("differ").alias("gap"), F.xxhash64("differ").alias("version"), F.explode("differ").alias("mark")))
    often = staged(marks.groupBy("lead", "mark").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
    shared = joined(marks, often, ["lead", "mark"], "id", hot(often, ["lead", "mark"], "often"))
    facts = ["lead", "id", "linked", "comp", "most", "half", "n", "gap"]
    # an id that several rows carry has a version for each of its sets
    lists = shared.groupBy(*facts, "version").agg(F.array_sort(F.collect_set(F.struct("often", "mark"))).alias("found"))
    lists = lists.withColumn("before", F.col("gap") - F.size("found")).withColumn("found", F.slice("found", F.lit(1), F.greatest(F.col("most") - F.col("before"), F.lit(0)).cast("int")))
    first = lists.select(*facts, "before", F.posexplode("found").alias("at", "e"))
    first = staged(first.select(*facts, (F.col("before") + F.col("at")).alias("at"), F.col("e.mark").alias("mark")).withColumn("deep", F.col("at") >= F.col("half")))
    other = first.select("lead", "mark", F.col("id").alias("with"), F.col("comp").alias("other"), F.col("linked").alias("close"), F.col("deep").alias("far"), F.col("gap").alias("its_gap"), F.col("n").alias("m"), F.col("at").alias("its_at"))
    room = f"2 * {100 + percent} * least(gap - at, its_gap - its_at) >= (gap + its_gap) * {100 + percent} - (n + m) * {100 - percent}"
    pairs = first.filter("not linked").join(other, ["lead", "mark"]).filter(f"comp <> other and (close or (id < with and not (deep or far))) and {room}")
    return pairs.select(F.least("id", "with").alias("a"), F.greatest("id", "with").alias("b")).distinct()


def _links(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """``id, comp`` of the documents in ``members(key, id, n)`` that are linked to others."""
    ids = staged(members.select("id").distinct())
    sets = staged(docs.join(ids, docs.doc_id == ids.id, "left_semi").dropDuplicates(["doc_id", "text"]).select("doc_id", "text").mapInArrow(_sets(size), "id long, set binary"))
    members = _linkable(members, sets, percent)
    # the member with the least of its own leads each bucket: most others are near it
    best = F.struct((F.col("own") / F.col("n")).alias("r"), "id")
    leads = staged(members.groupBy("key").agg(F.min(best)["id"].alias("lead"), F.count(F.lit(1)).alias("many")))
    follow = joined(members, leads.filter("many > 1").select("key", "lead"), ["key"], "id", hot(leads, ["key"], "many"))
    follow = staged(follow.filter("id <> lead").select("id", "lead").distinct())
    counts = staged(follow.groupBy("lead").agg(F.count(F.lit(1)).alias("many")))
    left, right = sets.withColumnRenamed("set", "x"), sets.select(F.col("id").alias("lead"), F.col("set").alias("y"))
    both = joined(follow.join(left, "id"), right.join(counts, "lead"), ["lead"], "id", hot(counts, ["lead"], "many"))
    seen = staged(both.select("id", "lead", "x", "y", "many").mapInArrow(_against(percent), "id long, lead long, linked boolean, differ array<long>, most long, half long, n long"))
    comps = components(seen.filter("linked").select(F.col("id").alias("a"), F.col("lead").alias("b")))
    pairs = _left_over(seen, comps, percent)
    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    late = staged(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long, linked boolean").filter("linked").select("a", "b"))
    if late.isEmpty():
        return comps
    # the components that late links unite
    of = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    late = late.join(of, "a", "left").join(of.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    late = staged(late.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    wider = components(late).select(F.col("id").alias("comp"), F.col("comp").alias("wider"))
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    inner = joined(comps, wider, ["comp"], "id", hot(sizes, ["comp"]), "left").select("id", F.coalesce("wider", "comp").alias("comp"))
    ends = wider.select(F.col("comp").alias("id"), F.col("wider").alias("comp"))
    return staged(inner.unionByName(ends.join(comps.select("id"), "id", "left_anti")))


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row.

    A-Z are lower-cased, words are runs without ASCII white space, and two documents are linked when 100 * intersection is at least
    ``percent`` * union of their sets of distinct ``size``-word shingles (64-bit hashes of them; two differ with a chance of all but
    2**-64). A text with fewer words is one shingle; a null, empty or wordless one has none and is linked with nothing. Repeated
    rows are linked with each other unless they are empty. A null doc_id is kept with a null component, unless a row with a doc_id
    has the same set: then it goes with that one's group. Rows that share a doc_id are one document, with the links of all their
    texts. Other columns are dropped; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # below 100 / (100 - percent) shingles one shingle more or less is too much
    alone = 100 // max(1, 100 - percent) - 2 if percent > 50 else 0
    signed = staged(docs.mapInArrow(_signed(size, alone), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    full = signed.filter("n_shingles > 0")
    classes = staged(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    # of each class one row stands for it; equal ids with different texts each stay with their own set
    reps = full.filter("size(bands) > 0").join(classes.select(F.col("digest").alias("d"), "rep"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep")), "left_semi").dropDuplicates(["doc_id", "digest"])
    keyed = staged(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key")))
    buckets = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    members = staged(joined(keyed, buckets.select("key"), ["key"], "id", hot(buckets, ["key"], "many"), "left_semi"))
    comps = _links(docs, members, size, percent)
    wide = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
    rows = joined(full.select("doc_id", "n_shingles", "digest"), wide, ["digest"], "doc_id", hot(classes, ["digest"])).select("doc_id", "n_shingles", "component_id")
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` of which one document stays for each group, with all their columns; rows that share its id stay with it.

    Rows without text, words or doc_id stay, and so does an empty table. Rows are matched by the ids that go, as in ``exact_dedup``.
    """
    gone = free("_gone", docs)
    ids = near_groups(docs, size, percent, text, key).filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    drop = staged(ids.filter("not kept").select(F.col("doc_id").alias(gone)))
    return docs.join(drop, F.col(key) == F.col(gone), "left_anti")
