"""Language-model scores by a weighted backoff automaton over words.

Every word seen in training is a state; a bigram is an arc to its second word's state, weighted by its smoothed probability
(c(uv) + MU * P(v)) / (c(u) + MU); a state's failure arc leads to the root with weight MU / (c(u) + MU), and the root has an arc for
each word with P(v) = (c(v) + 1) / (N + V + 1), unknown words sharing one. A text is one left-to-right traversal from the
beginning state, which carries the state and adds log10 weights; the texts of a chunk advance side by side.

Counts cover all documents of the learning folds and no table of them is ever in one place: documents are staged as chunks of word
numbers; a chunk asks for the words and bigrams it has, with its own counts, by 2**``FAN_BITS`` ranges of their hashes. Where that
many ranges are too few, parties of as many askers merge what they have in a range and ask on by narrower ranges, level by level, so
that messages grow with the input and not with its square. The last ranges add up what was sent and answer; answers go back the same
way. A chunk then builds the part of the automaton that its texts can reach, and traverses it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, staged
from .textvec import buffer, hashes, mix, words

MU = 200.0
FOLDS, HELD = 7, 2
#: Bytes of text in a chunk, and keys that a range holds at last, about.
CHUNK_BYTES, RANGE_KEYS = 16 << 20, 4_000_000
#: Bits of a hash that a level deals by.
FAN_BITS = 6
#: Tokens that one lane of a traversal takes at most.
LANE = 512
#: The end token, and the state before the first word.
END, BEGIN = mix(np.arange(2, dtype=np.uint64) + np.uint64(0xE4D))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    """Compressed bytes, the lowest of all numbers first."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return _CODEC.compress(planes.tobytes(), asbytes=True) if len(a) else b""


def unpack(raw: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(raw, n * size), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(raw, n, np.uint64), dtype=np.uint64)


def is_held_out(key: int | None) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS == HELD


_CHUNK = "chunk long, ids array<long>, lengths array<int>, n_words long, vocabulary binary, n_tokens long, stream binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as numbers into their chunk's sorted vocabulary, an end token after each."""
    ids: list = []
    tokens: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        vocabulary, stream = np.unique(np.concatenate(tokens), return_inverse=True)
        row = [uuid.uuid4().int >> 65, ids, np.concatenate(lengths), len(vocabulary), pack_sorted(vocabulary), len(stream), pack(stream.astype(np.uint32))]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _CHUNK.split(", ")])

    for batch in batches:
        for part in pieces(batch, 1):
            data, offsets = buffer(part.column(1))
            starts, ends, first = words(data, offsets)
            h = hashes(data, starts, ends)
            tokens.append(np.insert(h, first[1:], END))
            lengths.append((np.diff(first) + 1).astype(np.int32))
            ids += part.column(0).to_pylist()
            size += len(data)
            if size >= CHUNK_BYTES:
                yield flush()
                ids, tokens, lengths, size = [], [], [], 0
    if ids:
        yield flush()


class Chunk:
    """A chunk's tokens, and its distinct bigrams sorted by their hashes."""

    def __init__(self, row: dict) -> None:
        self.ids, self.lengths = row["ids"], np.asarray(row["lengths"], np.int64)
        self.vocabulary = unpack_sorted(row["vocabulary"], row["n_words"])
        self.stream = unpack(row["stream"], row["n_tokens"], np.uint32).astype(np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)))
        self.held = np.array([is_held_out(x) for x in self.ids], bool)
        before = np.empty(len(self.stream), np.int64)
        before[1:] = self.stream[:-1]
        before[self.begins[:-1]] = len(self.vocabulary)  # the begin state
        self.before = before
        h = np.append(self.vocabulary, BEGIN)
        self.pairs, self.sample, self.pair = np.unique(mix(h[before] * _MUL + self.vocabulary[self.stream]), return_index=True, return_inverse=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of words and of bigrams, in the documents to learn from."""
        learn = np.repeat(~self.held, self.lengths)
        return np.bincount(self.stream[learn], minlength=len(self.vocabulary)), np.bincount(self.pair[learn], minlength=len(self.pairs))


_ASKED = "kind int, prefix long, sender long, n long, keys binary, counts binary"
_TOLD = "kind int, prefix long, sender long, n long, counts binary, tokens long, types long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table([pa.array(x, _KINDS[kind]) for x, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _dealt(kind: int, prefix: int, depth: int, sender: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple]:
    """Messages of sorted keys that begin with ``depth`` times ``bits`` bits of ``prefix``, by their next ``bits``."""
    shift = 64 - bits * (depth + 1)
    bounds = np.array([((prefix << bits) + d) << shift for d in range(1, 1 << bits)], np.uint64)
    cut = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    for d, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if i < j:
            yield kind, (prefix << bits) + d, sender, j - i, pack_sorted(keys[i:j]), pack(counts[i:j])


def _asked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                rows = []
                for kind, (keys, counts) in enumerate(zip((chunk.vocabulary, chunk.pairs), chunk.counts(), strict=True)):
                    rows += _dealt(kind, 0, 0, row["chunk"], keys, counts.astype(np.uint64), bits)
                yield from _rows(_ASKED, rows).to_batches()

    return run


def _summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of some messages, their sums, and where each message's keys are among them, one message after the other."""
    keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
    counts = np.concatenate([unpack(r["counts"], r["n"], np.uint64) for r in rows])
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, counts).astype(np.uint64), where


def _answers(rows: list[dict], sums: np.ndarray, where: np.ndarray, total: bool) -> pa.Table:
    """Each message's sums in the order of its keys; the first row carries the range's number of tokens and types if it is the last one to sum."""
    at, out = 0, []
    for r in rows:
        facts = (int(sums.sum()), int((sums > 0).sum())) if total and not at else (0, 0)
        out.append((r["kind"], r["prefix"], r["sender"], r["n"], pack(sums[where[at : at + r["n"]]]), *facts))
        at += r["n"]
    return _rows(_TOLD, out)


def _merged(bits: int, depth: int):
    """A party's messages as one sender's, dealt on by narrower ranges."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, sums, _ = _summed(rows)
        return _rows(_ASKED, list(_dealt(rows[0]["kind"], rows[0]["prefix"], depth, rows[0]["party"], keys, sums, bits)))

    return run


def _added(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    _, sums, where = _summed(rows)
    return _answers(rows, sums, where, True)


def _returned(asked: pa.Table, told: pa.Table) -> pa.Table:
    """What a party was told about its merged keys, told to its members."""
    rows = asked.to_pylist()
    _, _, where = _summed(rows)
    parts = [unpack(r["counts"], r["n"], np.uint64) for r in sorted(told.to_pylist(), key=lambda r: r["child"])]
    return _answers(rows, np.concatenate(parts), where, False)


def _exchanged(chunks: DataFrame, wanted: int) -> tuple[DataFrame, int, int]:
    """Rows of ``_TOLD`` with the global counts of each chunk's keys, and the numbers of tokens and of types."""
    bits, levels = FAN_BITS, 1
    while (RANGE_KEYS << bits * levels) < wanted:
        levels += 1
    sent, senders, parties = chunks.mapInArrow(_asked(bits), _ASKED), chunks.count(), []
    for depth in range(1, levels):
        senders = (senders + (1 << bits) - 1) >> bits
        party = F.pmod(F.xxhash64("sender"), F.lit(senders)) if depth == 1 else F.shiftright("sender", bits)
        parties.append(staged(sent.withColumn("party", party)))
        sent = parties[-1].groupBy("kind", "prefix", "party").applyInArrow(_merged(bits, depth), _ASKED)
    told = staged(sent.groupBy("kind", "prefix").applyInArrow(_added, _TOLD))
    sums = told.filter("kind = 0").agg(F.sum("tokens"), F.sum("types")).first()
    for rows in reversed(parties):
        key = ["kind", "prefix", "party"]
        back = told.select("kind", F.shiftright("prefix", bits).alias("prefix"), F.col("sender").alias("party"), F.col("prefix").alias("child"), "n", "counts")
        told = staged(rows.groupBy(*key).cogroup(back.groupBy(*key)).applyInArrow(_returned, _TOLD))
    return told, int(sums[0] or 0), int(sums[1] or 0)


class Automaton:
    """States are word numbers, then the begin state, then the root. ``arcs`` are sorted (state, word) pairs with log10 weights."""

    def __init__(self, words_: np.ndarray, pairs: np.ndarray, before: np.ndarray, after: np.ndarray, starts: int, tokens: int, types: int, mu: float = MU) -> None:
        n = len(words_)
        self.root, self.begin = n + 1, n
        p = (words_ + 1.0) / (tokens + types + 1.0)
        self.root_arc = np.log10(p)
        context = np.append(words_, starts).astype(float)
        self.failure = np.append(np.log10(mu / (context + mu)), 0.0)
        #: The state after a word: its own if training saw it, else the root.
        self.next = np.where(words_ > 0, np.arange(n), self.root)
        seen = pairs > 0
        keys = before[seen] << 32 | after[seen]
        order = np.argsort(keys)
        self.arcs = keys[order]
        self.weights = np.log10((pairs[seen] + mu * p[after[seen]]) / (context[before[seen]] + mu))[order]

    def traverse(self, stream: np.ndarray, begins: np.ndarray, lengths: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities by the automaton, and by its root alone, of texts that advance side by side.

        A text of more than ``lane`` tokens is handed from lane to lane: the state that a word leads to is the word's alone.
        """
        lanes = np.maximum(-(-lengths // lane), 1)
        owner = np.repeat(np.arange(len(lengths)), lanes)
        skip = (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * lane
        size = np.minimum(lengths[owner] - skip, lane)
        order = np.argsort(-size, kind="stable")
        owner, skip, left = owner[order], skip[order], size[order]
        at = begins[:-1][owner] + skip
        state = np.where(skip > 0, self.next[stream[np.maximum(at - 1, 0)]], self.begin) if len(stream) else np.full(len(owner), self.begin)
        total, plain = np.zeros(len(owner)), np.zeros(len(owner))
        alive = len(owner)
        for step in range(int(left[0]) if len(left) else 0):
            while alive and left[alive - 1] <= step:
                alive -= 1
            word = stream[at[:alive] + step]
            key = state[:alive] << 32 | word
            k = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
            hit = self.arcs[k] == key if len(self.arcs) else np.zeros(alive, bool)
            root = self.root_arc[word]
            total[:alive] += np.where(hit, self.weights[k] if len(self.arcs) else 0.0, self.failure[state[:alive]] + root)
            plain[:alive] += root
            state[:alive] = self.next[word]
        return np.bincount(owner, total, len(lengths)), np.bincount(owner, plain, len(lengths))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(tokens: int, types: int, starts: int, mu: float):
    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        answers = sorted(told.to_pylist(), key=lambda r: (r["kind"], r["prefix"]))
        counts = [np.concatenate([np.empty(0, np.uint64), *(unpack(r["counts"], r["n"], np.uint64) for r in answers if r["kind"] == kind)]).astype(np.int64) for kind in (0, 1)]
        for row in chunks.to_pylist():
            chunk = Chunk(row)
            machine = Automaton(counts[0], counts[1], chunk.before[chunk.sample], chunk.stream[chunk.sample], starts, tokens, types, mu)
            score, base = machine.traverse(chunk.stream, chunk.begins, chunk.lengths)
            known = np.add.reduceat((counts[0] > 0)[chunk.stream].astype(np.int64), chunk.begins[:-1])
            rows.append((chunk.ids, chunk.held, chunk.lengths, known, np.full(len(score), tokens), base, score))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.concat_arrays([pa.array(r[i], k) for r in rows]) if rows else pa.array([], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", mu: float = MU) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Words are runs without ASCII white space, A-Z lower-cased, known by 64-bit hashes; then comes one end token, which alone makes
    up a null, empty or blank text. Learnt from rows whose crc32(id as text) mod 7 is not 2 (a null id counts as empty text).
    Repeated rows count and score each; without any row to learn from, all words are unknown. ``base_score`` is the root's alone.
    """
    ship(docs.sparkSession)
    chunks = staged(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_chunks, _CHUNK))
    wanted = chunks.agg(F.sum(F.col("n_words") + F.col("n_tokens"))).first()[0] or 0
    told, tokens, types = _exchanged(chunks, wanted)
    learnt = chunks.select(F.explode("ids").alias("id")).filter(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD).count()
    answers = told.select(F.col("sender").alias("chunk"), "kind", "prefix", "n", "counts").groupBy("chunk")
    return chunks.groupBy("chunk").cogroup(answers).applyInArrow(_scored(tokens, types, learnt, mu), _SCORES)
