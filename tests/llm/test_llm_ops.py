"""The ten operators against brute force, round trips, held-out accuracy, and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import io
import math
import random
import re
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbora.llm import common, exact_dedup, lm, media, mixing, near_dedup, packing, pii, quality, textvec, toxicity
from arbora.llm.sharding import stratified_shards


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def texts_of(odd):
    return [(r.doc_id, r.text or "") for r in odd.collect()]


# ---- words and hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words_agree_with_split(texts):
    data, offsets = textvec.buffer(pa.array(texts, pa.string()))
    starts, ends, first = textvec.words(data, offsets)
    want = [(t or "").encode().split() for t in texts]
    got = [[bytes(data[i:j]) for i, j in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == want
    h = textvec.hashes(data, starts, ends)
    flat = [w.lower() for ws in want for w in ws]
    assert len(set(h.tolist())) == len(set(flat))


# ---- 1 media


def test_media_round_trip_and_features(odd):
    found = rows(media.media_features(odd, keep_media=True))
    want = collections.Counter()
    for key, t in texts_of(odd):
        raw = t.encode()
        full = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        want[key, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == want
    by = {}
    for r in found:
        stored = bytes(r["media"])
        assert (len(stored), hashlib.sha256(stored).hexdigest()) == (r["media_bytes"], r["media_sha256"])
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            assert hashlib.sha256(w.readframes(w.getnframes())).hexdigest() == r["payload_sha256"]
        assert by.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
        assert len(r["times"]) == len(r["codes"])
        assert r["times"] == sorted(r["times"])
    assert len(set(by.values())) > 0.6 * len(by)


def test_a_tone_peaks_where_it_should():
    t = np.arange(5760)
    tone = (128 + 100 * np.sin(2 * np.pi * 24 * t / media.FRAME)).astype(np.uint8).tobytes()
    frames, bins = media.peaks(tone, 1)
    assert set(bins.tolist()) == {24}
    times, codes = media.fingerprints(tone)
    assert len(times) == len(codes) > 0


def test_blocks_of_frames_join(monkeypatch):
    data = random.Random(1).randbytes(576 * 40)
    whole = media.fingerprints(data)
    monkeypatch.setattr(media, "_BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.fingerprints(data), strict=True))


# ---- 2 personal data


def _patterns(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "0", ".", "@", "a", "b-", "+", "-", " ", "(", ")", "4111111111111111", "x@y.z", "1.2.3.4", "\n", "é", "_", "%", "+1 (988) 555-2485"]), max_size=25).map("".join))
def test_base_spans_are_the_patterns(t):
    assert pii.base_spans(t) == _patterns(t)


def test_pii_query_columns(odd, docs):
    for table in (odd, docs):
        want = collections.Counter()
        for key, t in texts_of(table):
            spans = _patterns(t)
            joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
            want[(key, *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest())] += 1
        found = rows(pii.pii_spans(table))
        assert collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found) == want


def test_the_field_carries_a_label_to_a_repetition(spark):
    told = "Call +1 (988) 555-2485 now. "
    texts = [f"{told}Word {i} here, version 4.0. then 555-2485 again" if i % 2 else f"{told}Only {i}" for i in range(40)]
    found = rows(pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for r in found:
        t = texts[r["doc_id"]]
        got = [t[int(a) : int(b)] for _, a, b in (s.split(":") for s in r["spans"].split(","))]
        assert got == (["+1 (988) 555-2485", "555-2485"] if r["doc_id"] % 2 else ["+1 (988) 555-2485"])


def test_messages_pull_a_doubtful_node_along():
    field = pii.Field.trained([])
    labels, bits = np.array([3, pii.OUTSIDE]), np.zeros(2, np.int64)
    alone = field.marginals(bits, labels, np.empty((0, 3), np.int64))
    linked = field.marginals(bits, labels, np.array([[0, 1, 1]]))
    assert linked[1, 3] > 0.8 > alone[1, 3]


# ---- 3 quality, 9 toxicity


def _held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 0


def test_discriminant_is_the_gaussian_posterior():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 1, (400, 10)), rng.normal(2, 0.5, (600, 10))))
    y = np.repeat([0, 1], [400, 600])
    m = quality.fit(x, y, 1)
    for k in (0, 1):
        cov = np.linalg.inv(m.factors[k].T @ m.factors[k])
        d = x[:5] - m.means[k]
        want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        assert np.allclose(((d @ m.factors[k].T) ** 2).sum(1), want)
        assert np.isclose(m.log_dets[k], np.linalg.slogdet(cov)[1])
    assert ((m.score(x) >= 0.5) == y).mean() > 0.99
    assert quality.fit(np.zeros((0, 10)), np.zeros(0, int)).score(np.zeros((2, 10))).tolist() == [0.5, 0.5]


def test_quality_on_held_out_rows(docs, labels, spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tags = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = rows(quality.quality_scores(big, tags).join(tags, "doc_id"))
    out = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == _held(r["doc_id"]) for r in found)
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.95
    kept = {r.doc_id for r in quality.quality_filter(big, tags).select("doc_id").collect()}
    scored = {r.doc_id for r in quality.quality_scores(big, tags).filter("predicted = 1").collect()}
    assert kept == scored


def test_toxicity_on_held_out_rows(spark):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tags = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = rows(toxicity.toxicity_scores(big, tags).join(tags, "doc_id"))
    out = [r for r in found if r["held_out"]]
    hit = sum(r["predicted"] and r["toxic"] for r in out)
    assert hit / sum(r["toxic"] for r in out) > 0.85
    assert hit / sum(r["predicted"] for r in out) > 0.85


def test_toxic_sentences_are_located(spark):
    r = random.Random(2)
    calm = ["water", "soil", "seed", "rain", "bed", "path", "leaf"]
    texts, tags = [], []
    for i in range(400):
        s = [" ".join(r.choice(calm) for _ in range(8)).capitalize() for _ in range(5)]
        if i % 3 == 0:
            s[i % 5] += " you rotten é fool"
        texts.append(". ".join(s) + ".")
        tags.append((i, 1, int(i % 3 == 0)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows(toxicity.toxicity_scores(docs, spark.createDataFrame(tags, "doc_id long, quality int, toxic int")))
    for x in found:
        assert x["predicted"] == (x["doc_id"] % 3 == 0)
        spans = [texts[x["doc_id"]][o["start"] : o["end"]] for o in x["offending"]]
        assert [s.endswith("rotten é fool") for s in spans] == [True] * (x["doc_id"] % 3 == 0)


def test_noisy_or():
    m = toxicity.Model(np.empty(0, np.uint64), np.empty(0), -1.0)
    score, n, z, _ = m.score(pa.array(["a b. c! d", "", "..."]))
    p = 1 / (1 + math.e)
    assert np.allclose(score, [1 - (1 - p) ** 3, 0, 0])
    assert n.tolist() == [3, 0, 0]


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_take_odd_inputs(score, odd, nothing, labels):
    found = rows(score(odd, labels))
    assert len(found) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == _held(r["doc_id"]) for r in found)
    assert score(nothing, labels).count() == 0
    none = rows(score(odd, labels.limit(0)))
    assert len(none) == odd.count()
    doubled = labels.union(labels).union(labels.sparkSession.createDataFrame([(None, None, None)], labels.schema))
    assert len(rows(score(odd, doubled))) == odd.count()


# ---- 4 sharding


def _shards(found, n):
    by = collections.defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    return by


def test_shards_hold_the_mixture(odd, nothing, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.lit("hot")).otherwise(F.col("source")))
    found = rows(stratified_shards(docs))
    by = _shards(found, 16)
    total = collections.Counter(r["stratum"] for r in found)
    for v in by.values():
        have = collections.Counter(r["stratum"] for r in v)
        assert all(abs(have[s] - n / 16) <= (8 if s == "=hot" else 2) for s, n in total.items())
    want = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(want[r["doc_id"]].encode()) + 1, zlib.crc32(want[r["doc_id"]].encode())) for r in found)
    # brute force: the same order from the same hashes
    u = {r.doc_id: r.u for r in docs.select("doc_id", (F.shiftrightunsigned(F.xxhash64(F.lit(20240), "doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 1).cast("long")), 11).cast("double") * 2.0**-53).alias("u")).collect()}
    strata = collections.defaultdict(list)
    for r in found:
        strata[r["stratum"]].append(r["doc_id"])
    at = {}
    phase = {r.s: r.p for r in spark.createDataFrame([(s,) for s in strata], "s string").select("s", (F.shiftrightunsigned(F.xxhash64(F.lit(20241), "s"), 11).cast("double") * 2.0**-53).alias("p")).collect()}
    for s, ids in strata.items():
        for i, key in enumerate(sorted(ids, key=lambda k: (u[k], k))):
            at[key] = (i + phase[s]) / len(ids)
    stratum = {r["doc_id"]: r["stratum"] for r in found}
    order = sorted(at, key=lambda k: (at[k], u[k], stratum[k], k))
    assert {r["doc_id"]: r["shard"] for r in found} == {k: i * 16 // len(order) for i, k in enumerate(order)}
    _shards(rows(stratified_shards(odd)), 16)
    assert stratified_shards(nothing).count() == 0


# ---- 5 language model


def _tokens(t):
    return [*(t or "").encode().lower().split(), "END"]


def test_lm_is_the_brute_force_model(odd, docs):
    for table in (odd, docs):
        data = [(r.doc_id, r.text) for r in table.collect()]
        uni, bi, starts = collections.Counter(), collections.Counter(), 0
        for key, t in data:
            if zlib.crc32(("" if key is None else str(key)).encode()) % 7 != 2:
                w = _tokens(t)
                uni.update(w)
                bi.update(zip(["BEGIN", *w], w, strict=False))
                starts += 1
        n, v = uni.total(), len(uni)
        want = collections.Counter()
        for key, t in data:
            w = _tokens(t)
            base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
            full = sum(math.log10((bi[a, b] + lm.MU * (uni[b] + 1) / (n + v + 1)) / ((starts if a == "BEGIN" else uni[a]) + lm.MU)) for a, b in zip(["BEGIN", *w], w, strict=False))
            want[key, zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2, len(w), sum(uni[x] > 0 for x in w), n, round(base, 5), round(full, 5)] += 1
        found = rows(lm.lm_scores(table))
        assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in found) == want


@pytest.mark.parametrize("bits", [1, 3])
def test_lm_levels_and_chunks_change_nothing(docs, bits, monkeypatch):
    """Ranges that are dealt level by level, with parties that merge, give what one level gives."""
    want = sorted((r["doc_id"], r["score"]) for r in rows(lm.lm_scores(docs)))
    monkeypatch.setattr(lm, "RANGE_KEYS", 3_000)
    monkeypatch.setattr(lm, "FAN_BITS", bits)
    assert sorted((r["doc_id"], r["score"]) for r in rows(lm.lm_scores(docs.repartition(7)))) == want


def test_lanes_hand_over_their_state():
    r = np.random.default_rng(5)
    words, starts = np.array([6, 0, 3, 9, 1]), 4
    before, after, pairs = np.array([0, 0, 2, 3, 5]), np.array([0, 3, 3, 1, 0]), np.array([2, 3, 1, 0, 4])
    m = lm.Automaton(words, pairs, before, after, starts, 19, 4)
    lengths = np.array([1, 40, 0, 7, 13])
    begins = np.concatenate(([0], np.cumsum(lengths)))
    stream = r.integers(0, 5, begins[-1])
    whole = m.traverse(stream, begins, lengths)
    for lane in (1, 3, 13):
        for a, b in zip(whole, m.traverse(stream, begins, lengths, lane), strict=True):
            assert np.allclose(a, b)


def test_automaton_is_a_distribution():
    words, types = np.array([5, 3, 0, 2]), 3
    before, after, pairs = np.array([0, 0, 1, 3]), np.array([1, 3, 0, 1]), np.array([3, 2, 3, 2])
    m = lm.Automaton(words, pairs, before, after, 2, 10, types)
    for state in range(4):
        stream = np.array([[state, w] for w in range(4)]).ravel()
        begins, lengths = np.arange(0, 9, 2), np.full(4, 2)
        total, _ = m.traverse(stream, begins, lengths)
        one, _ = m.traverse(np.array([state]), np.array([0, 1]), np.array([1]))
        assert math.isclose(sum(10 ** (total - one[0])), 1, rel_tol=1e-9)  # three known words and the unknown one


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_numbers_come_back(values):
    a = np.array(sorted(values), np.uint64)
    assert (lm.unpack_sorted(lm.pack_sorted(a), len(a)) == a).all()
    assert (lm.unpack(lm.pack(a), len(a), np.uint64) == a).all()


def test_lm_empty_table(nothing):
    assert lm.lm_scores(nothing).count() == 0


# ---- 6 exact dedup


def _groups(table):
    by = collections.defaultdict(list)
    for key, t in texts_of(table):
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(key)
    return by


@pytest.mark.parametrize("bits", [128, 6])
def test_exact_groups(odd, docs, bits):
    for table in (odd, docs):
        want = collections.Counter()
        for t, keys in _groups(table).items():
            keep = min((k for k in keys if k is not None), default=None)
            for i, k in enumerate(sorted(keys, key=lambda k: (k is None, k))):
                want[k, keep, len(keys), i == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
        found = rows(exact_dedup.exact_groups(table, bits=bits))
        assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found) == want


def test_exact_dedup_keeps_one_row_of_each(odd, nothing):
    left = exact_dedup.exact_dedup(odd)
    assert left.columns == odd.columns
    want = sorted((str(min((k for k in keys if k is not None), default=None)), t) for t, keys in _groups(odd).items())
    assert sorted((str(r.doc_id), re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in left.collect()) == want
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_chunks_follow_the_content():
    data = random.Random(7).randbytes(60_000)
    a, b = exact_dedup.cuts(data), exact_dedup.cuts(b"shifted " + data)
    assert a[-1] == len(data)
    assert all(0 < j - i <= exact_dedup.MOST for i, j in zip([0, *a], a, strict=False))
    assert len({x + 8 for x in a} & set(b)) > 0.9 * len(a)
    assert max(exact_dedup.cuts(b"\0" * 50_000)) == 50_000


def test_cuts_agree_over_blocks():
    data = random.Random(8).randbytes((1 << 20) + 5000)
    g = 0
    ends, start = [], 0
    gear = exact_dedup._GEAR.tolist()
    for i, c in enumerate(data):
        g = ((g << 1) + gear[c]) & 0xFFFFFFFF
        if i + 1 - start >= exact_dedup.LEAST and g >> (32 - exact_dedup.MASK_BITS) == 0 or i + 1 - start == exact_dedup.MOST:
            ends.append(i + 1)
            start = i + 1
    assert exact_dedup.cuts(data) == (ends if ends[-1] == len(data) else [*ends, len(data)])


# ---- 7 mixing


def test_poisson_inversion():
    for rate in (0.0, 0.3, 1.0, 7.5, 900.0):
        cdf = np.array(mixing.poisson_cdf(rate))
        pmf = np.diff(cdf, prepend=0)
        assert cdf[-1] == 1
        assert (pmf >= 0).all()
        assert np.isclose((pmf * np.arange(len(pmf))).sum(), rate, rtol=1e-6)


def test_mixing_is_brute_force(docs, odd, nothing):
    for table, weights in ((docs, None), (odd, None), (docs, {"src0": 3.0, "src1": 1.0, "absent": 5.0}), (odd, {"hot": 1.0, None: 1.0}), (docs, mixing.graded), (odd, mixing.graded)):
        u = F.shiftrightunsigned(F.xxhash64(F.lit(977), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), 11).cast("double") * 2.0**-53
        data = table.select("doc_id", "source", u.alias("u")).collect()
        n = collections.Counter(r.source for r in data)
        if callable(weights):
            w = {s: 1 + (0 if s is None else zlib.crc32(s.encode()) % 4) for s in n}
        else:
            w = {s: n[s] ** 0.5 for s in n} if weights is None else {s: weights[s] for s in n if s in weights}
        want = collections.Counter()
        for r in data:
            if r.source in w:
                cdf = mixing.poisson_cdf(len(data) * w[r.source] / sum(w.values()) / n[r.source])
                want[r.doc_id] += sum(c <= r.u for c in cdf)
        out = mixing.mixed(table, weights)
        assert out.columns[: len(table.columns)] == table.columns
        assert len(out.columns) == len(set(out.columns)) == len(table.columns) + 3
        assert collections.Counter(r.doc_id for r in out.collect()) == +want
    assert mixing.mixed(nothing).count() == 0


def test_counts_are_found_by_halving(spark):
    for rate in (0.0, 0.3, 2.5, 40.0, 900.0):
        cdf = mixing.poisson_cdf(rate)
        df = spark.range(300).select((F.col("id") / 300).alias("u"), F.array(*map(F.lit, cdf)).alias("cdf"))
        for r in df.select("u", mixing.inverted("cdf", "u").alias("n")).collect():
            assert r.n == sum(c <= r.u for c in cdf)


def test_mixing_meets_its_weights(spark):
    table = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
    out = mixing.mixed(table, {"a": 1, "b": 3})
    share = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(share["a"] - 7_500) < 400
    assert abs(share["b"] - 22_500) < 700
    keys = [r.mix_key for r in out.select("mix_key").collect()]
    assert keys == sorted(keys)


# ---- 8 packing


def _checked(found, data, path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    used = 0
    for v in sequences.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
        used += at
    for key, copies in data.items():
        got = collections.Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[key])
        want = collections.Counter()
        for t in copies:
            ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
            at = 0
            for start, length, _, total in sorted({g for g in got if g[3] == len(ids)}):
                if start == at and (start, length, zlib.crc32(ids[at : at + length].tobytes()), total) in got:
                    want[start, length, zlib.crc32(ids[at : at + length].tobytes()), total] += 1
                    at += length
            assert at == len(ids)
        assert got == want
    return used / (packing.CAPACITY * len(sequences))


def test_packing(docs, odd, nothing):
    path = packing.default_tokenizer()
    for table, least in ((docs, 0.97), (odd, 0.9)):
        data = collections.defaultdict(list)
        for k, t in texts_of(table):
            data[k].append(t)
        assert _checked(rows(packing.packed(table)), data, path) > least
    assert packing.packed(nothing).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "Word", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "don't", "12", "é", "日本", " ", "!", "\r\n", "<|endoftext|>", "a.b,", "ǅ", "½", "x́", " ", "\x1f"]), max_size=16).map("".join))
def test_cached_ids_are_the_tokenizers(t):
    e = packing.encoder(packing.default_tokenizer())
    assert np.frombuffer(e(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids


def test_cuts_spare_padding_and_leave_no_shreds():
    c = packing.CAPACITY
    padding = lambda x: c / (c // x) - x
    for n in range(1, 3 * c + 1):
        got = packing.lengths(n)
        assert sum(got) == n
        assert min(got) >= min(n, packing.LEAST)
        if n <= c:
            assert all(x == c // (c // x) for x in got[:-1])
            assert sum(map(padding, got)) + packing.PRICE * (len(got) - 1) <= padding(n) + 1e-9
            one = [padding(a) + padding(n - a) + packing.PRICE for a in range(packing.LEAST, n - packing.LEAST + 1)]
            if len(got) == 2:
                assert sum(map(padding, got)) + packing.PRICE <= min(one) + 1  # capacity // i is rounded down


def test_what_is_left_is_packed_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPREAD", 20)
    r = random.Random(8)
    data = {i: [" ".join("word" for _ in range(r.randrange(40)))] for i in range(150)}
    df = spark.createDataFrame([(k, t) for k, [t] in data.items()], "doc_id long, text string")
    assert _checked(rows(packing.packed(df)), data, packing.default_tokenizer()) > 0


# ---- 10 near dedup


def _near(data, size, percent):
    sets, parent = {}, {}
    for key, t in data:
        w = t.encode().lower().split()
        k = min(size, len(w))
        sets[key] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
        parent[key] = key

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), root(k)) for k in keys}


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups_are_brute_force(odd, docs, size):
    for table in (docs, odd.filter("doc_id is not null")):
        want = _near(texts_of(table), size, 80)
        found = rows(near_dedup.near_groups(table, size))
        assert len(found) == table.count()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("deal", [1, 64])
def test_near_groups_of_many_edits(spark, deal, monkeypatch):
    """Copies of one text with more and more edits, so that leaders don't reach all and chains matter; with hot keys dealt out too."""
    monkeypatch.setattr(common, "DEAL", deal)
    r = random.Random(12)
    base = [f"w{r.randrange(500)}" for _ in range(100)]
    texts = []
    for i in range(160):
        w = list(base)
        for _ in range(r.randrange(10)):
            w[r.randrange(100)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    data = list(enumerate(texts))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(near_dedup.near_groups(df, 2))} == _near(data, 2, 80)


def test_what_leaders_leave_over_is_found(spark):
    """Two families around one base whose members are nearer to each other than to it, so that only the filter on differences links them."""
    base = [f"w{i}" for i in range(100)]
    data = []
    for family in range(4):
        w = list(base)
        for k in range(11):
            w[family + 9 * k] = f"f{family}x{k}"
        for member in range(6):
            v = list(w)
            v[(50 + 7 * member + family) % 100] = f"m{family}x{member}"
            data.append((10 * family + member, " ".join(v)))
    data.append((99, " ".join(base)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(near_dedup.near_groups(df, 2))} == _near(data, 2, 80)


def test_near_groups_of_repeated_ids(spark):
    """Rows that share an id, alike or with texts of their own, are one document with the links of all its texts."""
    base = " ".join(f"w{i}" for i in range(60))
    data = [(7, base)] * 5 + [(7, base + " a"), (3, base + " b"), (9, "other words"), (9, base + " c"), (None, base), (None, "nobody"), (None, "nobody"), (None, None)]
    found = rows(near_dedup.near_groups(spark.createDataFrame(data, "doc_id long, text string"), 2))
    assert len(found) == len(data)
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in found) == sorted([(7, 3, False)] * 6 + [(3, 3, True), (9, 3, False), (9, 3, False), (-1, 3, False)] + [(-1, -1, True)] * 3)


def test_near_groups_odd(odd, nothing):
    found = rows(near_dedup.near_groups(odd))
    assert len(found) == odd.count()
    assert all(r["kept"] for r in found if r["doc_id"] is None)
    assert near_dedup.near_groups(nothing).count() == 0
    left = near_dedup.near_dedup(odd.filter("doc_id is not null"))
    assert left.columns == odd.columns


def test_circulant_coordinates():
    table = near_dedup.circulant(64, 10, 1)
    pi = table[:64]
    places = np.array([3, 40, 63])
    want = [min(pi[(p + k) % 64] for p in places) for k in range(10)]
    view = np.lib.stride_tricks.sliding_window_view(table, 10)
    assert view[places].min(axis=0).tolist() == want
    assert sorted(pi.tolist()) == list(range(64))


def test_signatures_estimate_similarity():
    table = near_dedup.circulant()
    r = np.random.default_rng(1)
    pool = r.integers(0, near_dedup.UNIVERSE, 1500)
    view = np.lib.stride_tricks.sliding_window_view(table, near_dedup.BANDS * near_dedup.ROWS)
    a, b = pool[:1200], pool[300:]
    got = (view[a].min(axis=0) == view[b].min(axis=0)).mean()
    assert abs(got - 0.6) < 0.12


@pytest.mark.parametrize("together", [2, 10**6])
def test_components_of_a_long_chain(spark, together, monkeypatch):
    """Tasks that shorten nothing, and hot ends dealt to several tasks, give the same."""
    monkeypatch.setattr(near_dedup, "TOGETHER", together)
    monkeypatch.setattr(common, "DEAL", together)
    n = 100
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(n + 1, n + 2)]
    edges += [(1000, i) for i in range(1001, 1200)] + [(1000, 1000), (1150, 1000)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    found = {r.id: r.comp for r in near_dedup.components(table).collect()}
    assert found == {i: 0 for i in range(n)} | {n + 1: n + 1, n + 2: n + 1} | {i: 1000 for i in range(1000, 1200)}
    assert near_dedup.components(table.filter("a = b")).count() == 0
