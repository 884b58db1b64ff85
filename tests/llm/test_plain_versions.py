"""Parts of the operators against versions written without vectors, messages or joins, and inputs that are empty or odd."""

from __future__ import annotations

import cmath
import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from arbora.llm import common, exact_dedup, media, near_dedup, pii, quality, textvec, toxicity

from .test_llm_ops import rows

# ---- 1 media


def plain_peaks(samples, block=None):
    """(frame, bin) of up to ``PEAKS`` local maxima of each frame by the definition of the transform."""
    n, hop = media.FRAME, media.HOP
    x = [0] * hop + [b - 128 for b in samples]
    out = []
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]
    for t in range(max(1, -(-len(samples) // hop))):
        frame = (x[t * hop : t * hop + n] + [0] * n)[:n]
        m = [abs(sum(w * s * cmath.exp(-2j * math.pi * k * i / n) for i, (w, s) in enumerate(zip(window, frame, strict=True)))) for k in range(n // 2 + 1)]
        top = [(m[k], k) for k in range(1, n // 2) if m[k] > m[k - 1] + 1e-3 and m[k] >= m[k + 1] and m[k] > media.NOISE]
        out.append((t, m, top))
    return out


def test_peaks_are_those_of_the_plain_transform():
    r = random.Random(2)
    samples = media.payload("".join(r.choice("abcdefgh ,.XYZ0189éß") for _ in range(900)))
    t, b = media.peaks(samples)
    found = collections.defaultdict(list)
    for frame, k in zip(t.tolist(), b.tolist(), strict=True):
        found[frame].append(k)
    for frame, m, top in plain_peaks(samples):
        want = sorted(k for _, k in sorted(top, reverse=True)[: media.PEAKS])
        if found[frame] != want:  # nearly equal maxima may trade places in single precision
            assert np.allclose(sorted(m[k] for k in found[frame]), sorted(m[k] for k in want), rtol=1e-3)


def test_pairs_are_those_of_two_loops():
    r = random.Random(3)
    samples = media.payload("".join(r.choice("abc XYZ.,") for _ in range(5000)))
    t, b = (x.tolist() for x in media.peaks(samples))
    want = []
    for i in range(len(t)):
        later = [j for j in range(len(t)) if t[j] > t[i]][: media.FAN_OUT]
        want += [(t[i], b[i] << 16 | b[j] << 8 | t[j] - t[i]) for j in later if t[j] - t[i] <= media.REACH]
    times, codes = media.fingerprints(samples)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == sorted(want)
    gaps = collections.Counter(c & 255 for c in codes.tolist())
    assert min(gaps) == 1
    assert max(gaps) > 1


# ---- 2 personal data


def enumerated(field, bits, given, edges):
    """Marginals by adding up every labelling."""
    unary = pii._design(bits) @ field.weights
    p = np.zeros((len(bits), pii.LABELS))
    pairs = np.zeros((len(edges), pii.LABELS, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=len(bits)):
        if any(g >= 0 and g != k for g, k in zip(given, y, strict=True)):
            continue
        weight = math.exp(sum(unary[i, k] for i, k in enumerate(y)) + sum(field.tables[kind, y[i], y[j]] for i, j, kind in edges))
        for i, k in enumerate(y):
            p[i, k] += weight
        for e, (i, j, _) in enumerate(edges):
            pairs[e, y[i], y[j]] += weight
    return p / p.sum(axis=1, keepdims=True), pairs / pairs.sum(axis=(1, 2), keepdims=True)


def some_field(seed):
    r = np.random.default_rng(seed)
    return pii.Field(r.normal(0, 0.5, (len(pii.FEATURES) + 1, pii.LABELS)), r.normal(0, 0.7, (2, pii.LABELS, pii.LABELS))), r


@pytest.mark.parametrize("given", [[-1] * 5, [3, -1, -1, 0, -1]])
def test_messages_on_a_tree_are_the_enumerated_marginals(given, monkeypatch):
    monkeypatch.setattr(pii, "PASSES", 60)
    field, r = some_field(1)
    bits, given = r.integers(0, 1 << len(pii.FEATURES), 5), np.array(given)
    edges = np.array([[0, 1, 0], [1, 2, 0], [1, 3, 1], [3, 4, 1]])
    want, want_pairs = enumerated(field, bits, given, edges)
    got, got_pairs = field.expected(bits, given, edges)
    assert np.allclose(got, want, atol=1e-6)
    assert np.allclose(got_pairs, want_pairs, atol=1e-6)


def test_messages_around_a_loop_are_near_the_enumerated_marginals(monkeypatch):
    monkeypatch.setattr(pii, "PASSES", 60)
    field, r = some_field(2)
    bits = r.integers(0, 1 << len(pii.FEATURES), 4)
    edges = np.array([[0, 1, 0], [1, 2, 0], [2, 3, 0], [0, 3, 1], [1, 3, 1]])
    want, _ = enumerated(field, bits, np.full(4, -1), edges)
    got, _ = field.expected(bits, np.full(4, -1), edges)
    assert np.abs(got - want).max() < 0.1


def test_the_fit_raises_the_likelihood_of_known_labels():
    field, r = some_field(3)
    bits = r.integers(0, 1 << len(pii.FEATURES), 12)
    known = np.array([3, 4, 3, 0, -1, 0, 4, 4, 2, 2, -1, 4])
    edges = np.array([[i, i + 1, 0] for i in range(11)] + [[0, 2, 1], [3, 5, 1], [4, 5, 1], [8, 9, 1], [9, 10, 1]])
    fitted = field.fitted(bits, known, edges, steps=40)
    told = known >= 0
    likely = [np.log(f.expected(bits, np.full(12, -1), edges)[0][told, known[told]]).sum() for f in (field, fitted)]
    assert likely[1] > likely[0] + 1


# ---- 3 quality


def plain_statistics(text):
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    low_lines = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in lines]
    n, many = max(1, len(raw)), max(1, len(words))
    marks, calls = set(rb"#$%&*<>{}[]\^~=_`|@"), set(b"!?")
    letters = sum(chr(c).isascii() and chr(c).isalpha() for c in raw)
    share = lambda x: math.asinh(50 * x)
    return [
        share(sum(65 <= c <= 90 for c in raw) / max(1, letters)),
        share(sum(c in marks for c in raw) / n),
        share(raw.count(b"|") / (many + quality.EASE)),
        share(sum(c in calls for c in raw) / n),
        share(sum(48 <= c <= 57 for c in raw) / n),
        share(sum(a == b for a, b in itertools.pairwise(low)) / (many + quality.EASE)),
        math.log((len(set(low)) + quality.EASE) / (many + quality.EASE)),
        math.log1p((n - sum(c in b" \t\n\x0b\x0c\r" for c in raw)) / many),
        share(sum(any(c in marks or c in calls for c in w) for w in words) / (many + quality.EASE)),
        share(1 - len(set(low_lines)) / max(1, len(lines))) * (len(lines) > 1),
    ]


def test_statistics_are_the_plain_ones():
    r = random.Random(6)
    parts = ["soil", "SOIL", "Soil", "a|b", "12", "!?", "é", "\n", "\n\n", "\t", "{x}", "x@y", "soil soil"]
    texts = ["", " ", "a", "\n", "a\na\nA\nb"] + ["".join(r.choice(parts) + r.choice([" ", "", "\n"]) for _ in range(r.randrange(60))) for _ in range(40)]
    got = quality.statistics(pa.array(texts))
    want = np.array([plain_statistics(t) for t in texts])
    assert np.allclose(got, want)


# ---- 9 toxicity


def test_scores_are_the_plain_noisy_or():
    r = random.Random(7)
    weights = {b"rotten": 5.0, b"bad": 0.7, b"fine": -0.4}
    starts = {(b"grim", 4): 6.5}  # grimly, grimmer: words that begin so, not the word itself

    def key(word):
        data, offsets = textvec.buffer(pa.array([word.decode()]))
        a, b, _ = textvec.words(data, offsets, textvec.NOT_ALNUM)
        return textvec.hashes(data, a, b)[0]

    table = {key(w): x for w, x in weights.items()} | {textvec.mix(np.array([key(w)]) + np.uint64(k))[0]: x for (w, k), x in starts.items()}
    keys = np.array(sorted(table), np.uint64)
    model = toxicity.Model(keys, np.array([table[k] for k in keys]), -4.0)
    parts = ["rotten", "Bad", "fine", "grim", "grimly", "soil", "ünd", "a-b", ".", "!", "?", "\n", ",", " "]
    texts = ["", ".", "soil"] + ["".join(r.choice(parts) + r.choice([" ", ""]) for _ in range(r.randrange(50))) for _ in range(60)]
    score, n, z, _ = model.score(pa.array(texts))
    logits = []
    for text, got, count in zip(texts, score, n, strict=True):
        left, sentences = 1.0, 0
        for sentence in re.split(rb"[.!?\n]", text.encode()):
            found = {bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", sentence)}
            if found:
                value = -4.0 + sum(x for w, x in weights.items() if w in found) + sum(x for (w, k), x in starts.items() if any(len(f) > k and f[:k] == w for f in found))
                logits.append(value)
                left *= 1 - 1 / (1 + math.exp(-value))
                sentences += 1
        assert count == sentences
        assert math.isclose(got, 1 - left, abs_tol=1e-9)
    assert np.allclose(z, logits)


def test_offending_spans_are_code_points_of_long_texts(spark):
    key = textvec.hashes(*(lambda d, o: (d, *textvec.words(d, o, textvec.NOT_ALNUM)[:2]))(*textvec.buffer(pa.array(["rotten"]))))
    model = toxicity.Model(key, np.array([9.0]), -4.0)
    text = "Größe und Maß. " * 3000 + "Ein rotten Ding. " + "日本語 の 文。 fine. " * 2000 + "Rotten again!"
    df = spark.createDataFrame([(1, "ok. été"), (2, text)], "doc_id long, text string")
    found = {r["doc_id"]: r["offending"] for r in rows(toxicity.toxicity_scores(df, None, model=model))}
    assert found[1] == []
    assert [text[x["start"] : x["end"]] for x in found[2]] == ["Ein rotten Ding", "Rotten again"]


def test_fits_take_one_row_of_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 7, f"text {i} of soil!") for i in range(60)] + [(8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    sample = rows(toxicity._sample(docs, labels, "text", "doc_id"))
    learnt = [i for i in [0, 1, 2, 3, 4, 5, 6, 8] if not common_fold(i)]
    assert len(sample) == len(learnt)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 1)
    assert len(rows(toxicity._sample(docs, labels, "text", "doc_id"))) < len(learnt)


def common_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


# ---- empty and odd tables


def test_empty_tables_stay_empty(nothing, labels):
    assert rows(media.media_features(nothing)) == rows(pii.pii_spans(nothing)) == []
    assert quality.quality_filter(nothing, labels).count() == 0
    assert near_dedup.near_dedup(nothing).count() == 0
    assert exact_dedup.exact_dedup(nothing).columns == nothing.columns


def test_quality_filter_on_odd_rows(odd, labels):
    kept = quality.quality_filter(odd, labels)
    assert kept.columns == odd.columns
    scored = collections.Counter(r["doc_id"] for r in rows(quality.quality_scores(odd, labels)) if r["predicted"])
    assert abs(sum(scored.values()) - kept.count()) <= 3  # rows that share an id are learnt from once, whichever way they come
    none = labels.filter("doc_id < 0")
    assert quality.quality_filter(odd, none).count() == odd.count()


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
