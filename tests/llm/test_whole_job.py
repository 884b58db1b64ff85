"""Layouts that the operators once did less than the whole job on."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from arbora.llm import media, packing, pii, textvec, toxicity


def added(spark, texts):
    """Added spans' kinds and texts of each document."""
    found = pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    out = {}
    for r in found:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        base = {(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(texts[r["doc_id"]])}
        out[r["doc_id"]] = [(k, texts[r["doc_id"]][a:b]) for k, a, b in sorted(spans, key=lambda s: s[1]) if (k, a, b) not in base]
        assert len(out[r["doc_id"]]) == r["n_added"]
    return [out[i] for i in range(len(texts))]


LAYOUTS = [
    ("Call +1 988 555 2485 now. Later 988 555 2485 again", [("phone", "988 555 2485")]),
    ("Ask 988 555 2485, or from abroad +1 988 555 2485 instead", [("phone", "988 555 2485")]),
    ("Call +1 (988) 555-2485 now. Later (988) 555-2485 again", [("phone", "(988) 555-2485")]),
    ("Call +19885552485 now. Later 988-555 2485, again", [("phone", "988-555 2485")]),
    ("Call +44 20 7946 0958 now. Later 020 7946 0958 again", [("phone", "020 7946 0958")]),
    ("Card 4111 1111 1111 1111 paid. Later 4111.1111.1111.1111 again", [("card", "4111.1111.1111.1111")]),
    ("Card 4111111111111111 paid, then 4111  1111 \n1111 1111.", [("card", "4111  1111 \n1111 1111")]),
    ("Write jane.doe@corp.com today. Then jane.doe@corp again", [("email", "jane.doe@corp")]),
    ("Write jane.doe@corp.com today, or just jane.doe, please", [("email", "jane.doe")]),
    ("Write bob@corp.com today. Then <bob@corp> again", [("email", "bob@corp")]),
    ("Call +1 988 555 2485 now. Later 988 555 2486 again, 12 of 40", []),
    ("Write jane.doe@corp.com today. Then john.doe, version 4.0. in 1999", []),
]


def test_repetitions_in_other_layouts_are_added(spark):
    calm = [f"Word {i}, version 4.0. in {1900 + i}, {i} 200 3000 apples" for i in range(40)]
    assert added(spark, [t for t, _ in LAYOUTS] + calm) == [want for _, want in LAYOUTS] + [[]] * len(calm)


def test_every_repetition_gets_the_evidence(spark):
    calm = [f"Word {i}, version 4.0. in {1900 + i}, {i} 200 3000 apples, {i} items" for i in range(60)]
    many = [("Call +1 988 555 2485 now. ", "988 555 2485", "phone"), ("Write jane.d1@corp.com. ", "jane.d1", "email"), ("Write jane.doe@corp.com. ", "jane.doe", "email")]
    texts = [told + f"Then {form} there. " * 80 for told, form, _ in many] + [f"Then {form} there. " * 80 + told for told, form, _ in many]
    assert added(spark, texts + calm) == [[(kind, form)] * 80 for _, form, kind in many * 2] + [[]] * len(calm)


def test_a_feature_counts_once_in_a_sentence():
    data, offsets = textvec.buffer(pa.array(["soil rotten bad"]))
    starts, ends, _ = textvec.words(data, offsets, textvec.NOT_ALNUM)
    keys = textvec.hashes(data, starts, ends)
    order = np.argsort(keys)
    model = toxicity.Model(keys[order], np.array([-0.1, 9.0, 0.1])[order], -6.0)
    calm, mild = "soil " * 3000, "bad " * 3000
    score, _, z, _ = model.score(pa.array([calm + "rotten " + calm, mild, "soil rotten", "bad. bad rotten"]))
    assert np.allclose(z, [2.9, -5.9, 2.9, -5.9, 3.1])
    assert (score >= toxicity.THRESHOLD).tolist() == [True, False, True, True]


SPECIAL = ["stop <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|>", "<|endoftext|><|endoftext|> two", "no <|endoftext |> here", "plain words."]


@pytest.mark.parametrize("text", SPECIAL)
def test_ids_are_those_of_the_file_as_it_is(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(path)(text), "<u4").tolist() == want


def test_packed_rows_of_special_tokens(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    found = packing.packed(spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")).collect()
    want = [np.array([*whole.encode(t, add_special_tokens=False).ids, packing.END], "<u4") for t in SPECIAL]
    assert {r.doc_id: r.doc_tokens for r in found} == {i: len(x) for i, x in enumerate(want)}
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) for r in found)


def test_fingerprints_survive_a_lost_peak(monkeypatch):
    passage = media.payload("Seeds went into the wet soil before the rain, and the beds were covered. " * 60)
    t, b = media.peaks(passage)
    whole = set(zip(*(x.tolist() for x in media.fingerprints(passage)), strict=True))
    gaps = {c & 255 for _, c in whole}
    assert min(gaps) >= 1
    assert max(gaps) > 1
    anchors = {(x, c >> 16) for x, c in whole}
    for lost in range(10, 60):
        monkeypatch.setattr(media, "peaks", lambda _, lost=lost: (np.delete(t, lost), np.delete(b, lost)))
        left = whole & set(zip(*(x.tolist() for x in media.fingerprints(passage)), strict=True))
        assert {(x, c >> 16) for x, c in left} == anchors - {(int(t[lost]), int(b[lost]))}
