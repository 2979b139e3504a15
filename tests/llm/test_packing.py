import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vouch.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")


def check(rows, texts, tokenizer, window=packing.WINDOW):
    """Every id in exactly one piece, and no gap in any sequence."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids, at = ids_of(tokenizer, t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for k, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or k == max(by_sequence) and at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_words_give_the_ids_of_whole_texts(tokenizer):
    texts = ["It's 12,345 'tis DON'T... x²½ _a_b ÄÖß", "İstanbul ΣΑΣ", "a\u00a0b\x1cc", "é e\u0301", "<|endoftext|> x", "漢字 😀", "", "!" * 500, "ªº·×÷ µ1", "a\u2028b", "ŉ ǅ ǆ"]
    lookup = packing.Tokens(public_tokenizers.path(packing.TOKENIZER))
    for _ in range(2):
        for t, got in zip(texts, lookup.of(texts), strict=True):
            assert np.frombuffer(got, lookup.type).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def walked(totals, weights, window, grain):
    """Deficit round-robin step by step: credits, whole grains, queues in order. Where each grain stands, by queue and place."""
    share = {s: weights[s] * sum(totals.values()) if s in weights else n for s, n in totals.items()}
    credit = {s: max(1, int(np.rint(x / sum(share.values()) * window * packing.UNIT))) for s, x in share.items()}
    order = sorted(totals, key=lambda s: (-totals[s], s is not None, s or ""))
    served, place, turn, at = dict.fromkeys(totals, 0), {}, 0, 0
    while served != totals:
        turn += 1
        for s in order:
            earned = turn * credit[s] // packing.UNIT
            while served[s] < totals[s] and (end := min((served[s] // grain + 1) * grain, totals[s])) <= earned:
                place[s, served[s]] = at
                at += end - served[s]
                served[s] = end
    return place


@pytest.mark.parametrize(("sources", "weighted"), [(5, 0), (5, 3), (1500, 0), (1500, 1200)])
def test_rounds_by_hand(spark, tokenizer, sources, weighted):
    """Every source, however many there are, has its own queue and its own share; so has every weight."""
    rng = np.random.default_rng(3 + sources + weighted)
    texts, of = {}, {}
    for i in range(sources * 2):
        texts[i] = "word " * int(rng.integers(0, 120 if sources < 10 else 25))
        of[i] = None if i % sources == 1 else f"s{i % sources}" if i % 7 else "hot"
    docs = spark.createDataFrame([(i, t, of[i]) for i, t in texts.items()], "doc_id long, text string, source string").repartition(3)
    weights = {s: float(rng.random() + 0.05) for s in sorted({x for x in of.values() if x})[:weighted]}
    rows = packing.pack(docs, weights=weights | {None: 0.5, "absent": 9.0} if weighted else None, window=128, grain=16).collect()
    check(rows, texts, tokenizer, 128)
    totals, got = {}, {}
    for i, t in texts.items():
        totals[of[i]] = totals.get(of[i], 0) + len(ids_of(tokenizer, t))
    for r in rows:
        got.setdefault(r.source, []).append((r.sequence_id * 128 + r.offset, r.length))
    # The tokens of a source stand where its grains do.
    want = {}
    for (s, p), at in walked(totals, weights | {None: 0.5} if weighted else {}, 128, 16).items():
        want.setdefault(s, set()).update(range(at, at + min(16, totals[s] - p)))
    assert {s: {x for at, n in spans for x in range(at, at + n)} for s, spans in got.items()} == want


def test_query(spark, sf, duck, tokenizer):
    rows = packing.op9_packing(spark, sf).collect()
    check(rows, dict(duck.execute("select doc_id, text from documents").fetchall()), tokenizer)
    # Every full window holds each source in its share, to within a grain on each side.
    held, total = {}, {}
    for r in rows:
        held[r.sequence_id, r.source] = held.get((r.sequence_id, r.source), 0) + r.length
        total[r.source] = total.get(r.source, 0) + r.length
    whole, last = sum(total.values()), max(r.sequence_id for r in rows)
    for s, n in total.items():
        for k in range(last - 1):
            assert abs(held.get((k, s), 0) - 4096 * n / whole) <= 2 * packing.GRAIN


def test_shapes(spark, tokenizer):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "one two"}
    docs = spark.createDataFrame([(i, t, s, 9) for (i, t), s in zip(texts.items(), ("a", None, "a", "b"), strict=True)], "doc_id long, text string, source string, local int")
    rows = packing.pack(docs, weights={"b": 5.0}, window=512, grain=32).collect()
    check(rows, texts, tokenizer, 512)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0
