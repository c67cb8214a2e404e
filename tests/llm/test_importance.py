"""Prefix CRCs against CRCs of the n-grams themselves; resampling against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm import importance


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 -_\x00é\U0001f600\n", max_size=60), max_size=5), st.integers(1, 4))
def test_ngram_crcs_equal_those_of_the_joined_words(texts, n):
    found = [importance.prefix_crcs(t) for t in texts]
    starts = np.cumsum([0, *(len(c) for c, _ in found)])
    crcs, added = (np.concatenate([np.zeros(0, d), *x]) for d, x in ((np.uint32, [c for c, _ in found]), (np.int32, [a for _, a in found])))
    text, crc = importance.ngrams(crcs, added, starts, n)
    plain = [(i, zlib.crc32(" ".join(w[k : k + n]).encode())) for i, w in enumerate(map(words, texts)) for k in range(len(w) - n + 1)]
    assert list(zip(text.tolist(), crc.tolist())) == plain


def test_long_words_and_blocks(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 7)
    text = "x" * 5000 + " short , " + "Wort " * 50 + "é" * 300
    crcs, added = importance.prefix_crcs(text)
    for n in (1, 3):
        w = words(text)
        assert importance.ngrams(crcs, added, np.array([0, len(crcs)]), n)[1].tolist() == [zlib.crc32(" ".join(w[k : k + n]).encode()) for k in range(len(w) - n + 1)]


def plain(rows, target, n_max, buckets, share, min_words, seed):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]

    raw, want = [0] * buckets, [0] * buckets
    for text, count in [(r["text"], raw) for r in rows] + [(t, want) for t in target]:
        for b in features(text):
            count[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(want) + buckets)))) for s, t in zip(raw, want)]
    out = []
    for r in rows:
        f = features(r["text"])
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        out.append([r["doc_id"], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(r["text"]))])
    enough = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[2], x[1]))
    drawn = enough[: share * len(enough) // 100]
    ranks = {id(x): i + 1 for i, x in enumerate(drawn)}
    return sorted(map(repr, ((*x[:4], ranks.get(id(x))) for x in out)))


@pytest.mark.parametrize("n_max,buckets,share,min_words", [(1, 10_000, 10, 20), (3, 97, 60, 1)])
def test_resampling_of_odd_rows_against_a_plain_version(spark, odd, small, n_max, buckets, share, min_words):
    target = ["a benchmark text, twice", None, "", "wort wort one"]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, crcs int")
    for docs in (odd, small.limit(80)):
        got = importance.resample(docs, frame, n_max, buckets, share, min_words)
        assert sorted(repr(tuple(r)) for r in got.collect()) == plain(docs.collect(), target, n_max, buckets, share, min_words, importance.SEED)


def test_empty_tables(spark, odd):
    assert importance.resample(odd.limit(0), odd).count() == 0
    assert importance.resample(odd, odd.limit(0)).count() == odd.count()
