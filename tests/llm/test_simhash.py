"""The trie self-join against all pairs."""

import numpy as np
import pytest
import xxhash

from wayfold.llm import simhash_trie as S


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, k):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= k:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_fingerprints(small):
    for r in small.limit(60).collect():
        assert S.simhash(r["text"]) % 2**64 == plain(r["text"])
    assert S.simhash(None) == S.simhash(" ") == 0
    assert S.simhash("Über ÄB c") % 2**64 == plain("Über ÄB c")


def test_walk_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    near = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for i, j in rng.integers(0, 63, (150, 2))]))
    for k in (0, 1, 2, 3):
        want = {(i, j) for i in range(len(near)) for j in range(i + 1, len(near)) if bin(int(near[i] ^ near[j])).count("1") <= k}
        assert set(S.walk(near, near, True, k)) == want
        a, b = near[::2], near[1::2]
        assert set(S.walk(a, b, False, k)) == {(i, j) for i in range(len(a)) for j in range(len(b)) if bin(int(a[i] ^ b[j])).count("1") <= k}


@pytest.mark.parametrize("limit", [3, 100_000])
def test_components_against_all_pairs(spark, limit):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 40, dtype=np.int64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base[:8] for i, j in rng.integers(0, 62, (12, 2))]
    prints = sorted({int(b) for b in base} | set(near) | {0, 1, 3, 7, -1})
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    found = {r["node"]: r["root"] for r in S.components(S.links(nodes, 2, limit)).collect()}
    want = classes([p % 2**64 for p in prints], 2)
    group = {}
    for p in prints:
        group.setdefault(want[p % 2**64], []).append(p)
    for members in group.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_documents_against_all_pairs(small):
    rows = [(r["doc_id"], plain(r["text"])) for r in small.collect()]
    want = classes(sorted({f for _, f in rows}), 2)
    least = {}
    for d, f in rows:
        least[want[f]] = min(d, least.get(want[f], d))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.fingerprints_and_components(small).collect()}
    assert found == {d: (f"{f:016x}", least[want[f]]) for d, f in rows}
    assert sorted(r["doc_id"] for r in S.keep_one(small).collect()) == sorted(set(least.values()))
