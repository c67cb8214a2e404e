"""Near copies against all pairs counted."""

import numpy as np
import pytest

from wayfold.llm import near_copies as N


def fives(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def shared(a, b):
    return len(a & b) / len(a | b)


def edited_words(words, rng, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"changed{rng.integers(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("limit", [40, 100_000])
def test_near_copies_join_and_others_stay_apart(spark, limit):
    rng = np.random.default_rng(5)
    pool = [f"w{i}" for i in range(3000)]
    rows, doc = [], 0
    for group in range(30):
        words = list(rng.choice(pool, 300))
        for text in [" ".join(words), *(edited_words(words, rng, 4) for _ in range(3)), edited_words(words, rng, 90)]:
            rows.append((doc, group, text))
            doc += 1
    df = spark.createDataFrame([(d, t) for d, _, t in rows] + [(None, None), (1000, ""), (1001, "  "), (1002, "one two")], "doc_id long, text string").repartition(5)
    root = {r["doc_id"]: r["root"] for r in N.near_copies(df, run_limit=limit).collect()}
    for d, _, t in rows:
        first, far = d // 5 * 5, d % 5 == 4
        assert (root[d] == root[first]) == (not far), shared(fives(rows[first][2]), fives(t))
    assert root[None] == root[1000] == root[1001] != root[1002] and len({root[d] for d, _, _ in rows}) == 60
    assert N.keep_one_near_copy(df, run_limit=limit).count() == 62


def test_near_copies_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: fives(r["text"]) for r in docs.collect()}
    root = {r["doc_id"]: r["root"] for r in N.near_copies(docs).collect()}
    holders, pairs = {}, {}
    for d, five in text.items():
        for f in five:
            holders.setdefault(f, []).append(d)
    for held in holders.values():
        for i, a in enumerate(held[:200]):
            for b in held[i + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    like = {p: n / (len(text[p[0]]) + len(text[p[1]]) - n) for p, n in pairs.items()}
    near = [p for p in like if like[p] >= 0.8]
    found = [p for p in near if root[p[0]] == root[p[1]]]
    assert len(near) > 80 and len(found) >= 0.95 * len(near)
    kin = {}
    for (a, b), s in like.items():
        if s >= 0.7:
            kin.setdefault(a, set()).add(b)
            kin.setdefault(b, set()).add(a)
    for d, r in root.items():
        assert kin.get(d) or list(root.values()).count(r) == 1


def test_fingerprint_bits_agree_as_often_as_least_hashes_do():
    rng = np.random.default_rng(8)
    for n in (20, 300, 6000):
        agree = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, n).astype(np.uint64)
            some, other = N.prints(pool[: n * 9 // 10]), N.prints(pool[n // 10 :])  # J = 0.8
            agree.append(1 - np.bitwise_count(some ^ other).sum() / (N.PRINTS * N.PRINT_BITS))
        assert abs(np.mean(agree) - 0.9) < 0.02
    assert N.prints(np.zeros(0, np.uint64)).shape == (N.PRINTS,)


def block_edited(words, rng, kind, size):
    at, new = int(rng.integers(1, len(words) - size)), [f"new{x}" for x in rng.integers(0, 10**6, size)]
    return {"appended": words + new, "inserted": words[:at] + new + words[at:], "cut": words[:at] + words[at + size :], "replaced": words[:at] + new + words[at + size :]}[kind]


@pytest.mark.parametrize("limit", [4, 100_000])
def test_block_edits_against_all_pairs(spark, limit):
    rng = np.random.default_rng(11)
    texts = []
    for length in (60, 300, 2000):
        for kind in ("appended", "inserted", "cut", "replaced"):
            for share in (0.04, 0.08, 0.1, 0.14, 0.18, 0.22, 0.28):
                words = [f"w{x}" for x in rng.integers(0, 5000, length)]
                texts += [" ".join(words), " ".join(block_edited(words, rng, kind, int(length * share)))]
    passage = [f"same{i}" for i in range(40)]
    texts += [" ".join(passage + [f"t{i}x{j}" for j in range(6 + i % 5)]) for i in range(40)]
    sets = [fives(t) for t in texts]
    want = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and shared(sets[i], sets[j]) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {k: new if v == old else v for k, v in want.items()}
    root = {r["doc_id"]: r["root"] for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), run_limit=limit).collect()}
    assert 0 < sum(want[i] == want[i + 1] for i in range(0, 168, 2)) < 84
    for i in range(len(texts)):
        for j in range(i):
            assert (root[i] == root[j]) == (want[i] == want[j]), (i, j, shared(sets[i], sets[j]))


def test_a_close_pair_is_given_by_one_block_only():
    rng = np.random.default_rng(4)
    left = np.stack([N.prints(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(40)])
    right = left.copy()
    for row in right:
        for t in rng.choice(N.PRINTS, 20, replace=False):
            row[t] ^= np.uint64(1) << np.uint64(63 - rng.integers(0, N.PRINT_BITS))
            if rng.random() < 0.6:
                row[t] ^= np.uint64(1) << np.uint64(63 - rng.integers(0, N.PRINT_BITS))
    given = sum(N._first_met(left, right, b).astype(int) for b in range(N.PRINTS * (N.BUDGET + 1)))
    assert (given == 1).all()
    for b in range(N.PRINTS * (N.BUDGET + 1)):  # and that block is one in which the pair is walked
        t, k = divmod(b, N.BUDGET + 1)
        at, width = N.trie.blocks(N.BUDGET, N.PRINT_BITS)[k]
        met = ((left[:, t] ^ right[:, t]) << np.uint64(at)) >> np.uint64(64 - width) == 0
        assert (met & (np.bitwise_count(left[:, t] ^ right[:, t]) <= N.BUDGET))[N._first_met(left, right, b)].all()
    assert not N._first_met(left, left[::-1].copy(), 0).any()


def test_buckets_never_leave_out_a_near_copy():
    rng = np.random.default_rng(3)
    kept = []
    for n in (0, 1, 40, 150, 900, 200_000):  # of the last, most buckets say 255
        pool = rng.integers(0, 2**64, n + n // 2, dtype=np.uint64)
        for part in (0, 0.05, 0.1, 0.12, 0.2, 0.4):
            left, right = np.unique(pool[:n]), np.unique(pool[int(part * n) : int(part * n) + n])
            rows = [np.array([x]) for x in (N.buckets(left), N.buckets(right), len(left), len(right))]
            possible, near = N.can_share(*rows, 80)[0], len(left) + len(right) == 0 or shared(set(left.tolist()), set(right.tolist())) >= 0.8
            assert possible or not near
            kept.append(possible and not near)
    assert kept[2 * 6 + 5] is kept[3 * 6 + 5] is kept[3 * 6 + 4] is np.False_


def test_a_crowd_below_the_similarity_is_not_asked_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(17)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]

    def spaced(edits):
        words, at = list(base), 10 + rng.integers(0, 20) + 30 * np.arange(edits)
        for i in at:
            words[i] = f"changed{rng.integers(10**9)}"
        return words

    close, far = [spaced(1) for _ in range(360)], [spaced(4) for _ in range(240)]  # 0.94 and 0.76 like the base
    again = [words[:140] + [f"again{i}"] + words[141:] for i, words in enumerate(far[:3])]
    texts = [" ".join(words) for words in [base, *close, *far, *again]]
    asked, alike = [], N.alike
    monkeypatch.setattr(N, "alike", lambda pairs, *rest: asked.append(pairs.count()) or alike(pairs, *rest))
    root = {r["doc_id"]: r["root"] for r in N.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert len({root[i] for i in range(361)}) == 1
    assert all(root[361 + i] == root[601 + i] for i in range(3)) and len(set(root.values())) == 241
    assert sum(asked[4:]) < 20 * len(texts), asked  # of 59,000 candidates
