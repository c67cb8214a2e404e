"""Near duplicates against all pairs counted; registers, likelihood and lists that fill many tiles."""

import random

import numpy as np
import pytest

from wayfold.llm import setsketch, shingles

SCHEMA = "doc_id long, text string, n long, node string, regs int"


def sets_of(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for part in words for w in part.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1)))


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and same and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((repr(d), len(sets[i]), repr(c := least.get(find(i)) if sets[i] else d), d == c) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    out = setsketch.near_duplicates(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)).collect()
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["kept"]) for r in out)


def edited(rng, words):
    words, at = list(words), rng.randrange(len(words))
    kind, many = rng.choice("ciraw"), rng.randint(1, max(1, len(words) // 6))
    new = [f"n{rng.randrange(10**6)}" for _ in range(many)]
    if kind == "w":
        for _ in range(rng.randint(1, 1 + len(words) // 20)):
            words[rng.randrange(len(words))] = new[0]
        return words
    return {"c": words[:at] + words[at + many :], "i": words[:at] + new + words[at:], "r": words[:at] + new + words[at + many :], "a": words + new}[kind] or words


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 10, 60, 200]))]
        texts += [base] + [edited(rng, base) for _ in range(copies)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_components_equal_those_of_all_pairs(spark):
    odd = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "Ärger da"), (907, "ärger da"), (908, "a\x00b c\x85d"), (None, "one two"), (None, None), (None, "a lone text"), (903, "one"), (909, "wort " * 30_000)]
    rows = corpus(1, 40, 6) + odd
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("tile,short", [(8, 1), (5, 3)])
def test_long_lists_in_tiles(spark, monkeypatch, tile, short):
    monkeypatch.setattr(setsketch, "TILE", tile)
    monkeypatch.setattr(setsketch, "SHORT", short)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(50)]
    # one list holds texts near and not near: words change in any of them
    rows = [(i, " ".join(w if rng.random() > rng.choice([0.02, 0.12]) else f"x{rng.randrange(40)}" for w in base)) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_registers_merge_and_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    left, right, agree = pool[:900], pool[100:1000], []
    assert (setsketch.merged(setsketch.registers(left), setsketch.registers(right)) == setsketch.registers(np.union1d(left, right))).all()
    for i in range(60):
        some = pool[i * 600 : i * 600 + 540]
        agree.append((setsketch.registers(some) == setsketch.registers(some[54:])).mean())
    assert abs(np.mean(agree) - 0.9) < 0.01


def test_likelihood_keeps_similar_pairs_and_drops_others():
    rng = np.random.default_rng(1)
    kept = {0.82: 0, 0.4: 0}
    for share in kept:
        for _ in range(100):
            pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
            n = int(1000 * (1 + share) / 2)
            left, right = pool[:n], pool[1000 - n : 1000]
            pair = [setsketch.registers(x)[None] for x in (left, right)]
            kept[share] += int(setsketch.likely(*pair, np.array([n]), np.array([n]))[0])
    assert kept == {0.82: 100, 0.4: 0}


def test_counting_of_sorted_sets():
    for left, right in (([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1, 2, 3], [1, 2, 4]), ([1], [1]), ([1], [2])):
        a, b = set(left), set(right)
        assert shingles.shared(np.array(left), np.array(right), 80) == (100 * len(a & b) >= 80 * len(a | b))


def test_pairs_of_a_large_list_are_not_rows(spark, monkeypatch):
    rng, asked, counted = random.Random(5), [], setsketch.alike
    base = [f"w{i}" for i in range(50)]
    # every two are about 0.72 alike, which the registers cannot tell from 0.8; the last ones are joined by a text between them
    rows = []
    for i in range(130):
        words = list(base)
        for k, at in enumerate(rng.sample(range(5, 45, 4), 2)):
            words[at] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    rows.append((130, rows[129][1].replace("x129y0", "between")))

    def spied(pairs, *rest):
        asked.append(pairs.count())
        return counted(pairs, *rest)

    monkeypatch.setattr(setsketch, "alike", spied)
    monkeypatch.setattr(setsketch, "SHORT", 1)
    assert run(spark, rows) == brute(rows)
    assert sum(asked) < 4_000, asked  # of 8,515
