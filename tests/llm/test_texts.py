"""Quality, language, packing, personal data and digests against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import bootstrap_pii as P
from wayfold.llm import crossparse, divergence, hash_tree, mixing, packing, quartile_digest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_base(small):
    refs = divergence.references(small)
    for r in small.collect():
        text = r["text"]
        words = WORD.findall(text)
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        got = divergence.judge(text, r["lang"], refs)
        assert got[:5] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again))
        assert got[5] == (len(words) < 10 or 100 * len(again) > 20 * len(words))


def test_quality_follows_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = divergence.quality(docs).collect()
    good = [r["kept"] for r in found if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in found if labels.get(r["doc_id"]) == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_references_count_the_whole_corpus(small):
    want = collections.Counter(w for r in small.collect() if r["lang"] == "en" for w in r["text"].lower().encode().split())
    ref = next(r for r in divergence.references(small) if r["lang"] == "en")
    assert ref["total"] == sum(want.values())
    assert [want[w] for w in ref["words"]] == ref["word_counts"][:-1] == [n for _, n in want.most_common(divergence.COMMON_WORDS)]


def test_suffix_automaton_knows_every_substring():
    codes = np.array([2, 3, 2, 2, 3, 4, 2, 3], np.uint8)
    step = crossparse.suffix_automaton(codes)
    every = {tuple(codes[i:j].tolist()) for i in range(8) for j in range(i + 1, 9)}
    for word in [*every, (4, 4), (3, 3), (2, 2, 2)]:
        state = 0
        for c in word:
            state = step[state].get(c) if state is not None else None
        assert (state is not None) == (word in every)


def test_phrases_against_plain_parsing():
    model = crossparse.Model({"a": "the cat sat on the mat with a hat", "b": "der hund und die katze im haus"})
    for text in ["the hat of the dog", "katze und hund", "zzz", "a" * 700]:
        codes = crossparse.encode(text, model.table)
        for g, lang in enumerate(model.langs):
            learned = crossparse.encode({"a": "the cat sat on the mat with a hat", "b": "der hund und die katze im haus"}[lang], model.table).tobytes()
            n = 0
            for lo in range(0, len(codes), crossparse.BLOCK):
                block, phrase = codes[lo : lo + crossparse.BLOCK], b""
                n += 1
                for c in block:
                    longer = phrase + bytes([c])
                    if longer not in learned:
                        n += 1
                        phrase = bytes([c]) if bytes([c]) in learned else b""
                    else:
                        phrase = longer
            assert model.phrases([codes])[0, g] == n


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = crossparse.identify_documents(docs).collect()
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert len(held) > 200 and sum(held) >= 0.99 * len(held)


def test_many_letters_and_many_languages(spark, monkeypatch):
    """Three scripts of 2,000 letters each, learned one language at a time and together; emoji are no letters."""
    rng = np.random.default_rng(7)
    scripts = {"aa": range(0x4E00, 0x4E00 + 2000), "bb": range(0x6000, 0x6000 + 2000), "cc": range(0x20000, 0x20000 + 2000)}

    def prose(lang, n):
        return "".join(chr(c) for c in rng.choice(list(scripts[lang]), n))

    learned = [(i, prose(lang, 4000), lang) for lang in scripts for i in range(1, 40) if zlib.crc32(str(i).encode()) % 3 != 1]
    asked = [(1000 + i, prose(lang, 60), None) for i, lang in enumerate(list(scripts) * 20)] + [(2000, "\U0001F600\U0001F680 \U0001F600", None), (2001, "123", None)]
    docs = spark.createDataFrame(learned + asked, "doc_id long, text string, lang string")
    together = sorted(map(tuple, crossparse.identify_documents(docs).collect()))
    found = {i: lang for i, _, lang, _ in together}
    assert all(found[1000 + i] == lang for i, lang in enumerate(list(scripts) * 20))
    assert found[2000] == found[2001] == "und" and all(found[i] == lang for i, _, lang in learned if len([1 for x in learned if x[0] == i]) == 1)
    monkeypatch.setattr(crossparse, "LANGUAGES_AT_ONCE", 1)
    assert sorted(map(tuple, crossparse.identify_documents(docs).collect())) == together


def test_spelling_is_unambiguous():
    learned = np.repeat(np.arange(2, 5002), np.arange(5000, 0, -1) // 500 + 1)
    spell = crossparse.Spelling(learned, 5010)
    words = [tuple(spell(np.array([k])).tolist()) for k in range(2, 5002)]
    assert len(set(words)) == 5000 and max(map(max, words)) < crossparse.ALPHABET
    assert tuple(spell(np.array([0, 3, 5005, 4000])).tolist()) == (0, *words[1], 1, *words[3998])


def test_undetermined(odd):
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in crossparse.identify_documents(odd).collect() if r["doc_id"] in (0, 1, 2)}
    assert found == {(i, "und", 0.0) for i in range(3)}


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mixed_words(docs).collect()
    by_source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = collections.Counter(), {}
    for r in found:
        taken[by_source[r["doc_id"]]] += r["taken"]
        target[by_source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    words = sum(r["size"] for r in found)
    assert abs(sum(target.values()) - 1.5 * words) < 1
    rows = mixing.copies(docs)
    assert rows.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in rows.collect()) == sum(taken.values())


def test_shards_grow_into_the_new_one_only(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 7 AS string) AS text")
    rows = hash_tree.shard_documents(docs).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    moved = sum(r["grown_shard"] == 40 for r in rows)
    assert abs(moved - 20_000 / 41) < 100
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(sizes) == 40 and max(sizes.values()) < 1.3 * min(sizes.values())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@given(st.lists(st.integers(1, 100), max_size=60))
@settings(max_examples=200, deadline=None)
def test_first_fit_decreasing_against_the_list_version(lengths):
    free, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        free += [100] * (b == len(free))
        free[b] -= lengths[i]
        want[i] = b
    assert packing.first_fit_decreasing(lengths, 100) == want


def test_ids_are_those_of_the_named_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(packing.tokenizer_path())
    for text in ("", "a<|endoftext|> b <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "\n <|endoftext|>\n", "Ärger \U0001f600 x" * 50, "<|ENDOFTEXT|>"):
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(small):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(small, group_rows=64).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for r in small.collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and P.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="a0129@.-_+ ()%é", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_spans_against_the_patterns(text):
    assert P.base_spans(text) == plain_spans(text)


def test_base_spans_of_the_corpus(small):
    for r in small.collect():
        assert P.base_spans(r["text"]) == plain_spans(r["text"])
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_long_runs_take_linear_time():
    P.base_spans("1" * 200_000 + "@" * 10_000 + "a" * 200_000 + "." + "1." * 50_000)


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please phone +1 555 555 {1000 + i} today and thanks {i}") for i in range(40)] + [(100, "please phone 0171-2345678 today"), (101, "build 20240101-77 of the code")]
    found = {r["doc_id"]: r["spans"] for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == "phone:13:25" and found[101] == "" and found[3] == "phone:13:28"
    redacted = {r["doc_id"]: r["text"] for r in P.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert redacted[100] == "please phone <phone> today" and redacted[101] == rows[41][1]


def test_identifiers_in_several_groups(spark):
    rows = [(i, f"please phone +1 555 555 {1000 + i} today and thanks {i}") for i in range(40)]
    rows += [(100, "please phone 0171 234 5678 today"), (101, "please phone (017) 555-7713 today"), (102, "please phone 0171 234 5678 today"), (103, "in 2019 2020 2021 and 1 2 3"), (104, None), (104, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.find(docs).collect()
    found = {r["doc_id"]: r["spans"] for r in got}
    assert len(got) == len(rows)
    assert found[100] == found[102] == "phone:13:26" and found[101] == "phone:13:27" and found[103] == "" and found[104] == ""
    texts = {r["doc_id"]: r["text"] for r in P.redact(docs.withColumns({"text_key": F.lit(1), "more": F.lit(2)})).collect()}
    assert texts[100] == texts[101] == "please phone <phone> today" and texts[103] == rows[43][1]


def test_patterns_against_a_plain_scoring(small):
    """The bootstrap once more with plain sets over all texts."""
    said = [f"please phone +1 555 555 {1000 + i} today or mail a{i}@b.org now" for i in range(20)] + [f"please phone 0171 234 {1000 + i} today" for i in range(4)]
    said += [f"dial 0171 234 {1000 + i % 4} at {i}, or mail code{i % 9}1234567 now" for i in range(30)]
    small = small.select("text").unionByName(small.sparkSession.createDataFrame([(t,) for t in said], "text string"))
    texts = {r["text"] for r in small.collect() if r["text"] is not None}
    found = {(k, before, after, t[a:b]) for t in texts for k, a, b, before, after in P.instances(t)}
    edges = [(k, tok, p) for k, before, after, tok in found for p in ((before, after), (before, "*")) if before and not any("0" <= c <= "9" for c in before)]
    seeds = {(tok, k) for k, _, _, tok in found if k}
    known, patterns = seeds, {}
    for _ in range(P.ROUNDS):
        kinds = collections.defaultdict(set)
        for tok, k in known:
            kinds[tok].add(k)
        every, by = collections.defaultdict(set), collections.defaultdict(lambda: collections.defaultdict(set))
        for _, tok, p in edges:
            every[p].add(tok)
            for k in kinds[tok]:
                by[p][k].add(tok)
        patterns = {}
        for p, all_ in every.items():
            n, k = max((len(by[p][k]), k) for k in P.KINDS)
            if n >= P.MIN_SUPPORT and n >= P.MIN_CONFIDENCE * len(all_):
                patterns[p] = k
        held = collections.defaultdict(list)
        for k, tok, p in edges:
            if k is None and p in patterns:
                held[tok].append(patterns[p])
        known = seeds | {(tok, min(ks)) for tok, ks in held.items()}
    got = {(r["before"], r["after"]): r["k"] for r in P.learn_patterns(P.find_instances(small)).collect()}
    assert got == patterns and patterns


def test_digests_against_a_plain_version(small):
    docs = sorted(((r["doc_id"], r["text"]) for r in small.collect()))
    found = {r["doc_id"]: r for r in quartile_digest.fingerprint_documents(small, ranges=7).collect()}
    assert len(found) == len(docs)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        r = found[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == quartile_digest.fingerprint(text.encode())
        assert r["near_edited"] == quartile_digest.likeness(r["fingerprint"], quartile_digest.fingerprint(new.encode()))
        assert r["near_next"] == quartile_digest.likeness(r["fingerprint"], quartile_digest.fingerprint(after.encode()))
    long = [i for i, t in docs if len(t) > 500]
    assert np.mean([found[i]["near_edited"] for i in long]) > np.mean([found[i]["near_next"] for i in long]) + 0.2
    assert quartile_digest.likeness("00" * 34, "00" * 34) == 1.0


def test_long_texts_without_spaces_take_linear_time():
    import time

    text = "é" * 400_000 + " call +1 555 010 9999 or a" + "b" * 400_000
    start = time.perf_counter()
    assert [i[0] for i in P.instances(text)] == ["phone"]
    assert time.perf_counter() - start < 5


def test_languages_without_a_reference_are_left_to_the_base_rules(spark):
    rng = np.random.default_rng(4)
    common = [f"the{i}" for i in range(30)]

    def prose(letters, n, often=()):
        return " ".join("".join(rng.choice(list(letters), 5)) if rng.random() < 0.6 or not often else str(rng.choice(often)) for _ in range(n))

    rows = [(i, prose("abcdefghij", 200, common), "en") for i in range(30)]
    rows += [(100, prose("абвгдежзик", 80), "ru"), (101, prose("αβγδεζηθικ", 80), None), (102, prose("klmnopqrst", 80), "xx"), (103, prose("abcdefghij", 80, common), None)]
    rows += [(104, " ".join(common[i % 30] + "#$%&" * 4 for i in range(60)) + " " + " ".join(common[:20]), "en"), (105, " ".join(common[i % 30] + f"{i}#$%&" * 4 for i in range(60)) + " " + " ".join(common[:20]), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = {r["doc_id"]: r for r in divergence.quality(docs).collect()}
    assert all(found[i]["kept"] for i in [*range(30), 100, 101, 102, 103]) and len(found) == len(rows)
    assert [found[i]["class_distance"] for i in (100, 101, 102)] == [None] * 3 and found[103]["class_distance"] is not None
    assert not found[105]["kept"]
    kept = {r["doc_id"] for r in divergence.keep_good(docs).collect()}
    assert kept == {i for i, r in found.items() if r["kept"]}
    refs = divergence.references(docs)
    assert all(divergence.judge(t, g, refs)[6] == found[i]["kept"] for i, t, g in rows)


def test_references_beyond_one_block_and_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(divergence, "NULL_BLOCK", 2)
    rows = [(k, " ".join(f"w{k}x{i % 50}" if i % 3 else f"r{k}{i}" for i in range(1200)), f"l{k}") for k in range(5)]
    rows += [(100 + k, " ".join(f"w{k}x{i}" if i % 2 else f"q{i}" for i in range(100)), None) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in divergence.quality(docs).collect()}
    refs = divergence.references(docs)
    for i, t, g in rows:
        assert found[i]["word_distance"] == divergence.judge(t, g, refs)[8] is not None
