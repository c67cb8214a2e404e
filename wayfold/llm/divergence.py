"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of the language's most common words are compared
with those of its language over the whole corpus, by Jensen-Shannon distance (0 to 1).  Histograms of short
texts are noise, so each comparison has a least length under which it does not count.

Defined results: null text has no word and fails the base rules; without a reference of its language the base
rules alone decide on a document; where the language is null, the reference counts whose common words are most of
the text, if they are enough to be in that language; repeated rows get equal verdicts; empty input, empty output.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import fresh, record_batches, words_of
from wayfold.session import materialize

COMMON_WORDS = 100
#: Words of a language that make a reference.
MIN_REFERENCE_WORDS = 1000
#: References that a row without language is compared with at once; further ones follow.
NULL_BLOCK = 1000
MIN_CHARS, MIN_WORDS = 200, 60
#: Between labelled good texts (up to 0.29 and 0.45) and labelled bad ones (from 0.33 and 0.53, mostly).
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.5
#: Share of a language's common words from which a text is in it: labelled good texts have 0.18 or more of their
#: own, 95 % of all texts at most 0.033 of another.
SAME_LANGUAGE = 0.1
FLUSH = 200_000

_SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class of each UTF-8 byte: 0 lower, 1 upper, 2 digit, 3 space, 4 sentence mark, 5 symbol, 6 other ASCII, 7 beyond ASCII, 8 continuation."""
    table = np.full(256, 6)
    for b in range(256):
        c = bytes([b])
        table[b] = 8 if 128 <= b < 192 else 7 if b >= 192 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in b".,;:!?'\"()-" else 5 if c in _SYMBOLS else 6
    return table


CLASSES = _class_table()


def class_counts(data: bytes) -> np.ndarray:
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(CLASSES, weights=hist, minlength=9)[:8]


def repeated(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mix = np.zeros(n, np.uint64)
    for i in range(width):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    ordered = np.sort(mix)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    counts = Counter(windows)
    inside = np.zeros(len(words) + 1, np.int64)
    for i, window in enumerate(windows):
        if counts[window] > 1:
            inside[i] += 1
            inside[i + width] -= 1
    return int((np.cumsum(inside)[:-1] > 0).sum())


def duplicate_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two histograms with positive sums, with logarithms of base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, one / 2)))


_COUNTED = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (kind 0) and character classes (kind 1) by language, summed within a task before the shuffle."""
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def sums() -> Iterator[tuple]:
        for lang, c in words.items():
            yield from ((lang, 0, w.decode("utf-8", "replace"), n) for w, n in c.items())
        for lang, c in classes.items():
            yield from ((lang, 1, str(i), int(n)) for i, n in enumerate(c))

    def flush() -> Iterator[pa.RecordBatch]:
        yield from record_batches(sums(), _COUNTED)
        words.clear()
        classes.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang, text = lang.as_py(), text.as_py()
            words.setdefault(lang, Counter()).update(words_of(text.lower()))
            classes[lang] = classes.get(lang, 0) + class_counts(text.encode("utf-8", "surrogatepass"))
            if sum(map(len, words.values())) > FLUSH:
                yield from flush()
    yield from flush()


def reference_table(docs: DataFrame, top: int = COMMON_WORDS) -> DataFrame:
    """``lang, ref``: for each language with enough words its commonest words and class counts, as JSON."""
    counted = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_count, "lang string, kind int, item string, n long")
    sums = materialize(counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    ranked = sums.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top)
    totals = sums.filter("kind = 0").groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= MIN_REFERENCE_WORDS)
    items = F.array_sort(F.collect_list(F.struct("kind", "r", "item", "n")))
    return materialize(ranked.join(totals, "lang").groupBy("lang").agg(F.to_json(F.struct("lang", F.first("total").alias("total"), items.alias("items"))).alias("ref")))


def _reference(ref: str) -> dict:
    """A reference: its words, their counts with that of all others last, and its class counts."""
    said = json.loads(ref)
    words = [x for x in said["items"] if x["kind"] == 0]
    classes = [0.0] * 8
    for x in said["items"]:
        if x["kind"] == 1:
            classes[int(x["item"])] = float(x["n"])
    counts = [x["n"] for x in words]
    return {"lang": said["lang"], "words": {x["item"].encode(): i for i, x in enumerate(words)}, "word_counts": [*counts, said["total"] - sum(counts)], "classes": classes, "total": said["total"]}


def references(docs: DataFrame, top: int = COMMON_WORDS) -> list[dict]:
    """All references of a table with few languages, for looking at; ``quality`` joins them."""
    return [_reference(r["ref"]) for r in reference_table(docs, top).orderBy("lang").collect()]


def word_distance(lowered: Counter, ref: dict) -> float:
    mine = np.zeros(len(ref["word_counts"]))
    for w, i in ref["words"].items():
        mine[i] = lowered.get(w, 0)
    mine[-1] = sum(lowered.values()) - mine.sum()
    return jensen_shannon(mine, np.array(ref["word_counts"], dtype=float))


def nearest(text: str | None, refs: list[dict]) -> tuple[float, dict] | None:
    """Share of common words and reference of the language that a text is in, if one is near enough."""
    lowered = Counter(words_of((text or "").lower()))
    if not lowered or not refs:
        return None
    share = [sum(lowered.get(w, 0) for w in r["words"]) / sum(lowered.values()) for r in refs]
    i = min(range(len(refs)), key=lambda i: (-share[i], refs[i]["lang"]))
    return (share[i], refs[i]) if share[i] >= SAME_LANGUAGE else None


def judge(text: str | None, lang: str | None, refs: list[dict]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class and word distance."""
    data = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n, again = len(words), repeated(words)
    chars = len(text or "") - int(hist[[9, 10, 11, 12, 13, 32]].sum())
    failed = n < 10 or 100 * again > 20 * n
    if lang is None:
        near = nearest(text, refs)
        own = near and near[1]
    else:
        own = next((r for r in refs if r["lang"] == lang), None)
    by_class, by_word = None, None
    if own and len(data) >= MIN_CHARS:
        by_class = jensen_shannon(np.bincount(CLASSES, weights=hist, minlength=9)[:8], np.array(own["classes"]))
    if own and n >= MIN_WORDS:
        by_word = word_distance(Counter(words_of((text or "").lower())), own)
    kept = not failed and (by_class is None or by_class <= MAX_CLASS_DISTANCE) and (by_word is None or by_word <= MAX_WORD_DISTANCE)
    return n, chars, int(hist[list(_SYMBOLS)].sum()), duplicate_lines(data), again, failed, kept, by_class, by_word


FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean",
    "class_distance": "double", "word_distance": "double",
}


def verdict(text: Column, lang: Column, ref: Column) -> Column:
    """The fields of ``judge``, where ``ref`` is the JSON of the reference that counts, or null."""

    @F.arrow_udf(", ".join(f"{f} {kind}" for f, kind in FIELDS.items()))
    def run(texts: pa.Array, langs: pa.Array, refs: pa.Array) -> pa.Array:
        return _judged_texts(texts, langs, refs)

    return run(text, lang, ref)


_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def _judged_texts(texts: pa.Array, langs: pa.Array, refs: pa.Array) -> pa.Array:
    """``judge`` of one text after the other, a struct each; a distance that is no number is null."""
    known = {r: [_reference(r)] for r in refs.unique().to_pylist() if r is not None}
    found = [judge(t.as_py(), g.as_py(), known.get(r.as_py(), [])) for t, g, r in zip(texts, langs, refs)]
    cells = zip(*found) if found else [()] * len(FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, _KINDS[kind], from_pandas=True) for c, kind in zip(cells, FIELDS.values())], names=list(FIELDS))


def _nearer(text: Column, near: Column, block: list[str]) -> Column:
    """``near`` (share of common words and JSON of a reference), or what is nearer among ``block``."""

    @F.arrow_udf("share double, ref string")
    def run(texts: pa.Array, shares: pa.Array, refs: pa.Array) -> pa.Array:
        known, out = [_reference(r) for r in block], []
        of = {r["lang"]: s for r, s in zip(known, block)}
        for t, share, ref in zip(texts, shares.to_pylist(), refs.to_pylist()):
            found = nearest(t.as_py(), known)
            out.append((share, ref) if found is None or (ref is not None and share >= found[0]) else (found[0], of[found[1]["lang"]]))
        share, ref = zip(*out) if out else ((), ())
        return pa.StructArray.from_arrays([pa.array(share, pa.float64()), pa.array(ref, pa.string())], names=["share", "ref"])

    return run(text, near["share"], near["ref"])


def _judged(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the fields of ``judge`` in a column, and that column's name."""
    refs, v, ref = reference_table(docs), fresh("_v", docs.columns), fresh("_ref", docs.columns)
    key = fresh("_lang", docs.columns)
    named = docs.filter("lang IS NOT NULL").join(refs.select(F.col("lang").alias(key), F.col("ref").alias(ref)), F.col(key) == docs["lang"], "left").drop(key)
    bare = docs.filter("lang IS NULL").withColumn(ref, F.lit(None).cast("struct<share double, ref string>"))
    if docs.filter("lang IS NULL").limit(1).count():
        blocks: list[str] = []
        for r in refs.orderBy("lang").toLocalIterator():
            blocks.append(r["ref"])
            if len(blocks) == NULL_BLOCK:
                bare, blocks = bare.withColumn(ref, _nearer(F.col("text"), F.col(ref), blocks)), []
        if blocks:
            bare = bare.withColumn(ref, _nearer(F.col("text"), F.col(ref), blocks))
    rows = named.unionByName(bare.withColumn(ref, F.col(ref)["ref"]))
    return rows.withColumn(v, verdict(F.col("text"), F.col("lang"), F.col(ref))).drop(ref), v


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fields of ``judge`` for every row."""
    rows, v = _judged(docs.select("doc_id", "text", "lang"))
    return rows.select("doc_id", F.col(v).alias("v")).select("doc_id", "v.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, unchanged."""
    rows, v = _judged(docs)
    return rows.filter(F.col(v)["kept"]).drop(v)
