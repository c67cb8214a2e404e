"""Personal data: fixed patterns seed a bootstrapped extraction from context.

The spans of the base patterns are seed entities.  The words around them become lexical patterns (a kind, the
word before and the word after); Spark counts for each pattern in how many different texts it holds an entity
and in how many any other identifier-like instance, and keeps the confident ones.  Instances that confident
patterns hold become entities of the next round and score patterns anew.  Instances are words with an @ or mostly
of digits, and digit groups set apart by blanks, dots, brackets or hyphens.  The graph of patterns and instances
is a table of counts, and patterns are a table too, joined to the instances of each different text: none is
dropped, and nothing is read back to the driver.

Defined results: null text is empty and has no span; repeated rows get equal spans; found spans never overlap
a base span or each other; equal texts count once as evidence; empty input, empty output.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import TOGETHER, fresh, record_batches
from wayfold.session import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern is confident with so many different supporting tokens and such a share of entities among its tokens.
MIN_SUPPORT, MIN_CONFIDENCE = 8, 0.8
#: Digits of an identifier written in several groups: from those asked of a word to those of the longest card.
RUN_DIGITS = range(7, 20)

#: The base patterns of the contract. An e-mail is grown from its @, which gives the same matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: An identifier-like token: it is four characters or longer and has a digit or an @ (asked once a token, in linear time).
_TOKEN = re.compile(r"[^\x20\x09-\x0D]{4,}")
_MARK = re.compile(r"[0-9@]")
#: Digit groups set apart by blanks, dots, brackets or hyphens, beside no letter or @.
_RUN = re.compile(r"(?<![\w@])\(?\+?[0-9][\x20().0-9-]*[0-9](?![\w@])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start():
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _side(word: str) -> str:
    """A context word: lower case, without outer punctuation."""
    return word.strip(".,;:!?'\"()[]{}<>").lower()


def instances(text: str) -> list[tuple[str | None, int, int, str, str]]:
    """(kind or null, start, end, word before, word after) of base spans and of other identifier-like tokens."""
    if not (_DIGIT.search(text) or "@" in text):
        return []
    spans = sorted((a, b, k) for k, a, b in base_spans(text))
    ends, out, reach = [], [], 0
    for a, b, k in spans:
        reach = max(reach, b)
        ends.append(reach)
    starts = [a for a, _, _ in spans]

    def free(a: int, b: int) -> bool:
        i = bisect_right(starts, b - 1)
        return i == 0 or ends[i - 1] <= a

    def around(a: int, b: int) -> tuple[str, str]:
        left, right = text[max(0, a - 60) : a].split(), text[b : b + 60].split()
        return (_side(left[-1]) if left else ""), (_side(right[0]) if right else "")

    for a, b, k in spans:
        out.append((k, a, b, *around(a, b)))
    runs = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        if " " in m.group() and sum("0" <= c <= "9" for c in m.group()) in RUN_DIGITS and free(a, b):
            runs.append((a, b))
            out.append((None, a, b, *around(a, b)))
    tops = [a for a, _ in runs]
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if not _MARK.search(text, a, b):
            continue
        while b > a and text[b - 1] in ".,;:!?)'\"":
            b -= 1
        i = bisect_right(tops, b - 1)
        if b - a >= 4 and free(a, b) and (i == 0 or runs[i - 1][1] <= a) and _looks_private(text[a:b]):
            out.append((None, a, b, *around(a, b)))
    return out


def _looks_private(token: str) -> bool:
    """Worth asking the patterns about: an @ inside, or seven digits and more of which most of the token consists."""
    digits = sum("0" <= c <= "9" for c in token)
    return "@" in token[1:-1] or (digits >= 7 and 2 * digits >= len(token))


_FOUND = "text_key string, kind string, start int, stop int, before string, after string, token string"


_FOUND_ARROW = pa.schema([(n, pa.int32() if kind == "int" else pa.string()) for n, kind in map(str.split, _FOUND.split(", "))])


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for key, text in zip(batch.column("text_key"), batch.column("text")):
                key, text = key.as_py(), text.as_py()
                yield from ((key, k, a, b, before, after, text[a:b]) for k, a, b, before, after in instances(text))

    return record_batches(rows(), _FOUND_ARROW)


def _text_key() -> Column:
    """Names a text; equal texts have equal spans, so that no row needs a number."""
    return F.sha2(F.col("text"), 256)


def find_instances(docs: DataFrame) -> DataFrame:
    """Instances of every different text, base spans among them: ``text_key, kind, start, stop, before, after, token``."""
    return materialize(docs.filter("text IS NOT NULL").select(_text_key().alias("text_key"), "text").mapInArrow(_instances, _FOUND).distinct())


def learn_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Confident patterns of ``find_instances``: ``before, after`` (``*`` for any) and the kind ``k``."""
    # An edge between a pattern and an instance, whatever the number of texts.
    edges = found.select("kind", "token", "before", "after").distinct()
    edges = materialize(edges.select("kind", "token", F.explode(F.array(F.struct("before", "after"), F.struct("before", F.lit("*").alias("after")))).alias("p")).filter(
        "p.before <> '' AND p.before RLIKE '^[^0-9]+$'"))
    seeds = materialize(found.filter("kind IS NOT NULL").select("token", "kind").distinct())
    known, before, patterns = seeds, None, None
    for _ in range(rounds):
        marked = edges.select("token", "p").distinct().join(known, "token", "left")
        scored = marked.groupBy("p").agg(F.countDistinct("token").alias("all"), *[F.countDistinct(F.when(F.col("kind") == k, F.col("token"))).alias(k) for k in KINDS])
        best = F.greatest(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("k")) for k in KINDS])
        good = scored.withColumn("b", best).filter((F.col("b.n") >= MIN_SUPPORT) & (F.col("b.n") >= MIN_CONFIDENCE * F.col("all")))
        patterns = materialize(good.select("p.before", "p.after", "b.k"))
        now = patterns.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("before", "after", "k"))).first()
        if now == before:
            break
        before = now
        held = edges.filter("kind IS NULL").select("token", "p.before", "p.after").join(patterns, ["before", "after"]).groupBy("token").agg(F.min("k").alias("kind"))
        known = materialize(seeds.unionByName(held))
    return patterns


def spans_by_text(docs: DataFrame) -> DataFrame:
    """``text_key, more``: what the patterns add to the base spans of a text, for the texts where they add any."""
    found = find_instances(docs)
    patterns = learn_patterns(found)
    asked = found.filter("kind IS NULL").select("text_key", "start", "stop", "before", "after")
    exact = patterns.filter("after <> '*'").withColumnRenamed("k", "_exact")
    wide = patterns.filter("after = '*'").select("before", F.col("k").alias("_wide"))
    hits = asked.join(exact, ["before", "after"], "left").join(wide, "before", "left").withColumn("kind", F.coalesce("_exact", "_wide")).filter("kind IS NOT NULL")
    # A stage table, so that few hits are known to be few, and the documents are not shuffled for them.
    return materialize(hits.groupBy("text_key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("more")))


def _every(text: str, more) -> tuple[list, list]:
    """Base spans, and those with ``more``; both by kind as listed, then start."""
    base = base_spans(text)
    added = [] if more is None else [(m["kind"], m["start"], m["stop"]) for m in more]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


DESCRIBED = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _described(texts: pa.Array, added: pa.Array) -> pa.Array:
    rows = []
    for t, more in zip(texts, added):
        base, every = _every(t.as_py() or "", more.as_py())
        rows.append((*[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
    fields = [c.split() for c in DESCRIBED.split(", ")]
    cells = zip(*rows) if rows else [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(cells, fields)], names=[n for n, _ in fields])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts and digest, and all spans of every row."""
    rows = docs.select("doc_id", "text", _text_key().alias("text_key")).join(spans_by_text(docs), "text_key", "left")
    return rows.select("doc_id", F.arrow_udf(_described, DESCRIBED)("text", "more").alias("s")).select("doc_id", "s.*")


def redacted(text: str | None, more=None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if text is None:
        return None
    spans = sorted((a, b, k) for k, a, b in _every(text, more)[1])
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def _redacted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, added in batches:
        for lo in range(0, len(texts), TOGETHER):
            yield pa.array([redacted(t.as_py(), more.as_py()) for t, more in zip(texts.slice(lo, TOGETHER), added.slice(lo, TOGETHER))], pa.string())


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced, and ``n_chars`` (where it exists) of changed texts set anew."""
    key, more = fresh("text_key", docs.columns), fresh("more", docs.columns)
    hits = spans_by_text(docs).select(F.col("text_key").alias(key), F.col("more").alias(more))
    rows = docs.withColumn(key, _text_key()).join(hits, key, "left")
    cells = {"text": F.arrow_udf(_redacted, "string")(F.col("text"), F.col(more))}
    if "n_chars" in docs.columns:
        cells["n_chars"] = F.when(cells["text"].eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length(cells["text"]).cast("long"))
    return rows.withColumns(cells).select(docs.columns)
