"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton.  A document is parsed greedily into the longest
phrases that occur in a language's text; the number of phrases, times the logarithm of the amount of text
learned and divided by the document's length, estimates its entropy under that language, and the least wins.

Learned is a bounded sample of each language: at most ``LEARN_CHARS`` characters, from the rows of least hash.
Every language is learned, ``LANGUAGES_AT_ONCE`` in one pass over the documents.  Every learned letter counts as
itself: a language spells its rarer letters with several codes, so that the tables stay narrow in any script.
Every text is parsed whole, in blocks of ``BLOCK`` characters that many texts share step by step; a block's end
ends a phrase.

Defined results: ``und`` with score 0 where the text is null or has no letter, or nothing could be learned;
ties go to the first language by code point; repeated rows get equal results; empty input, empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import seeded_hash
from wayfold.session import materialize

SEED = 4
LEARN_CHARS = 20_000
LEARN_ROWS = 400
LANGUAGES_AT_ONCE = 64
#: Codes of a language: no letter, a letter not learned, then single letters; where there are more letters than
#: codes, the commonest up to ``SINGLES`` keep one code, and the others take first and later digits of 16 values.
ALPHABET, SINGLES, DIGIT = 96, 64, 16
POINTS = 0x110000
BLOCK = 512
BATCH_BLOCKS = 8192


def normal(text: str) -> str:
    return text.lower()


@lru_cache(1)
def letters() -> np.ndarray:
    """1 for the code points that are letters, else 0."""
    return np.fromiter((chr(c).isalpha() for c in range(POINTS)), np.uint8, POINTS)


def alphabet(texts: dict[str, str]) -> np.ndarray:
    """Numbers of code points: 0 what is no letter, 1 letters not learned, then the learned letters, commonest first."""
    seen: dict[str, int] = {}
    for t in texts.values():
        for c in normal(t):
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    table = letters().astype(np.min_scalar_type(len(seen) + 2))
    for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c))):
        table[ord(c)] = i + 2
    return table


def encode(text: str, table: np.ndarray) -> np.ndarray:
    """Numbers of the text's characters, with runs of what is no letter as one 0."""
    points = np.frombuffer(normal(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = table[points]
    return codes[~((codes == 0) & (np.r_[1, codes[:-1]] == 0))] if len(codes) else codes


class Spelling:
    """How one language writes the numbers of ``encode`` in its ``ALPHABET`` codes."""

    def __init__(self, learned: np.ndarray, numbers: int):
        counts = np.bincount(learned, minlength=numbers)
        counts[:2] = 0
        own = np.flatnonzero(counts)
        own = own[np.argsort(-counts[own], kind="stable")]
        self.rank = np.ones(numbers, np.int32)
        self.rank[0] = 0
        self.rank[own] = np.arange(2, len(own) + 2)
        self.digits = 0
        if len(own) + 2 > ALPHABET:
            self.digits = next(d for d in range(1, 6) if DIGIT**d >= len(own) + 2 - SINGLES)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        rank = self.rank[numbers]
        if not self.digits:
            return rank
        times = np.where(rank >= SINGLES, self.digits, 1)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rank = np.repeat(rank, times)
        digit = (rank - SINGLES) // DIGIT ** np.maximum(self.digits - 1 - place, 0) % DIGIT
        return np.where(rank < SINGLES, rank, np.where(place == 0, SINGLES, SINGLES + DIGIT) + digit)


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


def automaton_table(step: list[dict[int, int]]) -> np.ndarray:
    """Flat table: 2 * next state, odd where the letter ends the phrase and starts the next one."""
    root = np.zeros(ALPHABET, np.int32)
    for c, to in step[0].items():
        root[c] = 2 * to
    table = np.tile(root + 1, (len(step), 1)).astype(np.int32)
    for s, out in enumerate(step):
        for c, to in out.items():
            table[s, c] = 2 * to
    return table.reshape(-1)


class Model:
    """What was learned; bounded by the parameters above, built once and shipped as a broadcast."""

    def __init__(self, texts: dict[str, str]):
        texts = {g: t for g, t in texts.items() if any(c.isalpha() for c in t)}
        self.langs = sorted(texts)
        self.table = alphabet(texts)
        coded = [encode(texts[g], self.table) for g in self.langs]
        numbers = int(self.table.max()) + 1
        self.spelled = [Spelling(x, numbers) for x in coded]
        self.automata = [automaton_table(suffix_automaton(spell(x))) for spell, x in zip(self.spelled, coded)]
        self.logs = np.array([np.log2(len(x) + 1) for x in coded])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases, texts by languages."""
        owner, parts = [], []
        for i, codes in enumerate(texts):
            parts += [codes[lo : lo + BLOCK] for lo in range(0, len(codes), BLOCK)]
            owner += [i] * (len(parts) - len(owner))
        total = np.zeros((len(texts), len(self.langs)))
        for lo in range(0, len(parts), BATCH_BLOCKS):
            some, of = parts[lo : lo + BATCH_BLOCKS], np.array(owner[lo : lo + BATCH_BLOCKS])
            plain = None
            for g, (spell, table) in enumerate(zip(self.spelled, self.automata)):
                if spell.digits:
                    order, live, grid = _grid([spell(x) for x in some])
                else:
                    plain = plain or _grid(some)
                    order, live, grid = plain[0], plain[1], spell.rank[plain[2]]
                state = np.zeros(len(some), np.int32)
                count = np.ones(len(some), np.int32)
                for codes, n in zip(grid, live):
                    state[:n] *= ALPHABET
                    state[:n] += codes[:n]
                    to = table[state[:n]]
                    count[:n] += to & 1
                    np.right_shift(to, 1, out=state[:n])
                np.add.at(total[:, g], of[order], count)
        return total

    def nearest(self, texts: list[str | None]) -> list[tuple[float | None, str | None, float | None]]:
        """(least rate, its language, next rate) of each text; nulls where the text has no letter."""
        out: list = [(None, None, None)] * len(texts)
        coded = [encode(t or "", self.table) for t in texts]
        rows = [i for i, c in enumerate(coded) if self.langs and (c > 0).any()]
        if not rows:
            return out
        rate = self.phrases([coded[i] for i in rows]) * self.logs / np.array([[len(coded[i])] for i in rows])
        for i, r in zip(rows, rate):
            best = int(np.argmin(r))
            rest = np.delete(r, best)
            out[i] = (float(r[best]), self.langs[best], float(rest.min()) if len(rest) else None)
        return out


def _grid(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts by length, the longest first: their order, how many are left at each step, and their codes by step."""
    sizes = np.array([len(p) for p in parts])
    order = np.argsort(-sizes, kind="stable")
    grid = np.zeros((sizes.max(), len(parts)), np.int32)
    for k, i in enumerate(order):
        grid[: sizes[i], k] = parts[i]
    return order, np.searchsorted(-sizes[order], -np.arange(len(grid)), side="left"), grid


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, learn_chars: int = LEARN_CHARS, at_once: int | None = None) -> Iterator[Model]:
    """Models of the labelled rows ``doc_id, text, lang``, ``at_once`` languages each: of every language a sample of fixed largest size."""
    own = Window.partitionBy("lang").orderBy("h", "doc_id")

    def first(rows: DataFrame, size: Column) -> DataFrame:
        """The first rows of each language, up to the one that completes the sample."""
        ranked = rows.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= LEARN_ROWS)
        return ranked.withColumn("upto", F.sum(size).over(own)).filter(F.col("upto") - size < learn_chars)

    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", F.substring("text", 1, learn_chars).alias("text"), seeded_hash(SEED, F.col("doc_id")).alias("h"))
    # Where each sample ends is found on rows without texts, so that texts beyond it are never shuffled.
    ends = first(labelled.select("lang", "doc_id", "h", F.char_length("text").alias("n")), F.col("n")).groupBy("lang").agg(F.max(F.struct("h", "doc_id")).alias("_end"))
    wanted = labelled.join(materialize(ends), "lang").filter(F.struct("h", "doc_id") <= F.col("_end"))
    sample = materialize(first(wanted, F.char_length("text")).select("lang", "h", "doc_id", "text"))
    texts: dict[str, str] = {}
    for r in sample.orderBy("lang", "h", "doc_id").select("lang", "text").toLocalIterator():
        if r["lang"] not in texts and len(texts) == (at_once or LANGUAGES_AT_ONCE):
            yield Model(texts)
            texts = {}
        texts[r["lang"]] = (texts.get(r["lang"], "") + "\n" + r["text"])[: learn_chars + 1]
    yield Model(texts)


def _nearest(model: Model, docs: DataFrame) -> Column:
    """``rate, lang, next`` of ``text`` among the model's languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        found = []
        for lo in range(0, len(texts), 512):
            found += shared.value.nearest(list(texts.iloc[lo : lo + 512]))
        return pd.DataFrame(found, columns=["rate", "lang", "next"])

    return F.pandas_udf(run, "rate double, lang string, next double")(F.col("text"))


def identify(docs: DataFrame, models: Iterator[Model]) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the nearest language of all models."""
    out = docs.select("doc_id", "text")
    for turn, model in enumerate(models):
        if turn:  # a task holds one model at a time
            out = materialize(out)
        found = _nearest(model, docs)
        if turn:
            out = out.withColumn("_found", found).withColumn("_near", F.struct(
                F.least("_near.rate", "_found.rate").alias("rate"),
                F.least(F.struct("_near.rate", "_near.lang"), F.struct("_found.rate", "_found.lang"))["lang"].alias("lang"),
                F.least(F.greatest("_near.rate", "_found.rate"), "_near.next", "_found.next").alias("next"))).drop("_found")
        else:
            out = out.withColumn("_near", found)
    score = F.when(F.col("_near.lang").isNull(), 0.0).when(F.col("_near.next") > 0, 1 - F.col("_near.rate") / F.col("_near.next")).otherwise(1.0)
    return out.select("doc_id", F.coalesce("_near.lang", F.lit("und")).alias("lang_pred"), score.alias("score"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out, predicts all: ``doc_id, held_out, lang_pred, score``."""
    models = learn(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, models).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
