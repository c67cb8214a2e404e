"""Near copies by the trie self-join: texts that share 80 % of their five-word shingles.

Each set of shingles has ``PRINTS`` fingerprints of ``PRINT_BITS`` bits, a bit being one of a least hash of the set, so
that sets of similarity J agree in a bit with probability (1 + J) / 2.  Pairs within one differing bit of some
fingerprint are found by walking binary tries (``simhash_trie``), and are then counted exactly: of pairs at 0.80 the
tries miss 0.8 %, at 0.85 fewer than one in 10,000.

The least hashes come from one sketch (bins filled in rounds, an earlier round always before a later one), which costs
a few thousand hashes a text however many bins there are.

Sets that are equal are one node.  Star rounds come first: of the nodes that share a whole fingerprint, each is asked
against the one that meets the most others, which is the likely original, so that copies of one original are joined
without a pair of every two.  The tries then ask what is still apart, first for a spanning forest of each run that
prefers such nodes, then for every pair.

In a crowd (many copies of one original that are less alike to each other than to it) every pair would be the square of
its size.  Nodes of a crowd therefore carry how many hashes of their set fall into each of ``BUCKETS`` buckets: sets
differ in at least as many hashes as these numbers do, so a pair for which that is too many is no near copy, and is not
asked.  This leaves out no link; it decides on speed only.

Defined results: wordless and null texts are copies of each other; repeated rows are copies; the row that stays is that
of the least doc_id (nulls last), of equal ids the one with the least text digest; empty input, empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm import simhash_trie as trie
from wayfold.llm.common import fresh
from wayfold.llm.graph import Rooted
from wayfold.llm.shingles import STEP, alike, mixed, set_digest, shingle_set, shingled, text_key
from wayfold.session import materialize

WIDTH, PERCENT = 5, 80
PRINTS, PRINT_BITS, BUDGET = 24, 30, 1
#: Star rounds; they decide on speed, not on results.
STARS = 3
#: Differing bits of all fingerprints beyond which a pair is not counted: similarity 0.8 has more with probability 3e-5.
MOST_BITS = 104
#: Pairs that are compared at once; of those with buckets.
CELLS, BUCKETED = 1 << 20, 4096
#: Buckets (a power of two, a byte each) of the hashes of a set, for nodes that meet ``CROWD`` in all fingerprints.
BUCKETS, CROWD = 512, 24
#: Hashes of a round of the sketch that are looked at together.
TOGETHER = 4096


def least_hashes(hashes: np.ndarray, bins: int) -> np.ndarray:
    """(round, hash) of the least element of each bin; the rounds go on until each bin has one."""
    out, turn = np.full(bins, 2**64 - 1, np.uint64), 0
    while len(hashes) and (out == 2**64 - 1).any():
        rounds = np.arange(turn, turn + max(1, TOGETHER // len(hashes)), dtype=np.uint64)
        turn += len(rounds)
        for lo in range(0, len(hashes), TOGETHER):
            x = mixed(hashes[None, lo : lo + TOGETHER] ^ mixed((rounds + np.uint64(1)) * STEP)[:, None])
            at = ((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            np.minimum.at(out, at.reshape(-1).astype(np.int64), ((rounds[:, None] << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))).reshape(-1))
    return out


def prints(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints of a set, each in the highest bits of a uint64."""
    bits = (mixed(least_hashes(hashes, PRINTS * PRINT_BITS)) & np.uint64(1)).reshape(PRINTS, PRINT_BITS)
    return (bits << np.arange(63, 63 - PRINT_BITS, -1, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, node, n, prints``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(t.as_py(), WIDTH) for t in batch.column("text"))
            cells = [(set_digest(s), len(s), prints(s).tobytes()) for s in sets]
            node, n, bits = zip(*cells) if cells else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(node, pa.string()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "text_key", "node", "n", "prints"])

    more = [T.StructField("text_key", T.StringType()), T.StructField("node", T.StringType()), T.StructField("n", T.LongType()), T.StructField("prints", T.BinaryType())]
    return docs.select("doc_id", text_key(F.col("text"), F.col("doc_id")).alias("text_key"), "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *more]))


def _cells(nodes: DataFrame) -> DataFrame:
    """``t, fp, id``: a row for each fingerprint of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column("prints").to_pylist()), np.int64)
            ids = np.repeat(batch.column("id").to_numpy(), PRINTS)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(PRINTS, dtype=np.int32), batch.num_rows)), pa.array(bits), pa.array(ids)], names=["t", "fp", "id"])

    return nodes.select("id", "prints").mapInArrow(run, "t int, fp long, id long")


def buckets(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall into each bucket by their highest bits, 255 at most."""
    at = (hashes >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=BUCKETS), 255).astype(np.uint8)


def _bucketed(crowd: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, buckets`` of the nodes of ``crowd`` (``id``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [buckets(s.values.to_numpy().view(np.uint64)).tobytes() for s in batch.column("s")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cells, pa.binary())], names=["id", "buckets"])

    return shingled(crowd.select("id"), nodes, docs, WIDTH).mapInArrow(run, "id long, buckets binary")


def can_share(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets, by buckets (a row each) and sizes, can share ``percent`` per cent of their union.

    Sets that differ in d hashes have buckets that differ by d in all at most, also where 255 is the most they say.
    """
    apart = (np.maximum(left, right) - np.minimum(left, right)).sum(1, dtype=np.int64)
    same = np.minimum((n + m - apart) // 2, np.minimum(n, m))
    return 100 * same >= percent * (n + m - same)


def _forest(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of each run that join what is apart in it; those of nodes that meet many come first."""
    turned, side, ids, roots, met = (frame[c].to_numpy() for c in ("turned", "side", "id", "root", "met"))
    out = []
    for lo, hi in trie.runs_of(frame):
        if (roots[lo:hi] == roots[lo]).all():
            continue
        known: dict[int, int] = {}
        pairs = [(lo + i, lo + j) for i, j in trie.run_pairs(turned[lo:hi].view(np.uint64), side[lo:hi], BUDGET) if roots[lo + i] != roots[lo + j]]
        for i, j in sorted(pairs, key=lambda p: (-max(met[p[0]], met[p[1]]), p)):
            x, y = _find(known, int(roots[i])), _find(known, int(roots[j]))
            if x != y:
                known[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _find(known: dict[int, int], x: int) -> int:
    while x in known:
        x = known[x]
    return x


def _first_met(left: np.ndarray, right: np.ndarray, block: int) -> np.ndarray:
    """Which pairs are close enough over all fingerprints, and meet in ``block`` before any other; so a pair comes once."""
    apart = left ^ right
    bits = np.bitwise_count(apart)
    first = (bits <= BUDGET).argmax(1)
    edges = [at for at, _ in trie.blocks(BUDGET, PRINT_BITS)]
    at_first, own = apart[np.arange(len(apart)), first], np.full(len(apart), len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        inside = (at_first << np.uint64(edges[k])) >> np.uint64(64 - (edges[k + 1] - edges[k]))
        own = np.where(inside == 0, k, own)
    return (bits.sum(1, dtype=np.int64) <= MOST_BITS) & (first * (BUDGET + 1) + own == block)


def _every(frame: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """All pairs of each run that are in different components and whose fingerprints and buckets allow the similarity."""
    turned, side, ids, roots, blocks, n = (frame[c].to_numpy() for c in ("turned", "side", "id", "root", "block", "n"))
    bits = np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(len(frame), -1)
    held = frame["buckets"].str.len().to_numpy() > 0
    place, counts = np.cumsum(held) - 1, np.frombuffer(b"".join(frame["buckets"]), np.uint8).reshape(-1, BUCKETS)

    def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        good = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
        both = np.flatnonzero(good & held[i] & held[j])
        for lo in range(0, len(both), BUCKETED):
            at = both[lo : lo + BUCKETED]
            good[at] = can_share(counts[place[i[at]]], counts[place[j[at]]], n[i[at]], n[j[at]], percent)
        return good

    out = [np.zeros((0, 2), np.int64)]
    for lo, hi in trie.runs_of(frame):
        if (roots[lo:hi] == roots[lo]).all():
            continue
        run, kind = turned[lo:hi].view(np.uint64), side[lo:hi]
        left, right = np.flatnonzero(kind != 2) + lo, np.flatnonzero(kind != 1) + lo
        for a, b, c, d in trie.leaves(run[left - lo], run[right - lo], not kind.any(), BUDGET):
            other = right[c:d]
            for at in range(a, b, max(1, CELLS // (d - c))):
                some = left[at : min(b, at + max(1, CELLS // (d - c)))]
                i, j = np.nonzero((np.bitwise_count(turned[some, None] ^ turned[None, other]) <= BUDGET) & (roots[some, None] != roots[None, other]))
                near = _first_met(bits[some[i]], bits[other[j]], int(blocks[lo]))
                i, j = some[i[near]], other[j[near]]
                asked = possible(i, j)
                out.append(np.stack([ids[i[asked]], ids[j[asked]]], 1))
    pairs = np.concatenate(out)
    return pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)}).drop_duplicates() if len(pairs) else pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _walked(groups: DataFrame, extra: list[str], give, run_limit: int) -> DataFrame:
    """``a, b`` from the tries of ``groups`` (``t, fp`` and ``extra``), a trie for each block of each fingerprint."""
    rows = groups.select("t", trie.turned([F.col("fp")], BUDGET, PRINT_BITS).alias("x"), *extra)
    rows = rows.select((F.col("t") * (BUDGET + 1) + F.col("x.block")).alias("block"), "x.run", "x.turned", F.lit(0).alias("side"), F.lit(0).alias("spent"), *extra)
    return trie.joined(trie.parted(rows, BUDGET, run_limit, extra, PRINT_BITS), give, extra, "a long, b long")


def _asked(cells: DataFrame, run_limit: int) -> DataFrame:
    """``a, b``: candidates that join what is apart, from cells (``t, fp, id, met, root``)."""
    place = F.struct("met", "id", "root")
    groups = materialize(cells.groupBy("t", "fp").agg(F.max(place).alias("rep"), F.min("root").alias("lo"), F.max("root").alias("hi")))
    mixed_groups = groups.filter("lo < hi").select("t", "fp", "rep")
    stars = cells.join(mixed_groups, ["t", "fp"]).filter(F.col("root") != F.col("rep.root")).select(F.col("rep.id").alias("a"), F.col("id").alias("b"))
    walks = _walked(groups.select("t", "fp", "rep.id", "rep.root", "rep.met"), ["id", "root", "met"], _forest, run_limit)
    return _distinct(stars.unionByName(walks))


def _starred(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b``: the members of each fingerprint with the one that meets the most others; and the cells apart from it."""
    place = F.struct("met", "id", "root")
    groups = cells.groupBy("t", "fp").agg(F.max(place).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("t", "fp", "hub")
    star = materialize(cells.join(groups, ["t", "fp"]).filter(F.col("root") != F.col("hub.root")).select("t", "fp", "id", "met", F.col("hub.id").alias("hub")))
    return _distinct(star.select(F.col("hub").alias("a"), F.col("id").alias("b"))), star.drop("hub")


def _apart(cells: DataFrame, run_limit: int, percent: int) -> DataFrame:
    """``a, b``: every pair of different components within the budget of some fingerprint that can be near copies.

    From cells with ``bits``, ``n`` and ``buckets`` (empty: not known).
    """
    extra = ["id", "root", "bits", "n", "buckets"]
    return _distinct(_walked(cells.select("t", "fp", *extra), extra, lambda frame: _every(frame, percent), run_limit))


def _distinct(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())


def near_copies(docs: DataFrame, percent: int = PERCENT, run_limit: int = trie.RUN_LIMIT) -> DataFrame:
    """``doc_id, text_key, root``: rows that a chain of near copies connects have one ``root``."""
    rows = materialize(_sketched(docs))
    nodes = rows.groupBy("node").agg(F.min(F.struct("text_key", "n", "prints")).alias("x"))
    nodes = materialize(nodes.select("node", "x.*").withColumn("id", F.monotonically_increasing_id()))
    cells = _cells(nodes)
    shared = cells.groupBy("t", "fp").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    shared = materialize(cells.join(shared, ["t", "fp"]))
    met = materialize(shared.groupBy("id").agg(F.sum("many").alias("met")))
    apart, asked, roots = shared.join(met, "id").drop("many").withColumn("root", F.col("id")), None, Rooted()
    for _ in range(STARS):
        pairs, apart = _starred(apart)
        pairs = pairs if asked is None else materialize(pairs.join(asked, ["a", "b"], "left_anti"))
        roots.add(alike(pairs, nodes, docs, WIDTH, percent))
        asked = pairs if asked is None else asked.unionByName(pairs)
        apart = roots.name(apart)
    known = nodes.join(met, "id", "left").withColumn("met", F.coalesce("met", F.lit(0)))
    rooted = materialize(roots.name(known.select("id", "met", "prints")))
    more = materialize(_asked(_cells(rooted).join(rooted.select("id", "met", "root"), "id"), run_limit).join(asked, ["a", "b"], "left_anti"))
    roots.add(alike(more, nodes, docs, WIDTH, percent))
    asked = asked.unionByName(more)
    some = asked.select(F.explode(F.array("a", "b")).alias("id")).distinct()  # who has no candidate at all has none below
    rooted = materialize(roots.name(known.join(some, "id", "left_semi").select("id", "met", "n", "prints")))
    wide = rooted.join(_bucketed(rooted.filter(F.col("met") >= CROWD), nodes, docs), "id", "left")
    wide = materialize(wide.select("id", "root", "n", F.col("prints").alias("bits"), F.coalesce("buckets", F.lit(b"")).alias("buckets")))
    more = _apart(_cells(rooted).join(wide, "id"), run_limit, percent).join(asked, ["a", "b"], "left_anti")
    roots.add(alike(more, nodes, docs, WIDTH, percent))
    ids = roots.name(nodes.select("node", "id")).select("node", "root")
    return rows.select("doc_id", "text_key", "node").join(ids, "node").select("doc_id", "text_key", "root")


def keep_one_near_copy(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    found = near_copies(docs, **how)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("text_key").alias("k"))).alias("s")).select("s.k").distinct()
    key = fresh("_key", docs.columns)
    return docs.withColumn(key, text_key(F.col("text"), F.col("doc_id"))).join(stay.withColumnRenamed("k", key), key, "left_semi").dropDuplicates([key]).drop(key)
