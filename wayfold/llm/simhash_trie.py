"""SimHash near-duplicates by a self-join of binary tries.

Two fingerprints that differ in at most ``k`` of 64 bits agree wholly on one of ``k + 1`` bit blocks.  For each
block the different fingerprints are turned so that the block leads, and are sorted: all that share a block are
one run, and the run is a binary trie.  Pairs of its nodes are walked down together; the differing bits add up,
and a pair of nodes is left as soon as they exceed ``k``.  Runs above ``RUN_LIMIT`` are first parted into
pairs of deeper nodes over the cluster (every node pair within the budget is kept, so no link is lost).

Links are needed for components only, so a run gives a spanning forest of its links, not all pairs.  Equal
fingerprints are one node from the start: a group of copies, however large, is one row.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows share a
component; a null doc_id is never a component id unless its component has no other; empty input, empty output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import fresh
from wayfold.llm.graph import components
from wayfold.session import materialize

SHINGLE = 3
MAX_BITS = 2
BITS = 64
#: Fingerprints of one run that one task walks; 16 bytes each.
RUN_LIMIT = 100_000
#: Bits by which a larger run is parted in each round.
PART_BITS = 4


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; hashes are XXH64 with seed 42."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower is A-Z only
    if not words:
        return 0
    joined = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = np.fromiter(map(_XXH, joined), np.uint64, len(joined))
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[lo : lo + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def _XXH(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, 42)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return run(text)


def blocks(k: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, bits) of the k + 1 blocks of the highest ``bits``, from the highest bit."""
    edges = [round(bits * i / (k + 1)) for i in range(k + 2)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def walk(left: np.ndarray, right: np.ndarray, same: bool, k: int) -> Iterator[tuple[int, int]]:
    """Index pairs of two sorted arrays of different uint64 that differ in at most k bits; i < j if ``same``."""
    for a, b, c, d in leaves(left, right, same, k):
        differ = np.bitwise_count(left[a:b, None] ^ right[None, c:d]) <= k
        for i, j in zip(*np.nonzero(differ)):
            if not same or a + i < c + j:
                yield a + int(i), c + int(j)


def leaves(left: np.ndarray, right: np.ndarray, same: bool, k: int) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of ranges of two sorted uint64 arrays under which all pairs within k bits lie."""
    small = 24
    stack = [(0, len(left), 0, len(right), BITS - 1, 0)]
    while stack:
        a, b, c, d, bit, spent = stack.pop()
        twin = same and a == c
        if (b - a) * (d - c) <= small * small or bit < 0:
            yield a, b, c, d
            continue
        mask = np.uint64((1 << bit) - 1)
        top = np.uint64(1 << bit)
        m = a + int(np.searchsorted(left[a:b], (left[a] & ~(mask | top)) | top))
        n = c + int(np.searchsorted(right[c:d], (right[c] & ~(mask | top)) | top))
        for lo, hi in ((a, m), (m, b)):
            for lo2, hi2 in ((c, n), (n, d)):
                cost = spent + ((lo < m) != (lo2 < n))
                if lo == hi or lo2 == hi2 or cost > k or (twin and lo > lo2):
                    continue
                stack.append((lo, hi, lo2, hi2, bit - 1, cost))


def run_pairs(run: np.ndarray, side: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Places in a sorted run of pairs within k bits; side 0: within one node, 1 and 2: across two."""
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    if len(left) and len(right):
        for i, j in walk(run[left], run[right], not side.any(), k):
            yield int(left[i]), int(right[j])


def _forest(run: np.ndarray, side: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links of a run that join its members."""
    root = list(range(len(run)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in run_pairs(run, side, k):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(run[i]), int(run[j])))
    return out


def runs_of(frame: pd.DataFrame) -> Iterator[tuple[int, int]]:
    key = frame[["block", "run"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
    for lo, hi in zip(starts, np.r_[starts[1:], len(frame)]):
        if hi - lo > 1:
            yield int(lo), int(hi)


def _bit_links(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """Linked fingerprints, turned back."""
    turned, side = frame["turned"].to_numpy(np.int64).view(np.uint64), frame["side"].to_numpy()
    cells = []
    for lo, hi in runs_of(frame):
        back = blocks(k)[int(frame["block"].iat[lo])][0]
        for pair in _forest(turned[lo:hi], side[lo:hi], k):
            cells.append(tuple(((x >> back) | (x << (BITS - back))) & (2**BITS - 1) for x in pair))
    pairs = np.array(cells, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _join_runs(batches: Iterator[pd.DataFrame], give: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by run, then fingerprint; a run may reach over batches."""
    held: list[pd.DataFrame] = []

    for batch in batches:
        if not len(batch):
            continue
        last = (batch["block"].iat[-1], batch["run"].iat[-1])
        tail = (batch["block"] == last[0]) & (batch["run"] == last[1])
        if tail.all() and held and (held[0]["block"].iat[0], held[0]["run"].iat[0]) == last:
            held.append(batch)
            continue
        if held or not tail.all():
            yield give(pd.concat([*held, batch[~tail]], ignore_index=True))
        held = [batch[tail]]
    if held:
        yield give(pd.concat(held, ignore_index=True))


def _turn(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def turned(fps: list[Column], k: int, bits: int = BITS) -> Column:
    """One entry for each block of each fingerprint, that block leading."""
    cells = [(fp, at, width) for fp in fps for at, width in blocks(k, bits)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(_turn(fp, at), BITS - width).alias("run"), _turn(fp, at).alias("turned")) for i, (fp, at, width) in enumerate(cells)]))


def parted(rows: DataFrame, k: int, run_limit: int, extra: list[str], bits: int = BITS) -> list[DataFrame]:
    """``rows`` (``block, run, turned, side, spent`` and ``extra``) in tables whose runs have at most ``run_limit`` rows."""
    depth, ready = max(w for _, w in blocks(k, bits)) + 1, []
    thin = not extra  # wider rows: runs of one row cost less in the join than a shuffle to leave them out
    while True:
        sizes = rows.groupBy("block", "run").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi")).filter("n > 1 AND (lo = 0 OR lo < hi)")
        big = materialize(sizes.filter(F.col("n") > run_limit).select("block", "run", F.lit(True).alias("big")))
        if depth >= BITS or not big.limit(1).count():
            ready.append(rows.join(sizes.select("block", "run"), ["block", "run"], "left_semi") if thin else rows)
            break
        marked = rows.join(big, ["block", "run"], "left")
        fine = marked.filter("big IS NULL").drop("big")
        ready.append(fine.join(sizes.select("block", "run"), ["block", "run"], "left_semi") if thin else fine)
        width = min(PART_BITS, BITS - depth)
        own = F.shiftrightunsigned(F.col("turned"), BITS - depth - width).bitwiseAND(F.lit((1 << width) - 1))
        flips = [x for x in range(1 << width) if bin(x).count("1") <= k]
        parts = F.array(*[F.struct(F.least(own, own.bitwiseXOR(F.lit(x))).alias("s"), F.greatest(own, own.bitwiseXOR(F.lit(x))).alias("t"), F.lit(bin(x).count("1")).alias("c"), F.when(F.lit(x == 0), 0).when(own < own.bitwiseXOR(F.lit(x)), 1).otherwise(2).alias("w")) for x in flips])
        parted = marked.filter("big").withColumn("p", F.explode(parts))
        # a run across two nodes goes on as two-sided: only pairs of different sides are walked in it
        parted = parted.filter(F.col("spent") + F.col("p.c") <= k).filter((F.col("side") == 0) | (F.col("p.w") == 0) | (F.col("p.w") == F.col("side")) | (F.col("p.w") == 3 - F.col("side")))
        side = F.when(F.col("side") == 0, F.col("p.w")).otherwise(F.col("side"))
        turn = F.when((F.col("side") == 0) | (F.col("p.w") == 0), F.lit(0)).otherwise(F.when(F.col("p.w") == F.col("side"), 1).otherwise(2))
        rows = materialize(parted.select("block", F.xxhash64("run", "p.s", "p.t", turn, F.lit(depth)).alias("run"), "turned", side.alias("side"), (F.col("spent") + F.col("p.c")).alias("spent"), *extra))
        depth, thin = depth + width, True
    return ready


def joined(ready: list[DataFrame], give: Callable[[pd.DataFrame], pd.DataFrame], extra: list[str], schema: str) -> DataFrame:
    out = None
    for part in ready:
        spread = part.select("block", "run", "turned", "side", *extra).repartition("block", "run").sortWithinPartitions("block", "run", F.col("turned") < 0, "turned")
        found = spread.mapInPandas(lambda it: _join_runs(it, give), schema)
        out = found if out is None else out.unionByName(found)
    return out


def links(prints: DataFrame, k: int = MAX_BITS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``a, b``: links between different fingerprints (column ``fp``, distinct) that connect all within k bits."""
    rows = prints.select(turned([F.col("fp")], k).alias("t")).select("t.*", F.lit(0).alias("side"), F.lit(0).alias("spent"))
    return joined(parted(materialize(rows), k, run_limit, []), lambda frame: _bit_links(frame, k), [], "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, k: int = MAX_BITS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``doc_id, text_md5, fp, component_id, keeper``: one row an input row; ``keeper`` marks the row that stays."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prints = materialize(rows.select("doc_id", F.md5("text").alias("text_md5"), fingerprint(F.col("text"), shingle).alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    near = materialize(components(links(nodes.select("fp"), k, run_limit)).withColumnRenamed("node", "fp"))
    named = nodes.join(near, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = materialize(named.join(least, "root").select("fp", "root", "component_id"))
    return prints.join(ids, "fp")


def fingerprints_and_components(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    out = near_duplicates(docs, **how)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, of equal ids the least text digest."""
    return _one_of_each(docs, near_duplicates(docs, **how))


def _one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("text_md5").alias("m"))).alias("s")).select(F.col("s.d").alias("_d"), F.col("s.m").alias("_m"))
    md5 = fresh("_md5", docs.columns)
    rows = docs.withColumn(md5, F.md5(F.coalesce("text", F.lit(""))))
    kept = rows.join(stay.distinct(), rows["doc_id"].eqNullSafe(stay["_d"]) & (rows[md5] == stay["_m"]), "left_semi")
    return kept.dropDuplicates(["doc_id", md5]).drop(md5)
