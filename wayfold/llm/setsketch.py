"""Near duplicates by SetSketch registers, banded, judged by likelihood and verified on full sets.

A register is the least of exponentially distributed hashes of a set's shingles, on an exponential scale and truncated:
``max over elements of floor(1 - log_b(h))`` within ``0 .. Q + 1``.  Registers of a union are the larger ones of its
parts (mergeable), and two sets agree in a register about as often as their similarity (locality-sensitive).

1. Rows with equal sets are one node, however many.
2. ``BANDS`` bands of ``ROWS`` registers: nodes with an equal band are in one list.  Sets of similarity 0.8 miss each
   other in all bands with probability 3e-6.
3. Star rounds: each list links its members to the one that meets the most others in all lists, then those still apart
   to the next such one.  Copies of one original are joined to it so, without a pair of every two of them.
4. Then lists that still hold different components have all their pairs across components asked: small lists by a join,
   larger ones in tiles of ``TILE`` nodes, so that no list is in one task and no pair of a large list is a row.
5. A pair is judged by the joint likelihood of its registers and set sizes, and is dropped only where similarity 0.8 is
   less likely than the best one by a factor of ``exp(SLACK)``; what remains is counted on the full sets, in large lists
   within the tile.

Only components are wanted, so pairs within one component are not asked again; every other pair of step 2 is.

Defined results: null and wordless texts have no shingles, and stand alone; a null doc_id is a component id only where
its component has no other; repeated rows share a component; empty input, empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.graph import Rooted
from wayfold.llm.shingles import STEP, alike, mixed, set_digest, shingle_set, shingled, text_key
from wayfold.session import materialize

SHINGLE = 2
#: Shared shingles in per cent of the union from which texts are linked.
PERCENT = 80
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Base of the scale, rate of the exponential hashes, greatest register less one (16 bits).
BASE, RATE, Q = 1.001, 20.0, 2**16 - 2
#: Log-likelihood that similarity ``PERCENT`` may lose against the best: 4.2 standard deviations, one pair of 100,000.
SLACK = 9.0
#: Star rounds before all remaining pairs are asked: they decide on speed, not on results.
STARS = 3
#: Nodes of a list whose pairs one task looks at, and their shingles; lists up to ``SHORT`` are joined.
TILE, ELEMENTS, SHORT = 1024, 1 << 20, 8

_SALTS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * STEP)
_ODD = _SALTS | np.uint64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers (uint16) of a set of uint64 hashes; all zero for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    cells = np.empty((256, REGISTERS), np.uint64)
    for lo in range(0, len(hashes), 256):
        some = hashes[lo : lo + 256, None]
        part = cells[: len(some)]
        np.bitwise_xor(some, _SALTS, out=part)
        np.multiply(part, _ODD, out=part)
        np.minimum(least, part.min(0), out=least)
    wait = -np.log1p(-(least >> np.uint64(11)).astype(np.float64) * 2.0**-53) / RATE  # the least exponential hash belongs to the least uniform one
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(wait) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def log_likelihood(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of sets of ``n`` and ``m`` elements of which ``more`` registers are greater in the first and ``less`` in the second."""
    u, v = n / (n + m), m / (n + m)

    def apart(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    first, second = apart(u - v * similarity), apart(v - u * similarity)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(k > 0, k * np.log(p), 0.0) for k, p in ((more, first), (less, second), (REGISTERS - more - less, 1 - first - second))]
    return sum(parts)


def likely(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs (rows of registers, with set sizes) can have the similarity: bounded likelihood ratio."""
    more, less = ((x > y).sum(1).astype(float)[:, None] for x, y in ((left, right), (right, left)))
    n, m = n.astype(float)[:, None], m.astype(float)[:, None]
    most = np.minimum(n, m) / np.maximum(n, m)  # no larger similarity is possible
    grid = np.linspace(0, 1, 65) * most
    high = percent / 100 + np.linspace(0, 1, 17) * np.maximum(most - percent / 100, 0)
    best = log_likelihood(more, less, n, m, grid).max(1)
    return (most[:, 0] * 100 >= percent - 1e-9) & (log_likelihood(more, less, n, m, np.minimum(high, most)).max(1) >= best - SLACK)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, n, node, regs``: a set's size, digest and registers, from one scan of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, regs = [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), width)
                sizes.append(len(hashes))
                nodes.append(set_digest(hashes) if len(hashes) else None)
                regs.append(registers(hashes).tobytes() if len(hashes) else None)
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.string()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n", "node", "regs"])

    more = [T.StructField("text_key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("node", T.StringType()), T.StructField("regs", T.BinaryType())]
    rows = docs.select("doc_id", text_key(F.col("text"), F.col("doc_id")).alias("text_key"), "text")
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], *more]))


def _rows_of(column: pa.Array) -> np.ndarray:
    """Registers of a binary column, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def banded(nodes: DataFrame) -> DataFrame:
    """``key, band, id``: one row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _rows_of(batch.column("regs")).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * STEP, cells.shape[:2])
            for i in range(ROWS):
                key = mixed(key * STEP + cells[:, :, i])
            ids = np.repeat(batch.column("id").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), pa.array(ids)], names=["key", "band", "id"])

    return nodes.select("id", "regs").mapInArrow(run, "key long, band int, id long")


def _judged(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose registers allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "n_"))
            good = likely(_rows_of(batch.column("regs")), _rows_of(batch.column("regs_")), n, m, percent) if len(n) else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    cells = nodes.select("id", "n", "regs")
    close = F.least("n", "n_") * 100 >= F.greatest("n", "n_") * percent
    both = pairs.join(cells.withColumnRenamed("id", "a"), "a").join(cells.select(F.col("id").alias("b"), F.col("n").alias("n_"), F.col("regs").alias("regs_")), "b").filter(close)
    return both.mapInArrow(run, "a long, b long")


def _across(held: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: links that join the different components that share a list (``key, id, many, root``)."""
    few, other = held.filter(F.col("many") <= SHORT), held.select("key", F.col("id").alias("id_"), F.col("root").alias("root_"))
    short = few.join(other, "key").filter("id < id_ AND root <> root_").select(F.col("id").alias("a"), F.col("id_").alias("b")).distinct()
    near = alike(_judged(short, nodes, percent), nodes, docs, width, percent)
    return near.unionByName(_linked(materialize(_met(held.filter(F.col("many") > SHORT), nodes, percent)), nodes, docs, width, percent))


def _met(held: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``key, s, t, id, root, own, asks``: members of each tile of the long lists with a likely pair there.

    Every such pair has a member that ``asks``: all do but those of the tile's largest component.  A pair counts in the
    first band in which it agrees only.
    """
    sized = held.join(nodes.select("id", "n", "regs"), "id")
    weight = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / ELEMENTS)).cast("int").alias("tiles"))
    long = sized.join(weight, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = [F.col("key"), F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t")]
    spread = long.select(*keys, "id", "root", "own", "band", "n", "regs").repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches):
            own, root, n = (rows[c].to_numpy() for c in ("own", "root", "n"))
            regs, within, band = _rows_of(rows["regs"]), rows["s"][0] == rows["t"][0], rows["band"][0].as_py()
            bands, outside = regs.reshape(-1, BANDS, ROWS), np.flatnonzero(root != _largest(root))
            asks, met = np.zeros(len(own), bool), np.zeros(len(own), bool)
            for i in outside:
                at = np.flatnonzero((root != root[i]) & (within | (own != own[i])) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent))
                at = at[(bands[at] == bands[i]).all(2).argmax(1) == band]
                at = at[likely(np.broadcast_to(regs[i], (len(at), REGISTERS)), regs[at], np.broadcast_to(n[i], len(at)), n[at], percent)] if len(at) else at
                asks[i], met[at] = len(at) > 0, True
            some = rows.select(["key", "s", "t", "id", "root", "own"]).append_column("asks", pa.array(asks)).filter(pa.array(asks | met))
            yield from some.combine_chunks().to_batches()

    return spread.mapInArrow(run, "key long, s int, t int, id long, root long, own int, asks boolean")


def _linked(members: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: a spanning forest of the links between components in each tile, counted on the full sets there.

    Who asks is counted against all others of its tile at once, so that a pair is never a row.
    """
    sets = members.join(shingled(members.select("id").distinct(), nodes, docs, width).withColumnRenamed("s", "s_"), "id")
    spread = sets.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tiles(batches):
            ids, root, own = (rows[c].to_numpy() for c in ("id", "root", "own"))
            within, lists = rows["s"][0] == rows["t"][0], rows["s_"].combine_chunks()
            ends, n = np.cumsum(lists.value_lengths().to_numpy()), lists.value_lengths().to_numpy().astype(np.int64)
            _, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            holders = np.repeat(np.arange(len(ids)), n)[np.argsort(codes, kind="stable")]
            many = np.bincount(codes)
            first = np.cumsum(many) - many
            known: dict[int, int] = {}
            out = []
            for i in np.flatnonzero(rows["asks"].to_numpy()):
                mine = codes[ends[i] - n[i] : ends[i]]
                before = np.cumsum(many[mine]) - many[mine]
                who = holders[np.repeat(first[mine] - before, many[mine]) + np.arange(many[mine].sum())]
                same = np.bincount(who, minlength=len(ids))
                for j in np.flatnonzero((100 * same >= percent * (n + n[i] - same)) & (root != root[i]) & (within | (own != own[i]))):
                    x, y = _found(known, int(root[i])), _found(known, int(root[j]))
                    if x != y:
                        known[max(x, y)] = min(x, y)
                        out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return materialize(spread.mapInArrow(run, "a long, b long"))


def _largest(root: np.ndarray) -> int:
    values, many = np.unique(root, return_counts=True)
    return values[many.argmax()]


def _found(known: dict[int, int], x: int) -> int:
    while x in known:
        x = known[x]
    return x


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile (``key, s, t``), of rows in that order."""
    now, held_back = None, []
    for batch in batches:
        tile = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "s", "t")], 1)
        cuts = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(1)]) if len(tile) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(tile)]):
            if tuple(tile[lo]) != now:
                if held_back:
                    yield pa.Table.from_batches(held_back).combine_chunks()
                now, held_back = tuple(tile[lo]), []
            held_back.append(batch.slice(lo, hi - lo))
    if held_back:
        yield pa.Table.from_batches(held_back).combine_chunks()


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row an input row."""
    rows = materialize(_sketched(docs, width))
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("text_key", "n", "regs")).alias("x"), F.min("doc_id").alias("least"))
    nodes = materialize(nodes.select("node", "x.*", "least").withColumn("id", F.monotonically_increasing_id()))
    lists = banded(nodes).groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    held = materialize(banded(nodes).join(lists, "key"))
    # who meets the most others is the likely original of a group of copies
    met = materialize(held.groupBy("id").agg(F.sum("many").alias("met")))
    ranked = materialize(held.join(met, "id").select("key", "id", F.struct("met", "id").alias("place")))
    now, roots = ranked.withColumn("root", F.col("id")), Rooted()
    for _ in range(STARS):
        hubs = now.groupBy("key").agg(F.max(F.struct("place", "root")).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        star = now.join(hubs.select("key", F.col("hub.place.id").alias("hub"), F.col("hub.root").alias("hub_root")), "key").filter("root <> hub_root")
        pairs = star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        roots.add(alike(_judged(pairs, nodes, percent), nodes, docs, width, percent))
        # next time another one is asked by those that are still apart from it
        apart = star.select("key", "id", "place")
        now = materialize(roots.name(apart))
    now = materialize(roots.name(held.select("key", "band", "id", "many")))
    open_lists = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    roots.add(_across(now.join(open_lists, "key", "left_semi"), nodes, docs, width, percent))
    named = roots.name(nodes.select("id", "node", "least"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = materialize(named.join(least, "root").select("node", "component_id"))
    return _attached(rows, ids)


def _attached(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with their node's component; nodes that hold more than a thousandth of all rows are joined as a broadcast."""
    n = rows.count()
    sizes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("many"))
    hot = materialize(sizes.filter(F.col("many") * 1000 > n).join(ids, "node").select("node", F.col("component_id").alias("hot_id")))  # 999 at most
    marked = rows.select("doc_id", "n", "node").join(F.broadcast(hot), "node", "left")
    plain = marked.filter("hot_id IS NULL").join(ids, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    both = plain.select("doc_id", "n", "component_id").unionByName(marked.filter("hot_id IS NOT NULL").select("doc_id", "n", F.col("hot_id").alias("component_id")))
    return both.select("doc_id", F.col("n").alias("n_shingles"), "component_id", _kept(F.col("doc_id"), F.col("component_id")).alias("kept"))


def _kept(doc_id: Column, component: Column) -> Column:
    return F.coalesce(doc_id == component, doc_id.isNull() & component.isNull())


#: DuckDB twin: every pair that shares a shingle is counted, and labels spread along the links until they stand.
NEAR_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words),
texts AS MATERIALIZED (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
coded AS MATERIALIZED (SELECT node, n, unnest(s) AS x FROM texts),
links AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM coded a JOIN coded b ON a.x = b.x AND a.node < b.node AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {PERCENT}
 GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT node, node FROM texts UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN texts t ON d.s = t.s LEFT JOIN roots r ON r.node = t.node
"""
