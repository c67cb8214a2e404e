"""Hard negatives by an inverted multi-index with certified stops.

Vectors are cut into two half-spaces, each with a codebook fitted on a bounded sample; a row's two codes name its cell.
By the radius of each code, a cell's rows score at most the sum of two half bounds ``<q, centre> + |q| * radius``.  For
an anchor, a heap walks the two sorted lists of half bounds together (multi-sequence) and gives the cells by falling
bound.  It stops where the bound falls below a score that is already certain: that of the fifth fitting row of the
sample, or the lower edge of the window.  So every row that can be in the answer lies in a visited cell, and the answer
is exact; radii that are large against the scores, as in vectors without any structure, only make it visit more.

Two passes: same-label positives first, then the windows that their scores open.  In each, anchors travel to the
blocks of their cells (at most ``BLOCK_ROWS`` rows; a large cell is several blocks), where a task holds one block and
streams the anchors past it.  What returns are at most five rows for each anchor, window and block.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; components
beyond +-65536 count as that; shorter vectors count as filled up with zeros; repeated rows are as many candidates, but
anchors that are alike count once; a row is no candidate of an anchor with its own id; empty input, empty output.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.session import materialize

#: Rows that the codebooks are fitted on, and that give the first certain scores.
SAMPLE = 4096
#: Rows a cell should have, and the most codes of a half: they decide on speed, not on results.
CELL_ROWS, MOST_CODES = 1000, 64
#: Rows that a task compares with an anchor at once.
BLOCK_ROWS = 4096
POSITIVES, NEGATIVES = 5, 5
#: Per cent of the positive's score that a negative has at least.
WINDOW = 80
SCALE, LARGEST = 256, 2.0**24
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10


def quantised(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, v``: rows that take part, their label as it is mined, components as whole numbers."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))  # NaN is above all
    rows = table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


def _matrix(lists: pa.ListArray, d: int) -> np.ndarray:
    """Rows of whole numbers, filled up to ``d``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() == sizes.max() == d:
        return values.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = values
    return out


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows; in doubles where no sum can leave their 53 bits."""
    most = max(1, int(np.abs(left).max(initial=0))) * max(1, int(np.abs(right).max(initial=0))) * max(1, left.shape[1])
    if most < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def codebook(points: np.ndarray, codes: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres of at most ``codes`` groups by Lloyd's rounds."""
    points = points.astype(np.float64)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:codes]]
    for _ in range(rounds):
        at = nearest(points, centres)[0]
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each point's nearest centre."""
    squares = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
    at = squares.argmin(1)
    return at, np.sqrt(((points - centres[at]) ** 2).sum(1))


def half_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that the half of a row of each code can score, rounding included."""
    norm = np.sqrt(float((q.astype(np.float64) ** 2).sum()))
    bound = centres @ q + norm * radii
    return bound + 1e-9 * (np.abs(bound) + norm * (np.sqrt((centres**2).sum(1)) + radii)) + 0.5


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, code, code) of all cells by falling sum of half bounds, each found as late as it is needed."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(a) and m < len(b) and (k, m) not in seen:
                seen.add((k, m))
                heapq.heappush(heap, (-(first[a[k]] + second[b[m]]), k, m))


def best(score: np.ndarray, ids: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of ``among``: by falling score, then rising id."""
    at = np.flatnonzero(among)
    if len(at) > most:
        at = at[score[at] >= np.partition(score[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((ids[at], -score[at]))[:most]]


def in_window(score: np.ndarray, positive: int) -> np.ndarray:
    return (WINDOW // 20 * positive <= 5 * score) & (score <= positive)


class Index:
    """Codebooks, radii and cell sizes: at most ``MOST_CODES`` ** 2 cells and ``SAMPLE`` rows, whatever the table."""

    def __init__(self, rows: DataFrame):
        n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).head()
        self.d, self.half = max(1, d or 1), max(1, d or 1) // 2
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(SAMPLE).toArrow()
        self.ids, self.labels, self.v = some["vec_id"].to_numpy(), some["label"].to_numpy(), _matrix(some["v"], self.d)
        codes = int(min(MOST_CODES, max(1, round((n / CELL_ROWS) ** 0.5))))
        self.centres = [codebook(part, codes) for part in self.parts(self.v)] if n else [np.zeros((1, self.half)), np.zeros((1, self.d - self.half))]
        self.rows = materialize(self._coded(rows))
        self.radii = [np.zeros(len(c)) for c in self.centres]
        self.blocks: dict[tuple[int, int], int] = {}
        for side, name in enumerate("ab"):
            for code, radius in self.rows.groupBy(name).agg(F.max(f"far_{name}")).collect():
                self.radii[side][code] = radius
        for a, b, count in self.rows.groupBy("a", "b").agg(F.count(F.lit(1))).collect():
            self.blocks[a, b] = -(-count // BLOCK_ROWS)

    def __getstate__(self) -> dict:
        return {k: x for k, x in vars(self).items() if k != "rows"}  # tasks get the bounded part only

    def parts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[..., : self.half], v[..., self.half :]

    def _coded(self, rows: DataFrame) -> DataFrame:
        d, half, centres = self.d, self.half, self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column("v"), d).astype(np.float64)
                found = [nearest(v[:, :half], centres[0]), nearest(v[:, half:], centres[1])]
                added = [pa.array(x) for at, far in found for x in (at.astype(np.int32), far)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "a", "far_a", "b", "far_b"])

        return rows.mapInArrow(run, "vec_id long, label long, v array<long>, a int, far_a double, b int, far_b double")

    def in_blocks(self) -> DataFrame:
        """The rows with the number of their block in the cell."""
        spark = self.rows.sparkSession
        sizes = spark.createDataFrame([(a, b, n) for (a, b), n in self.blocks.items()], "a int, b int, blocks int")
        rows = self.rows.join(F.broadcast(sizes), ["a", "b"])
        return rows.select("a", "b", F.pmod(F.xxhash64("vec_id", "label", "v"), F.col("blocks")).cast("int").alias("block"), "vec_id", "label", "v")

    def visits(self, q: np.ndarray, certain: float) -> Iterator[tuple[int, int, int]]:
        """(code, code, block) of what an anchor must see when ``certain`` is the least score that can matter."""
        halves = [half_bounds(x, c, r) for x, c, r in zip(self.parts(q), self.centres, self.radii)]
        for bound, a, b in multi_sequence(*halves):
            if bound < certain:
                return
            for block in range(self.blocks.get((a, b), 0)):
                yield a, b, block


#: Whether rows of the block fit: (scores, label differs, id differs, the positive's score or none).
def _fits(score: np.ndarray, other_label: np.ndarray, other_id: np.ndarray, positive: int | None) -> np.ndarray:
    return other_id & (~other_label if positive is None else other_label & in_window(score, positive))


def _certain(index: Index, q: np.ndarray, anchor: int, label: int, wanted: list, most: int) -> float:
    """The least score that can still be in an answer, from what the sample holds; infinite if none can."""
    score, out = scores(q[None], index.v)[0], np.inf
    for positive in wanted:
        if positive is not None and positive < 0:
            continue  # four fifths of a negative score lie above it
        found = best(score, index.ids, _fits(score, index.labels != label, index.ids != anchor, positive), most)
        edge = -np.inf if positive is None else positive * WINDOW / 100
        out = min(out, float(score[found[-1]]) if len(found) == most else edge)
    return out


def _routed(anchors: DataFrame, index: Index, most: int) -> DataFrame:
    """``anchors`` (``vec_id, label, v, wanted``) once for each block they must see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, wanted = _matrix(batch.column("v"), index.d), batch.column("wanted").to_pylist()
            ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
            for i in range(batch.num_rows):
                seen = list(index.visits(v[i], _certain(index, v[i], ids[i], labels[i], wanted[i] or [None], most)))
                cells = [pa.array([s[k] for s in seen], pa.int32()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*cells, *[c.take(pa.array([i] * len(seen), pa.int64())) for c in batch.columns]], names=["a", "b", "block", *batch.schema.names])

    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "block")] + anchors.schema.fields)
    return anchors.mapInArrow(run, schema)


def _searched(anchors: DataFrame, index: Index, most: int) -> DataFrame:
    """``anchor, alike, turn, found, score``: of each block seen, the first ``most`` rows for each wanted window.

    ``wanted`` has the positives' scores, or is null for the positives themselves; ``alike`` tells anchors of one id apart.
    """
    keys = ["a", "b", "block"]
    data = index.in_blocks().withColumn("wanted", F.lit(None).cast("array<long>")).withColumn("alike", F.lit(0).cast("long")).withColumn("kind", F.lit(0))
    asking = _routed(anchors, index, most).withColumn("kind", F.lit(1))
    both = data.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "kind")
    d = index.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (*keys, "kind")], 1)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(key)]):
                piece = batch.slice(lo, hi - lo)
                if tuple(key[lo][:3]) != at:
                    at, held, block = tuple(key[lo][:3]), [], None
                v = _matrix(piece.column("v"), d)
                ids, labels = (piece.column(c).to_numpy() for c in ("vec_id", "label"))
                if key[lo][3] == 0:
                    held.append((ids, labels, v))
                    continue
                if not held:
                    continue
                if block is None:
                    block = tuple(np.concatenate(x) for x in zip(*held))
                yield from answers(piece, ids, labels, v, block)

    def answers(piece: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, block: tuple) -> Iterator[pa.RecordBatch]:
        wanted, alike = piece.column("wanted").to_pylist(), piece.column("alike").to_numpy()
        for lo in range(0, len(ids), 64):
            out: list[tuple] = []
            for i, score in enumerate(scores(v[lo : lo + 64], block[2]), lo):
                other_label, other_id = block[1] != labels[i], block[0] != ids[i]
                for turn, positive in enumerate(wanted[i] or [None]):
                    for place in best(score, block[0], _fits(score, other_label, other_id, positive), most):
                        out.append((ids[i], alike[i], turn, block[0][place], score[place]))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])], names=["anchor", "alike", "turn", "found", "score"])

    return both.mapInArrow(run, "anchor long, alike long, turn int, found long, score long")


def _first(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "alike", "turn").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(table: DataFrame, vector: str = "embedding", is_anchor: Callable[[Column], Column] = lambda key: key % ANCHOR_EVERY == 0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    index = Index(materialize(quantised(table, vector)))
    anchors = materialize(index.rows.filter(is_anchor(F.col("vec_id"))).select("vec_id", "label", "v").distinct().withColumn("alike", F.xxhash64("vec_id", "label", "v")))
    asked = anchors.withColumn("wanted", F.lit(None).cast("array<long>"))
    positives = materialize(_first(_searched(asked, index, POSITIVES), POSITIVES).drop("turn"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "score", "found")))  # five at most
    windows = positives.groupBy("anchor", "alike").agg(ordered.alias("p")).select(F.col("anchor").alias("vec_id"), "alike", F.transform("p", lambda x: x["score"]).alias("wanted"))
    negatives = _first(_searched(anchors.join(windows, ["vec_id", "alike"]), index, NEGATIVES), NEGATIVES)
    by_turn = positives.select("anchor", "alike", (F.col("rank") - 1).alias("turn"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(by_turn, ["anchor", "alike", "turn"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB twin: every anchor against every row.
HARD_NEGATIVES_SQL = f"""
WITH rows AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS BIGINT) AS label,
 list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT q.id AS anchor_id, x.id, q.label = x.label AS same, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score FROM rows q, rows x WHERE q.id % {ANCHOR_EVERY} = 0 AND q.id <> x.id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND {WINDOW} * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= {NEGATIVES}
"""
