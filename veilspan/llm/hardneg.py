"""Hard negatives for anchors among vectors, by segment summaries that bound inner products.

Components are scaled and floored to integers, so scores are exact integers.  A vector is cut into segments;
of each segment its mean and its deviation (the length of what is left when the mean is taken away) are
stored.  The inner product of two segments of n components lies within ``n * mean * mean`` plus or minus
``deviation * deviation``.  Levels of more and shorter segments refine the bounds; a row is scored exactly
only if no level excludes it, so no row that belongs to the answer is lost.

Anchors meet all rows in cells of one block of rows and one block of anchors, both of bounded size, so no
label, vector or anchor makes a large task.  A cell keeps the best rows of each anchor; the best of all cells
follow by row limits.  The first pass finds the positives, the second the negatives within the
window that each positive's score sets.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; of
rows with the same id the one with the least label and then the least vector counts; a shorter vector
is filled up with zeros; an anchor without positives, and a positive without negatives, give no rows; an empty
table gives none; other columns are not read.  Scores beyond a long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from veilspan.llm.common import stored

LEVELS = (4, 16)
BLOCK_ROWS = 8192
BLOCK_ANCHORS = 1024
BLOCK_BYTES = 32 << 20
SLAB = 32
POSITIVES, NEGATIVES = 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
_EXACT_FLOATS = float(1 << 52)


def summaries(q: np.ndarray, levels: tuple[int, ...]) -> list[np.ndarray]:
    """Per level, per row: the segments' means times the root of their size, then their deviations.

    So the product of two means' parts is the middle of the bound, that of two deviations' parts its reach.
    """
    out = []
    for segments in levels:
        size = -(-q.shape[1] // segments)
        padded = np.pad(q, ((0, 0), (0, size * segments - q.shape[1]))).reshape(len(q), segments, size)
        mean = padded.mean(2)
        out.append(np.hstack([mean * np.sqrt(size), np.sqrt(((padded - mean[..., None]) ** 2).sum(2))]))
    return out


def bounds(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and reach of the bounds of all anchors' scores with all ``rows``, by one level's summaries."""
    half = anchors.shape[1] // 2
    return anchors[:, :half] @ rows[:, :half].T, anchors[:, half:] @ rows[:, half:].T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        high = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return high[np.lexsort((ids[high], -scores[high]))[:k]]
    return np.lexsort((ids, -scores))


class Block:
    """Rows of a cell: ids, labels, integer components, and their summaries by level."""

    def __init__(self, table: pa.Table, levels: tuple[int, ...], width: int):
        table = table.rename_columns([c.removeprefix("own_") for c in table.column_names])
        self.ids = table.column("id").to_numpy()
        self.labels = table.column("label").to_numpy(zero_copy_only=False)
        self.q = np.zeros((len(self.ids), width))
        self.summary = [np.zeros((len(self.ids), 2 * s)) for s in levels]
        for k, (vector, summary) in enumerate(zip(table.column("q").to_pylist(), table.column("summary").to_pylist())):
            self.q[k] = np.frombuffer(vector)
            at, flat = 0, np.frombuffer(summary)
            for level in self.summary:
                level[k] = flat[at:at + level.shape[1]]
                at += level.shape[1]
        self.norm = np.sqrt((self.q ** 2).sum(1))

    def scores(self, anchors: np.ndarray, places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact inner products of anchors with the rows at ``places``, right at least for the pairs that are ``wanted``."""
        rows = self.q[places]
        reach = np.abs(anchors).max(initial=0) * np.abs(rows).max(1, initial=0) * rows.shape[1]
        small = reach < _EXACT_FLOATS
        out = np.zeros(wanted.shape, np.int64)
        out[:, small] = anchors @ rows[small].T
        for i, k in zip(*np.nonzero(wanted & ~small)):  # whole numbers of any size, where floats round
            out[i, k] = sum(int(x) * int(y) for x, y in zip(anchors[i], rows[k]))
        return out


Range = tuple[float, float]


def _may_win(lower: np.ndarray, upper: np.ndarray, windows: list[Range], k: int) -> np.ndarray:
    """Which rows may be among the k best of any window, by the bounds of their scores."""
    out = np.zeros(len(lower), bool)
    for low, high in windows:
        may, sure = (upper >= low) & (lower <= high), (lower >= low) & (upper <= high)
        if np.count_nonzero(sure) >= k:
            may &= upper >= np.partition(lower[sure], -k)[-k]
        out |= may
    return out


def surviving(anchors: Block, slab: slice, rows: Block, allowed: np.ndarray, windows: list[list[Range]], k: int) -> np.ndarray:
    """``allowed`` (anchors of the slab by rows) without the pairs that a level excludes, coarse levels first.

    A level looks only at the rows that the levels before it left to some anchor of the slab.
    """
    columns = np.flatnonzero(allowed.any(0))
    for ours, theirs in zip(anchors.summary, rows.summary):
        if not len(columns):
            break
        middle, reach = bounds(ours[slab], theirs if len(columns) == len(theirs) else theirs[columns])
        # Rounding of the bounds is far below one half, or below this share of the product of the lengths.
        slack = 0.5 + 1e-12 * anchors.norm[slab] * rows.norm[columns].max()
        lower, upper = middle - reach, middle + reach
        for i in range(len(allowed)):
            at = np.flatnonzero(allowed[i, columns])
            may = _may_win(lower[i, at] - slack[i], upper[i, at] + slack[i], windows[i], k)
            allowed[i, columns[at[~may]]] = False
        columns = columns[allowed[:, columns].any(0)]
    return allowed


def _scored(anchors: Block, rows: Block, same: bool, windows: list[list[Range]], k: int):
    """For each anchor, its number, and the places and exact scores of the rows that no level excludes."""
    for start in range(0, len(anchors.ids), SLAB):
        slab = slice(start, start + SLAB)
        allowed = (anchors.labels[slab, None] == rows.labels) == same
        allowed &= anchors.ids[slab, None] != rows.ids
        allowed[[not w for w in windows[slab]]] = False
        allowed = surviving(anchors, slab, rows, allowed, windows[slab], k)
        columns = np.flatnonzero(allowed.any(0))
        scores = rows.scores(anchors.q[slab], columns, allowed[:, columns])
        for i in range(len(allowed)):
            at = np.flatnonzero(allowed[i, columns])
            yield start + i, columns[at], scores[i, at]


def positives_of_cell(anchors: Block, rows: Block, k: int) -> list[tuple[int, int, int]]:
    """(anchor, row, score): the k best other rows with the anchor's label."""
    out = []
    for a, places, scores in _scored(anchors, rows, True, [[(-np.inf, np.inf)]] * len(anchors.ids), k):
        ids = rows.ids[places]
        out += [(int(anchors.ids[a]), int(ids[i]), int(scores[i])) for i in _best(ids, scores, k)]
    return out


def negatives_of_cell(anchors: Block, positives: list, rows: Block, k: int, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
    """(anchor, positive, positive score, row, score): the k best rows of other labels in each positive's window."""
    # 100 * s within low * score .. high * score
    wanted = [{score: (-(-low * score // 100), high * score // 100) for _, score in mine} for mine in positives]
    out = []
    for a, places, scores in _scored(anchors, rows, False, [list(w.values()) for w in wanted], k):
        ids, known = rows.ids[places], {}
        for score, (least, most) in wanted[a].items():
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            best = inside[_best(ids[inside], scores[inside], k)]
            known[score] = list(zip(ids[best].tolist(), scores[best].tolist()))
        out += [(int(anchors.ids[a]), p, score, n, s) for p, score in positives[a] for n, s in known[score]]
    return out


def index(vectors: DataFrame, scale: float = 256.0, levels: tuple[int, ...] = LEVELS, id_col: str = "vec_id",
          vector: str = "embedding", label: str = "label") -> DataFrame:
    """A stored table (id, label, q, summary): integer components and the summaries of each usable row.

    Vectors are filled up to the longest one; that length is the only number of this step that reaches the driver.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("v")).dropna(subset=["id", "label", "v"])
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    rows = stored(rows, "vectors")
    width = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)

    @arrow_udf("struct<q: binary, summary: binary>")
    def packed(column: pa.Array) -> pa.Array:
        q = np.zeros((len(column), width))
        for k, values in enumerate(column.to_pylist()):
            q[k, :len(values)] = np.floor(scale * np.array(values, np.float64))
        flat = np.hstack(summaries(q, levels)) if len(q) else q
        return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in q], pa.binary()),
                                           pa.array([x.tobytes() for x in flat], pa.binary())], names=["q", "summary"])

    return stored(rows.select("id", "label", packed("v").alias("p")).select("id", "label", "p.*"), "index")


def _cells(rows: DataFrame, anchors: DataFrame, block_rows: int, block_anchors: int):
    """Rows and anchors grouped by cell; every block meets every other, each copied once per counterpart."""
    n_rows = max(-(-rows.count() // block_rows), 1)
    n_anchors = max(-(-anchors.count() // block_anchors), 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int")).withColumn("a", spread(n_anchors))
    anchors = anchors.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(n_anchors)).cast("int")).withColumn("r", spread(n_rows))
    anchors = anchors.select([F.col(c).alias(f"own_{c}") for c in anchors.columns])  # both sides come from one table
    return anchors.groupBy("own_r", "own_a").cogroup(rows.groupBy("r", "a"))


def _limited(found: DataFrame, by: list[str], k: int, score: str, tie: str, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT, scale: float = 256.0,
         levels: tuple[int, ...] = LEVELS, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
         id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``.  The negatives of a positive score from ``low_percent`` to
    ``high_percent`` of its score.
    """
    rows = index(vectors, scale, levels, id_col, vector, label)
    first = rows.limit(1).select((F.octet_length("q") / 8).cast("int")).collect()
    width = first[0][0] if first else 1

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found = positives_of_cell(Block(left, levels, width), Block(right, levels, width), positives)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))],
                                    names=["anchor_id", "positive_id", "positive_score"])

    def far(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = [[(p["positive_id"], p["positive_score"]) for p in ps] for ps in left.column("own_positives").to_pylist()]
        found = negatives_of_cell(Block(left, levels, width), wanted, Block(right, levels, width), negatives, low_percent, high_percent)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], [], [], []))],
                                    names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    most = max(BLOCK_BYTES // (8 * (width + 2 * sum(levels))), 1)  # rows of a block, whatever the vectors' length
    block_rows, block_anchors = min(block_rows, most), min(block_anchors, most)
    anchors = rows.where(is_anchor)
    found = _cells(rows, anchors, block_rows, block_anchors).applyInArrow(
        near, "anchor_id long, positive_id long, positive_score long")
    found = _limited(found, ["anchor_id"], positives, "positive_score", "positive_id", "place")
    # At most ``positives`` entries per anchor.
    wanted = stored(found.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "positives")
    mined = _cells(rows, anchors.join(wanted.hint("merge"), "id"), block_rows, block_anchors).applyInArrow(
        far, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    mined = _limited(mined, ["anchor_id", "positive_id"], negatives, "negative_score", "negative_id", "rank")
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                        "positive_score", "negative_score")
