"""Hard negatives by exact integer scores from subset-sum tables (Four Russians).

Components become integers, and a row keeps them as bit planes: one byte holds a bit of
GROUP = 8 components, in two's complement. An anchor has a table for each group of its
own components, with the sum of every subset of them: 256 entries. A byte of a candidate
is the subset that the plane sets, so the sum of the entries that a plane's bytes look
up is the plane's part of the inner product, and shifting and adding the planes gives
the full exact score. Tables of many anchors lie side by side, so that a lookup of one
byte gives a row of all anchors.

Anchors meet candidates in cells, blocks of both, dealt over tasks: first within labels
for the positives, then over all rows for the negatives. A cell keeps the few best rows
of each anchor, and the cells' few are ranked by anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable, joined_back

GROUP = 8
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
#: Rows of a block of candidates, at most and (where there are tasks to fill) at least, and anchors of a block.
BLOCK_ROWS, LEAST_ROWS, BLOCK_ANCHORS = 1 << 17, 1 << 11, 1 << 12
#: Candidates and anchors whose scores are in memory at once.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2048, 128
#: Components beyond this are refused, so that scores of up to a thousand of them fit in a long.
LARGEST = 1 << 26


def packed(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes of integer components in two's complement, the sign's plane first."""
    rows, width = values.shape
    groups = max(1, -(-width // GROUP))
    padded = np.zeros((rows, groups * GROUP), np.int64)
    padded[:, :width] = values
    bits = (padded[:, None, :] >> np.arange(planes - 1, -1, -1)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8).reshape(rows, planes, groups, GROUP), axis=3, bitorder="little").reshape(rows, planes, groups)


def unpacked(planes: np.ndarray) -> np.ndarray:
    """The components (rows, groups * GROUP) of packed planes."""
    rows, n, groups = planes.shape
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    place = np.int64(1) << np.arange(n - 1, -1, -1, dtype=np.int64)
    place[0] = -place[0]
    return np.einsum("rpk,p->rk", bits, place).reshape(rows, groups * GROUP)


class Tables:
    """Subset sums of the components of a few anchors, by group: (groups, 256, anchors)."""

    def __init__(self, anchors: np.ndarray, planes: int):
        n, width = anchors.shape
        groups = anchors.reshape(n, width // GROUP, GROUP).transpose(1, 2, 0)
        # Sums stay below the largest anchor's absolute sum, and scores below that times 2 ** planes.
        bound = (int(np.abs(anchors).sum(1).max()) if n else 0) << planes
        self.sums = np.zeros((len(groups), 256, n), np.int32 if bound < 2**31 else np.int64)
        for k in range(GROUP):
            half = 1 << k
            self.sums[:, half : 2 * half] = self.sums[:, :half] + groups[:, k : k + 1]

    def scores(self, planes: np.ndarray) -> np.ndarray:
        """(rows, anchors) inner products with rows of packed planes."""
        rows, n, groups = planes.shape
        total = np.zeros((rows, self.sums.shape[2]), self.sums.dtype)
        for p in range(n):
            if p:
                np.left_shift(total, 1, out=total)
            for g in range(groups):
                found = self.sums[g].take(planes[:, p, g], axis=0)
                # The first plane is the sign's, whose place counts negatively.
                (np.subtract if p == 0 else np.add)(total, found, out=total)
        return total


@dataclass
class Rows:
    """A block of rows: row_id, vec_id (null last in ties), label, planes."""

    row: np.ndarray
    vec: np.ndarray
    vec_null: np.ndarray
    label: np.ndarray
    planes: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, planes: int) -> Rows:
        table = table.combine_chunks()
        whole = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(table.column("planes").to_pylist()), np.uint8)
        null = np.asarray(table.column("vec_id").is_null())
        vec = np.where(null, 0, table.column("vec_id").fill_null(0).to_numpy())
        return cls(whole("row_id"), vec, null, whole("label"), raw.reshape(table.num_rows, planes, len(raw) // max(1, table.num_rows * planes)))

    def sorted(self) -> Rows:
        """By vec_id, nulls last, then row_id: rows of one score come in this order."""
        order = np.lexsort((self.row, self.vec, self.vec_null))
        return Rows(*(getattr(self, f)[order] for f in ("row", "vec", "vec_null", "label", "planes")))


def _first(group: np.ndarray, score: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first `most` entries of each group, by descending score, then place."""
    order = np.lexsort((place, -score, group))
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return order[rank < most]


def _best(anchors: Rows, rows: Rows, keep: Callable[[np.ndarray, slice, slice], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, position in rows, score) of the first `most` of each group.

    keep: given scores of some rows with some anchors, the entries that count: (group, position among the rows, score).
    """
    n = rows.planes.shape[1]
    out = []
    for a in range(0, len(anchors.row), ANCHORS_AT_ONCE):
        some = slice(a, a + ANCHORS_AT_ONCE)
        tables = Tables(unpacked(anchors.planes[some]), n)
        held = [np.zeros(0, np.int64)] * 3
        for r in range(0, len(rows.row), ROWS_AT_ONCE):
            part = slice(r, r + ROWS_AT_ONCE)
            group, place, score = keep(tables.scores(rows.planes[part]), some, part)
            group, place, score = (np.concatenate([x, y.astype(np.int64)]) for x, y in zip(held, (group, place + r, score), strict=True))
            first = _first(group, score, place, most)
            held = [group[first], place[first], score[first]]
        out.append(held)
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _arrow(columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, kind) for k, (v, kind) in columns.items()})


def _vec(rows: Rows, at: np.ndarray) -> pa.Array:
    return pa.array(rows.vec[at], pa.int64(), mask=rows.vec_null[at])


def _cell_positives(planes: int):
    """Task for a cell within a label: the first POSITIVES other rows of each anchor."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, anchors = Rows.of(left, planes).sorted(), Rows.of(right, planes)

        def keep(scores, some, part):
            least = np.iinfo(scores.dtype).min
            scores = np.where(rows.row[part][:, None] == anchors.row[some][None, :], least, scores)
            edge = np.partition(scores, -POSITIVES - 1, axis=0)[-POSITIVES - 1] if len(scores) > POSITIVES else np.full(scores.shape[1], least)
            place, anchor = np.nonzero((scores >= edge) & (scores > least))
            return anchor + some.start, place, scores[place, anchor]

        group, place, score = _best(anchors, rows, keep, POSITIVES)
        out = {"anchor_row": (anchors.row[group], pa.int64()), "score": (score, pa.int64()), "positive_row": (rows.row[place], pa.int64())}
        return _arrow(out).append_column("positive_id", _vec(rows, place))

    return cell


def _cell_negatives(planes: int):
    """Task for a cell over all labels: the first NEGATIVES rows for each anchor and positive score."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, anchors = Rows.of(left, planes).sorted(), Rows.of(right, planes)
        wanted = right.combine_chunks().column("positives").to_pylist()
        slots = np.full((len(wanted), POSITIVES), np.iinfo(np.int64).min)
        for k, scores in enumerate(wanted):
            slots[k, : len(scores)] = sorted(set(scores), reverse=True)
        # 50 p <= 100 n <= 95 p as bounds of the integer n; nothing lies between those of a negative p.
        used = slots >= 0
        low = np.where(used, -(-(LOWEST * np.where(used, slots, 0)) // 100), 1)
        high = np.where(used, (HIGHEST * np.where(used, slots, 0)) // 100, 0)
        least, most = np.where(used, low, np.iinfo(np.int64).max).min(1), np.where(used, high, -1).max(1)

        def keep(scores, some, part):
            far = (scores >= least[some]) & (scores <= most[some]) & (rows.label[part][:, None] != anchors.label[some][None, :])
            place, anchor = np.nonzero(far)
            score = scores[place, anchor].astype(np.int64)
            anchor = anchor + some.start
            found = []
            for s in range(POSITIVES):
                own = np.flatnonzero((score >= low[anchor, s]) & (score <= high[anchor, s]))
                own = own[_first(anchor[own], score[own], place[own], NEGATIVES)]
                found.append((anchor[own] * POSITIVES + s, place[own], score[own]))
            return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

        group, place, score = _best(anchors, rows, keep, NEGATIVES)
        anchor = group // POSITIVES
        out = {"anchor_row": (anchors.row[anchor], pa.int64()), "positive_score": (slots[anchor, group % POSITIVES], pa.int64()), "score": (score, pa.int64()), "negative_row": (rows.row[place], pa.int64())}
        return _arrow(out).append_column("negative_id", _vec(rows, place))

    return cell


def integers(embedding: Column) -> Column:
    """floor(256 * x) of each component, x as double; null for a vector with a null or non-finite one."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * 256))
    large = F.exists(x, lambda v: F.abs(v * 256) >= LARGEST)
    return F.when(embedding.isNull() | bad, None).when(large, F.raise_error(F.lit(f"a component of {LARGEST // 256} or more: its scores do not fit in a long"))).otherwise(whole)


def prepared(rows: DataFrame, relabel: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, int]:
    """(row_id, vec_id, label, planes) of the rows that take part, kept on disk, and the number of planes."""
    label = rows["label"].cast("long")
    vec = rows["vec_id"].cast("long")
    base = rows.select(vec.alias("vec_id"), (relabel(vec, label) if relabel else label).alias("label"), F.explode(F.array(integers(rows["embedding"]))).alias("values")).filter("label is not null and values is not null")
    largest, width = base.agg(F.max(F.greatest(F.array_max("values"), -1 - F.array_min("values"))), F.max(F.size("values"))).first()
    planes, width = int(largest or 0).bit_length() + 1, max(1, width or 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("values")
            size = np.diff(lists.offsets.to_numpy())
            values = np.zeros((batch.num_rows, width), np.int64)
            values[np.repeat(np.arange(batch.num_rows), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
            raw = packed(values, planes)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in raw], pa.binary())], ["vec_id", "label", "planes"])

    made = base.mapInArrow(pack, "vec_id long, label long, planes binary")
    # Repeated rows are rows of their own, so each gets a number, which has to stay the same.
    return durable(made.withColumn("row_id", F.monotonically_increasing_id())), planes


def _blocks(n: Column, size: int, most: int) -> Column:
    """Number of blocks of n rows: of about size rows each, or up to `most` blocks where there are rows for them."""
    return F.greatest(F.ceil(n / size), F.least(F.lit(most), F.floor(n / LEAST_ROWS)), F.lit(1)).cast("long")


def _cells(rows: DataFrame, anchors: DataFrame, by: list[str], task, schema: str, spread: int) -> DataFrame:
    """What task makes of each cell; rows and anchors have n and anchors_n, the sizes of their group `by`."""
    across = _blocks(F.col("anchors_n"), BLOCK_ANCHORS, 0)
    down = _blocks(F.col("n"), BLOCK_ROWS, spread)
    left = rows.withColumn("down", F.pmod(F.xxhash64("row_id"), down)).withColumn("across", F.explode(F.sequence(F.lit(0).cast("long"), across - 1)))
    right = anchors.withColumn("across", F.pmod(F.xxhash64("row_id"), across)).withColumn("down", F.explode(F.sequence(F.lit(0).cast("long"), down - 1)))
    cell = [*by, "across", "down"]
    # Anchors are rows too: under other names their columns are told from the rows'.
    right = right.select(*[F.col(c).alias(f"of_{c}") for c in right.columns])
    return left.groupBy(*cell).cogroup(right.groupBy(*[f"of_{c}" for c in cell])).applyInArrow(lambda a, b: task(a, b.rename_columns([c.removeprefix("of_") for c in b.column_names])), schema)


def _ranked(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Callable[[Column], Column], relabel: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label).

    is_anchor: which vec_ids are anchors. relabel: the label that counts, of vec_id and
    label. Rows with a null label, a null vector or a null or non-finite component take no
    part; other columns are ignored. Shorter vectors are followed by zeros. A row of a null
    vec_id is no anchor and comes last among equal scores. A repeated row is a row of its
    own: as an anchor it gives its rows again, and it is an other row to its copies, in the
    order in which rows are numbered. A label with one row has no positives, and a
    positive without rows in its range gives none; so an empty table gives no rows.
    """
    base, planes = prepared(rows, relabel)
    spark = rows.sparkSession
    chosen = base.filter(F.coalesce(is_anchor(F.col("vec_id")), F.lit(False)))
    sizes = base.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(is_anchor(F.col("vec_id")), F.lit(False))).alias("anchors_n"))
    total = base.count()
    spread = 4 * spark.sparkContext.defaultParallelism
    # Labels without anchors have nothing to score; the sizes reach the rows of a hot label by salted joins.
    sizes = durable(sizes.filter("anchors_n > 0"))
    sized = joined_back(base, sizes, ["label"], "n", total)
    anchored = joined_back(chosen, sizes, ["label"], "n", total)
    few = _cells(sized, anchored, ["label"], _cell_positives(planes), "anchor_row long, score long, positive_row long, positive_id long", spread)
    order = [F.col("score").desc(), F.col("positive_id").asc_nulls_last(), F.col("positive_row")]
    positives = durable(_ranked(few, ["anchor_row"], order, POSITIVES).select("anchor_row", "positive_row", "positive_id", F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")))

    ranges = positives.groupBy("anchor_row").agg(F.collect_set("positive_score").alias("positives"))
    asking = durable(chosen.join(ranges, chosen["row_id"] == ranges["anchor_row"]).drop("anchor_row"))
    figures = {"n": F.lit(total).cast("long"), "anchors_n": F.lit(asking.count()).cast("long")}
    cells = _cells(base.withColumns(figures), asking.withColumns(figures), [], _cell_negatives(planes), "anchor_row long, positive_score long, score long, negative_row long, negative_id long", spread)
    order = [F.col("score").desc(), F.col("negative_id").asc_nulls_last(), F.col("negative_row")]
    negatives = _ranked(cells, ["anchor_row", "positive_score"], order, NEGATIVES)
    ids = asking.select(F.col("row_id").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    found = negatives.select("anchor_row", "positive_score", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("negative_score"))
    return found.join(positives, ["anchor_row", "positive_score"]).join(ids, "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
