"""Nearest neighbours: exact by join or by blocks of matrix products, approximate by cells or hashing, and in bands of depth."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import squared_distance
from . import copies

#: Distances that are computed at a time: 32 MB.
SLICE = 4_000_000
#: Numbers in one block of references or of queries: 64 MB of doubles.
BLOCK_VALUES = 8_000_000
#: Pairs that one task compares, about.
TASK_PAIRS = 1_500_000_000
#: Blocks of references that nearest_joined deals its queries to without a key.
DEALT = 32


def nearest_joined(queries: DataFrame, refs: DataFrame, k: int, by: str | list[str] | None = None, apart: Column | None = None) -> DataFrame:
    """(query, ref, distance, rank) by an equi-join on ``by`` and a rank.

    queries: query, z [, by]; refs: ref, z [, by]; distance is squared. Without ``by``, each of the stated
    queries meets all references, in DEALT blocks of them. ``apart`` is a further condition on the
    pair, such as another fold. Ties go to the smaller ref.
    """
    if not by:
        queries = queries.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        refs, by = refs.withColumn("__block", F.pmod(F.xxhash64("ref"), F.lit(DEALT)).cast("int")), "__block"
    keys = [by] if isinstance(by, str) else list(by)
    q, r = queries.withColumnRenamed("z", "__q"), refs.withColumnsRenamed({"z": "__r", **{c: f"__r_{c}" for c in keys}})
    on = F.lit(True) if apart is None else apart
    for c in keys:
        on = on & (F.col(c) == F.col(f"__r_{c}"))
    pairs = q.join(r, on)
    pairs = pairs.withColumn("distance", squared_distance(F.col("__q"), F.col("__r")))
    w = Window.partitionBy("query").orderBy("distance", "ref")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "ref", "distance", "rank")


def banded(refs: DataFrame, band: int) -> DataFrame:
    """refs once for each depth that may look at them: ``probe`` makes the band join an equi-join."""
    return refs.withColumn("probe", F.explode(F.sequence(F.col("depth") - band, F.col("depth") + band)))


def distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; never below 0."""
    d = q @ (-2 * r.T)
    d += (r * r).sum(1)
    d += (q * q).sum(1)[:, None]
    return np.maximum(d, 0, out=d)


#: Columns that smallest looks at together in wide rows.
LEAF = 64


def smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the k smallest of each row, in order; ties go to the smaller column.

    In wide rows, the k smallest are in the k leaves of columns whose least values are smallest, so
    only those are looked at.
    """
    n, width = d.shape
    k = min(k, width)
    if width > 16 * LEAF * k:
        whole = width // LEAF * LEAF
        least = d[:, :whole].reshape(n, -1, LEAF).min(2)
        leaves = np.argsort(least, 1, kind="stable")[:, :k]
        columns = (np.sort(leaves, 1)[:, :, None] * LEAF + np.arange(LEAF)).reshape(n, -1)
        columns = np.concatenate([columns, np.broadcast_to(np.arange(whole, width), (n, width - whole))], 1)
    else:
        columns = np.broadcast_to(np.arange(width), (n, width))
    value = np.take_along_axis(d, columns, 1) if width > 16 * LEAF * k else d
    if value.shape[1] > 4 * k > 0:
        # Where the k-th value is no tie, those up to it are the k smallest; only they are put in order.
        hit = value <= np.partition(value, k - 1, axis=1)[:, k - 1 : k]
        sure = hit.sum(1) == k
        part = np.empty((n, k), np.int64)
        part[sure] = np.nonzero(hit[sure])[1].reshape(-1, k)
        part[sure] = np.take_along_axis(part[sure], np.argsort(np.take_along_axis(value[sure], part[sure], 1), 1, kind="stable"), 1)
        part[~sure] = np.argsort(value[~sure], 1, kind="stable")[:, :k]
    else:
        part = np.argsort(value, 1, kind="stable")[:, :k]
    return np.take_along_axis(columns, part, 1), np.take_along_axis(value, part, 1)


def nearest_blocked(queries: DataFrame, refs: DataFrame, k: int, group: str | None = None, fold: str | None = None, skip_self: bool = False, band: int = 0) -> DataFrame:
    """(query, ref, distance, rank): the same as nearest_joined, for large sets, by matrix products on the executors.

    Large sets of few coordinates are dealt by regions of space, see _in_regions; others by blocks:
    References and queries are dealt by hash to blocks of at most about BLOCK_VALUES numbers, and each
    pair of blocks is one key of a shuffle, so a task holds one block of references and goes over one of
    queries. There are as many blocks of queries as make about TASK_PAIRS pairs for a task. The best k of
    all blocks are merged. With ``group`` (such as a depth) only references of the query's group, or with
    ``band`` of whole-numbered groups at most so far away, count; with ``fold`` only those of other folds; with ``skip_self`` not the reference of the same name.
    Queries of a null group, and those with nothing to compare, have no rows. Both tables are read several times.
    """
    if not skip_self and (found := _in_regions(queries, refs, k, group, fold, band)) is not None:
        return found
    return _in_blocks(queries, refs, k, group, fold, skip_self, band)


def _in_blocks(queries: DataFrame, refs: DataFrame, k: int, group: str | None, fold: str | None, skip_self: bool, band: int) -> DataFrame:
    """nearest_blocked by pairs of blocks."""
    spark = queries.sparkSession
    if band:
        refs = banded(refs.withColumnRenamed(group, "depth"), band).drop("depth").withColumnRenamed("probe", group)
    kinds = {"query": queries.schema["query"].dataType, "ref": refs.schema["ref"].dataType}
    own = lambda df: F.col(group).cast("string") if group else F.lit("")
    f = F.xxhash64(fold) if fold else F.lit(0).cast("long")
    q = queries.select(own(queries).alias("g"), "query", F.col("z").cast("array<double>").alias("z"), f.alias("f"))
    r = refs.select(own(refs).alias("g"), "ref", F.col("z").cast("array<double>").alias("z"), f.alias("f"))
    size = r.groupBy("g").agg(F.count("*").alias("nr"), F.max(F.size("z")).alias("d")).join(q.groupBy("g").agg(F.count("*").alias("nq")), "g")
    r_blocks = F.ceil(F.col("nr") * F.col("d") / BLOCK_VALUES)
    q_blocks = F.greatest(F.ceil(F.col("nq") * F.col("d") / BLOCK_VALUES), F.ceil(F.col("nq").cast("double") * F.col("nr") / r_blocks / TASK_PAIRS))
    # A few numbers for each group.
    size = size.select("g", r_blocks.cast("int").alias("br"), q_blocks.cast("int").alias("bq"))
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    mine = lambda name, n: F.pmod(F.xxhash64(F.lit("block"), name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tables = (
        r.join(size, "g").select("g", every("bq").alias("i"), mine("ref", "br").alias("j"), F.lit(0).alias("side"), none("query"), "ref", "z", "f"),
        q.join(size, "g").select("g", mine("query", "bq").alias("i"), every("br").alias("j"), F.lit(1).alias("side"), "query", none("ref"), "z", "f"),
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tables[0].unionByName(tables[1]).repartition(width, "g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "ref")
    keyed = dealt.select(F.concat_ws(":", "i", "j", "g").alias("key"), "side", "query", "ref", "z", "f")

    def compare(batches):
        key, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, sides = batch.column("key").to_numpy(zero_copy_only=False), batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (sides[1:] != sides[:-1])]).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(names)], strict=True):
                part = batch.slice(lo, hi - lo)
                if names[lo] != key:
                    key, held, block = names[lo], [], None
                if sides[lo] == 0:
                    held.append((part.column("ref"), _matrix(part.column("z")), part.column("f").to_numpy()))
                elif held:
                    if block is None:
                        block = _Block([h[0] for h in held], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
                    yield from block.nearest(part.column("query"), _matrix(part.column("z")), part.column("f").to_numpy(), k, bool(fold), skip_self)

    kind = lambda name: kinds[name].simpleString()
    found = keyed.mapInArrow(compare, f"query {kind('query')}, ref {kind('ref')}, distance double")
    w = Window.partitionBy("query").orderBy("distance", "ref")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


#: Queries and references whose distances are computed at a time: 1 MB, which a core's cache holds.
TILE_ROWS, TILE_COLUMNS = 128, 2048
#: Leaves, those of the likeliest lengths, that give a tile's first bound.
FIRST_LEAVES = 64


class _Block:
    """References of one key, for searches by leaves of LEAF columns.

    Columns are in the order of fold and length, and each fold is filled up to whole leaves with columns
    at an infinite distance. A query's k nearest are in leaves whose least distance is not above the
    k-th least one of its leaves, so only those are looked at again. Least distances are of 32-bit
    numbers, with a bound of their errors, which is narrow in leaves of references of like length.
    Leaves whose lengths differ from a tile of queries' by more than its neighbours can be away, by the
    triangle inequality, are not computed at all.
    """

    def __init__(self, names: list[pa.Array], z: np.ndarray, folds: np.ndarray):
        self.names = pa.concat_arrays(names)
        norms = (z * z).sum(1)
        order = np.lexsort((norms, folds))
        self.folds, sizes = np.unique(folds, return_counts=True)
        leaves = -(-sizes // LEAF)
        self.first = np.r_[0, np.cumsum(leaves)]
        self.place = np.full(int(self.first[-1]) * LEAF, -1, np.int64)
        at, row = self.first[:-1] * LEAF, 0
        for start, size in zip(at.tolist(), sizes.tolist(), strict=True):
            self.place[start : start + size] = order[row : row + size]
            row += size
        self.z = z[self.place]
        empty = self.place < 0
        norm = norms[self.place]
        self.wide = np.ascontiguousarray(np.c_[-2 * self.z, norm].T.astype(np.float32))
        self.wide[:-1, empty], self.wide[-1, empty] = 0, np.inf
        self.reach = np.sqrt(np.where(empty, 0, norm).reshape(-1, LEAF).max(1))
        self.inner = np.sqrt(np.where(empty, np.inf, norm).reshape(-1, LEAF).min(1))

    def _least(self, z: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The least distance of each row, but for the row's own norm, in each of the leaves."""
        left = np.c_[z, np.ones(len(z))].astype(np.float32)
        out = np.empty((len(z), len(leaves)), np.float32)
        runs = np.flatnonzero(np.r_[True, np.diff(leaves) != 1, True])
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            for lo in range(a, b, TILE_COLUMNS // LEAF):
                hi = min(b, lo + TILE_COLUMNS // LEAF)
                tile = left @ self.wide[:, leaves[lo] * LEAF : (leaves[hi - 1] + 1) * LEAF]
                out[:, lo:hi] = tile.reshape(len(z), hi - lo, LEAF).min(2)
        return out

    def _bound(self, z: np.ndarray, size: np.ndarray, leaves: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least distances, their errors, a bound of the k-th least distance), all less the row's own norm."""
        least = self._least(z, leaves).astype(np.float64)
        reach = self.reach[leaves][None]
        # Of a sum of so many 32-bit products, and of the numbers' own rounding.
        error = 6e-8 * (z.shape[1] + 4) * (2 * size[:, None] + reach) * reach
        top = min(k, len(leaves))
        return least, error, np.partition(least + error, top - 1, axis=1)[:, top - 1 : top]

    def _rows(self, z: np.ndarray, leaves: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in names, distance) of the k nearest of each row, by distance and name."""
        size = np.sqrt((z * z).sum(1))
        gap = np.maximum(0, np.maximum(self.inner[leaves] - size.max(), size.min() - self.reach[leaves]))
        some = max(FIRST_LEAVES, k)
        if len(leaves) > 2 * some:
            first = np.sort(np.argpartition(gap, some)[:some])
            bound = self._bound(z, size, leaves[first], k)[2]
            away = max(0.0, float((bound[:, 0] + size * size).max()))
            leaves = leaves[gap * gap <= away * (1 + 1e-9) + 1e-300]
        least, error, bound = self._bound(z, size, leaves, k)
        row, leaf = np.nonzero(least - error <= bound)
        column = (leaves[leaf][:, None] * LEAF + np.arange(LEAF)).ravel()
        row = np.repeat(row, LEAF)
        real = self.place[column] >= 0
        row, column = row[real], column[real]
        distance = ((z[row] - self.z[column]) ** 2).sum(1)
        place = self.place[column]
        order = np.lexsort((place, distance, row))
        row, place, distance = row[order], place[order], distance[order]
        begin = np.searchsorted(row, row, "left")
        kept = np.arange(len(row)) - begin < k
        return row[kept], place[kept], distance[kept]

    def nearest(self, queries: pa.Array, z: np.ndarray, folds: np.ndarray, k: int, other_fold: bool, skip_self: bool):
        """Batches of (query, ref, distance): the k nearest of each query."""
        every = np.arange(int(self.first[-1]))
        size = (z * z).sum(1)
        groups = [(None, np.arange(len(z)))] if not other_fold else [(f, np.flatnonzero(folds == f)) for f in np.unique(folds)]
        own = None
        if skip_self:
            names, asked = self.names.to_numpy(zero_copy_only=False), queries.to_numpy(zero_copy_only=False)
            own = np.searchsorted(names, asked, "left"), np.searchsorted(names, asked, "right")
            # The nearest of all, with as many more as a name may have.
            more = k + int((own[1] - own[0]).max(initial=0))
        for f, rows in groups:
            # Queries of like length share a tile.
            rows = rows[np.argsort(size[rows], kind="stable")]
            mine = np.searchsorted(self.folds, f) if f is not None else len(self.folds)
            leaves = every
            if mine < len(self.folds) and self.folds[mine] == f:
                leaves = np.r_[every[: self.first[mine]], every[self.first[mine + 1] :]]
            if not len(leaves):
                continue
            for at in range(0, len(rows), TILE_ROWS):
                part = rows[at : at + TILE_ROWS]
                row, place, distance = self._rows(z[part], leaves, more if skip_self else k)
                if skip_self:
                    apart = (place < own[0][part[row]]) | (place >= own[1][part[row]])
                    row, place, distance = row[apart], place[apart], distance[apart]
                    kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
                    row, place, distance = row[kept], place[kept], distance[kept]
                yield pa.record_batch([queries.take(pa.array(part[row])), self.names.take(pa.array(place)), pa.array(distance)], names=["query", "ref", "distance"])


#: Numbers of the references of one region: 16 MB of doubles.
REGION_VALUES = 2_000_000
#: Numbers of the references, and of the queries, that are drawn to plan the regions and to bound a query's reach.
SAMPLE_VALUES = 400_000
#: Queries of one tile, which are close to each other.
CLOSE_ROWS = 32


#: References of one leaf, and leaves that narrow a tile's bounds before others are looked at.
CLOSE_LEAF, FIRST_CLOSE = 64, 16
#: Share of the variance that the coordinates of the leaves' boxes hold.
BOX_VARIANCE = 0.97
#: Pairs of queries and leaves that are kept at a time.
CLOSE_PAIRS = 4_000_000
#: Groups, folds and coordinates that a search by regions takes at most; more are searched by blocks.
MOST_COLUMNS = 64
#: A distance that is none.
FAR = 1e300


class _Rule:
    """Which references count: those of groups at most ``band`` away, and with ``folds`` those of other folds."""

    def __init__(self, groups: np.ndarray, folds: np.ndarray, band: int):
        self.groups, self.folds, self.band = groups, folds, band

    def marks(self, g: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Of references: 1 in the columns of their group and fold."""
        return np.concatenate([g[:, None] == self.groups, f[:, None] == self.folds], 1).astype(float)

    def barred(self, g: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Of queries: FAR in the columns of the groups and folds that do not count."""
        near = (g[:, None] == self.groups) if not self.band else np.abs(g[:, None] - self.groups) <= self.band
        return np.concatenate([~near, f[:, None] == self.folds], 1) * FAR


class _Tree:
    """Rows in leaves of bounded size by cuts at medians of the widest coordinate, with a box around each leaf."""

    def __init__(self, z: np.ndarray, most: int):
        order, pending, cuts = np.arange(len(z)), [(0, len(z))], []
        while pending:
            lo, hi = pending.pop()
            if hi - lo <= most:
                cuts.append((lo, hi))
                continue
            rows = order[lo:hi]
            part = z[rows]
            column = part[:, int(np.argmax(part.max(0) - part.min(0)))]
            middle = (hi - lo) // 2
            order[lo:hi] = rows[np.argpartition(column, middle)]
            pending += [(lo + middle, hi), (lo, lo + middle)]
        self.order, self.cuts = order, cuts

    def boxes(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.array([lo for lo, _ in self.cuts])
        ordered = z[self.order]
        return np.minimum.reduceat(ordered, starts), np.maximum.reduceat(ordered, starts)


class _Close:
    """References in leaves with boxes, for searches of queries that lie close to each other.

    A query looks at the leaves whose boxes are no further away than its bound, and the queries of a leaf
    are compared together: candidates come from a matrix product with a bound of its error, and their
    distances are then computed by differences.
    Groups and folds that do not count for a query are further coordinates, which put them at FAR.
    """

    def __init__(self, z: np.ndarray, g: np.ndarray, f: np.ndarray, rule: _Rule):
        self.rule, self.centre = rule, z.mean(0)
        # Boxes are of the principal directions that hold nearly all of the variance; those of fewer coordinates are never further.
        values, turn = np.linalg.eigh(np.atleast_2d(np.cov(z.T, ddof=0)))
        held = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
        self.turn = turn[:, ::-1][:, : int(np.searchsorted(held, BOX_VARIANCE)) + 1]
        x = (z - self.centre) @ self.turn
        tree = _Tree(x, CLOSE_LEAF)
        self.low, self.high = tree.boxes(x)
        self.middle = (self.low + self.high) / 2
        sizes = np.array([hi - lo for lo, hi in tree.cuts])
        # Leaves are filled up with rows at FAR.
        place = np.full((len(sizes), CLOSE_LEAF), -1, np.int64)
        place[np.arange(CLOSE_LEAF) < sizes[:, None]] = tree.order
        self.place = place.ravel()
        empty = self.place < 0
        self.z = z[self.place]
        moved = self.z - self.centre
        norm = (moved * moved).sum(1)
        self.reach = float(np.sqrt(norm[~empty].max()))
        norm[empty], moved[empty] = FAR, 0
        own = rule.marks(g[self.place], f[self.place])
        self.wide = np.concatenate([-2 * moved, norm[:, None], own], 1).reshape(len(sizes), CLOSE_LEAF, -1)

    def _pairs(self, z: np.ndarray, left: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bound, row, leaf) of a tile: the leaves whose boxes are no further from a row than its bound, which near leaves narrow."""
        near = ((self.middle - ((z.mean(0) - self.centre) @ self.turn)) ** 2).sum(1)
        first = np.argpartition(near, FIRST_CLOSE)[:FIRST_CLOSE] if len(near) > FIRST_CLOSE else np.arange(len(near))
        found = left @ self.wide[first].reshape(-1, left.shape[1]).T
        if found.shape[1] >= k:
            top = np.partition(found, k - 1, axis=1)[:, k - 1]
            norm, error = self._errors(z)
            bound = np.where(top < FAR / 2, np.minimum(bound, top + norm + error), bound)
        x = (z - self.centre) @ self.turn
        # 32-bit numbers are rounded, and boxes in them are.
        limit = (np.sqrt(bound) * (1 + 1e-6) + 1e-6 * (np.sqrt(((z - self.centre) ** 2).sum(1)) + self.reach)) ** 2
        away = np.maximum(0, np.maximum(self.low - x.max(0), x.min(0) - self.high))
        leaves = np.flatnonzero((away * away).sum(1) <= limit.max())
        x, low, high = x.T.astype(np.float32)[:, :, None], self.low.T[:, leaves].astype(np.float32), self.high.T[:, leaves].astype(np.float32)
        gap, step, other = (np.zeros((len(z), len(leaves)), np.float32) for _ in range(3))
        for i in range(len(x)):
            np.subtract(low[i], x[i], out=step)
            np.subtract(x[i], high[i], out=other)
            np.maximum(step, other, out=step)
            np.maximum(step, 0, out=step)
            np.multiply(step, step, out=step)
            np.add(gap, step, out=gap)
        row, leaf = np.nonzero(gap <= limit[:, None])
        return bound, row, leaves[leaf]

    def _errors(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = z - self.centre
        norm = (moved * moved).sum(1)
        return norm, 4e-16 * (z.shape[1] + 4) * (np.sqrt(norm) + self.reach) ** 2

    def _compared(self, z: np.ndarray, left: np.ndarray, k: int, bound: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, place, distance) of the k nearest of each row in its leaves: rows of one leaf together."""
        order = np.argsort(leaf.astype(np.uint16) if len(self.low) < 1 << 16 else leaf, kind="stable")
        row, leaf = row[order], leaf[order]
        norm, error = self._errors(z)
        limit = np.minimum(bound * (1 + 1e-9) + 1e-300 - norm + error, FAR / 2)
        starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else np.zeros(0, int)
        rows, places = [], []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=False):
            mine, at = row[lo:hi], int(leaf[lo])
            hit, column = np.nonzero(left[mine] @ self.wide[at].T <= limit[mine][:, None])
            rows.append(mine[hit])
            places.append(column + at * CLOSE_LEAF)
        row, at = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, places))
        distance, place = ((z[row] - self.z[at]) ** 2).sum(1), self.place[at]
        order = np.lexsort((place, distance, row))
        row, place, distance = row[order], place[order], distance[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        return row[kept], place[kept], distance[kept]

    def nearest(self, z: np.ndarray, g: np.ndarray, f: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, place, distance) of the k nearest of each query, but for such that are beyond its bound."""
        tree, out, held, begin, pairs = _Tree((z - self.centre) @ self.turn, CLOSE_ROWS), [], [], 0, 0
        z, g, f, bound = z[tree.order], g[tree.order], f[tree.order], bound[tree.order]
        left = np.concatenate([z - self.centre, np.ones((len(z), 1)), self.rule.barred(g, f)], 1)
        for lo, hi in tree.cuts:
            mine, row, leaf = self._pairs(z[lo:hi], left[lo:hi], k, bound[lo:hi])
            held.append((mine, row + lo - begin, leaf))
            pairs += len(row)
            if hi == len(z) or pairs >= CLOSE_PAIRS:
                part = slice(begin, hi)
                row, place, distance = self._compared(z[part], left[part], k, *(np.concatenate([x[i] for x in held]) for i in range(3)))
                out.append((tree.order[part][row], place, distance))
                held, begin, pairs = [], hi, 0
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


class _Regions:
    """Regions of space by cuts at medians of drawn references, and what a query's neighbours can at most be away.

    References belong to one region each. ``low`` and ``high`` are boxes around those of each region.
    """

    def __init__(self, z: np.ndarray, g: np.ndarray, f: np.ndarray, rule: _Rule, parts: int):
        self.drawn, self.rule, self.nodes, self.parts = (z, g, f, rule), rule, [], 0
        self._cut(z, parts)
        self.low = self.high = None

    def _cut(self, z: np.ndarray, parts: int) -> int:
        """The place of a node: (column, cut, left, right), or (-1, region)."""
        at = len(self.nodes)
        self.nodes.append((-1, self.parts, 0, 0))
        spread = z.max(0) - z.min(0) if len(z) > 1 else np.zeros(1)
        column = int(np.argmax(spread))
        if parts < 2 or not spread[column] > 0:
            self.parts += 1
            return at
        cut = float(np.quantile(z[:, column], (parts // 2) / parts))
        under = z[:, column] <= cut
        if under.all():
            cut = float(z[z[:, column] < cut, column].max())
            under = z[:, column] <= cut
        left = self._cut(z[under], parts // 2)
        self.nodes[at] = (column, cut, left, self._cut(z[~under], parts - parts // 2))
        return at

    def of(self, z: np.ndarray) -> np.ndarray:
        out, pending = np.zeros(len(z), np.int32), [(0, np.arange(len(z)))]
        while pending:
            at, rows = pending.pop()
            column, cut, left, right = self.nodes[at]
            if column < 0:
                out[rows] = cut
            elif len(rows):
                under = z[rows, column] <= cut
                pending += [(left, rows[under]), (right, rows[~under])]
        return out

    def reached(self, z: np.ndarray, g: np.ndarray, f: np.ndarray, k: int, known: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, region, bound): the regions where each query can have one of its k nearest. known: what a task keeps."""
        if not known:
            known.append(_Close(*self.drawn))
        row, _, distance = known[0].nearest(z, g, f, k, np.full(len(z), np.inf))
        bound, count = np.full(len(z), -np.inf), np.bincount(row, minlength=len(z))
        np.maximum.at(bound, row, distance)
        bound[count < k] = np.inf
        return *self.within(z, bound), bound

    def within(self, z: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region): the regions whose boxes are no further from a row than its bound."""
        limit = bound * (1 + 1e-9) + 1e-300
        hit = np.zeros((len(z), len(self.low)), bool)
        for j in range(len(self.low)):
            gap = np.maximum(0, np.maximum(self.low[j] - z, z - self.high[j]))
            hit[:, j] = (gap * gap).sum(1) <= limit
        return np.nonzero(hit)


@dataclass
class _Plan:
    """What a search by regions goes by: its tables (query or ref, z, group g, fold f, hash h), its regions and how much is in each."""

    q: DataFrame
    r: DataFrame
    n: int
    d: int
    n_queries: int
    rule: _Rule
    regions: _Regions
    r_blocks: np.ndarray
    #: Of each region, the share of the queries that are in it, and that reach it by a bound from drawn references.
    own: np.ndarray
    touched: np.ndarray


def _planned(queries: DataFrame, refs: DataFrame, k: int, group: str | None, fold: str | None, band: int) -> _Plan | None:
    """Regions by bounded draws of references and queries; None where a search by regions is of no use."""
    spark = queries.sparkSession
    whole = lambda df: F.col(group).cast("long") if band else F.xxhash64(group)
    g = lambda df: (whole(df) if group else F.lit(0).cast("long")).alias("g")
    f = (F.xxhash64(fold) if fold else F.lit(0).cast("long")).alias("f")
    some = lambda df: df.where(F.col(group).isNotNull()) if group else df
    q = some(queries).select("query", F.col("z").cast("array<double>").alias("z"), g(queries), f, F.xxhash64(F.lit("block"), "query").alias("h"))
    r = some(refs).select("ref", F.col("z").cast("array<double>").alias("z"), g(refs), f, F.xxhash64(F.lit("block"), "ref").alias("h"))
    kinds_of = r.groupBy("g", "f").agg(F.count("*").alias("n"), F.max(F.size("z")).alias("d")).limit(MOST_COLUMNS**2 + 1).toPandas()
    if not len(kinds_of):
        return None
    n, d = int(kinds_of["n"].sum()), int(kinds_of["d"].max())
    groups, folds = np.unique(kinds_of["g"]), np.unique(kinds_of["f"])
    if n * d <= REGION_VALUES or max(d, len(groups), len(folds)) > MOST_COLUMNS or len(kinds_of) > MOST_COLUMNS**2 or d < 1:
        return None
    n_queries = q.count()
    if not n_queries:
        return None
    rule = _Rule(groups, folds if fold else np.zeros(0, np.int64), band)
    draw = lambda name: F.shiftrightunsigned(F.xxhash64(F.lit("drawn"), name), 11).cast("double") / F.lit(float(2**53))

    def drawn(df: DataFrame, name: str, total: int, values: int) -> tuple[np.ndarray, ...]:
        t = df.where(draw(name) <= values / d / total).select("z", "g", "f").toArrow().combine_chunks()
        cells = [t.column(c).combine_chunks() for c in ("z", "g", "f")]
        return _matrix(cells[0]), cells[1].to_numpy(), cells[2].to_numpy()

    sample = drawn(r, "ref", n, SAMPLE_VALUES)
    if len(sample[0]) < 2:
        return None
    # As many as there are tasks at a time, if they are not too small.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * n * d / REGION_VALUES))
    regions = _Regions(*sample, rule, max(parts, math.ceil(n * d / REGION_VALUES)))

    def boxes(batches):
        low, high, count = np.full((regions.parts, d), np.inf), np.full((regions.parts, d), -np.inf), np.zeros(regions.parts, np.int64)
        for b in batches:
            if b.num_rows:
                z = _matrix(b.column("z"))
                at = regions.of(z)
                np.minimum.at(low, at, z)
                np.maximum.at(high, at, z)
                count += np.bincount(at, minlength=regions.parts)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"region": pa.array(there, pa.int32()), "n": pa.array(count[there]), "low": pa.array(list(low[there]), pa.list_(pa.float64())), "high": pa.array(list(high[there]), pa.list_(pa.float64()))})

    ends = [g(F.get(c, F.lit(i))).alias(f"{c}{i}") for i in range(d) for c, g in (("low", F.min), ("high", F.max))]
    found = r.select("z").mapInArrow(boxes, "region int, n long, low array<double>, high array<double>").groupBy("region").agg(F.sum("n").alias("n"), *ends).toPandas()
    at = found["region"].to_numpy()
    # A region without references is beyond all bounds.
    regions.low, regions.high, count = np.full((regions.parts, d), np.inf), np.full((regions.parts, d), np.inf), np.zeros(regions.parts)
    regions.low[at], regions.high[at], count[at] = found[[f"low{i}" for i in range(d)]], found[[f"high{i}" for i in range(d)]], found["n"]
    asked = drawn(q, "query", n_queries, SAMPLE_VALUES // 8)
    touched = np.zeros(regions.parts)
    if len(asked[0]):
        touched = np.bincount(regions.reached(*asked, k, [])[1], minlength=regions.parts) / len(asked[0])
    if touched.sum() > max(MOST_REACHED, regions.parts / 2):
        return None
    r_blocks = np.maximum(1, np.ceil(count * d / (2 * REGION_VALUES))).astype(int)
    own = np.bincount(regions.of(asked[0]), minlength=regions.parts) / max(1, len(asked[0]))
    return _Plan(q, r, n, d, n_queries, rule, regions, r_blocks, own, touched)


def _units(spark: SparkSession, p: _Plan, q_blocks: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(base, width, keys): units of work, r_blocks * q_blocks of each region from its base on, and a key for each; width is that of a shuffle."""
    base = np.r_[0, np.cumsum(p.r_blocks * q_blocks)]
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(base[-1]))
    return base, width, _spread_keys(spark, int(base[-1]), width)


def _in_regions(queries: DataFrame, refs: DataFrame, k: int, group: str | None, fold: str | None, band: int) -> DataFrame | None:
    """nearest_blocked for large sets of few coordinates, by regions of space; None where that is of no use.

    Regions are cut at medians of drawn references, and each reference and query goes to its own. The
    k-th nearest there bounds how far a query's neighbours can be away, so it then goes to those other
    regions whose boxes are no further. Equal queries go as one, with all of their names. The draw plans;
    all references are compared. A region of many references, such as copies, or of many queries is
    dealt to several tasks by hash.
    """
    p = _planned(queries, refs, k, group, fold, band)
    if p is None:
        return None
    spark = queries.sparkSession
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "ref": refs.schema["ref"].dataType.simpleString()}
    q, r, d, rule, regions, r_blocks = p.q, p.r, p.d, p.rule, p.regions, p.r_blocks
    q_blocks = np.maximum(1, np.ceil(p.n_queries * d * np.maximum(p.own / (2 * REGION_VALUES), p.touched / (16 * REGION_VALUES)))).astype(int)
    base, width, key_of = _units(spark, p, q_blocks)
    plan = spark.sparkContext.broadcast(regions)

    def deal_refs(batches):
        for b in batches:
            if b.num_rows:
                at = plan.value.of(_matrix(b.column("z")))
                j = b.column("h").to_numpy() % r_blocks[at]
                row, i = _each(q_blocks[at])
                yield _dealt(key_of[base[at[row]] + i * r_blocks[at[row]] + j[row]], b, row, "ref")

    def deal_queries(batches):
        for b in batches:
            if b.num_rows:
                at, h = plan.value.of(_matrix(b.column("z"))), b.column("h").to_numpy()
                yield _dealt(key_of[base[at] + h % q_blocks[at] * r_blocks[at] + h % r_blocks[at]], b, np.arange(b.num_rows), "query")

    wide = lambda name: f"key int, {name} {kinds[name]}, z array<double>, g long, f long"
    given = r.mapInArrow(deal_refs, wide("ref")).repartition(width, "key")
    first = q.mapInArrow(deal_queries, wide("query")).repartition(width, "key")

    def at_home(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of different queries the k nearest of their own block, and a row for each other block where nearer ones can be."""
        out, block = [], _references(left, rule, k)
        for lo in range(0, right.num_rows, 1 + REGION_VALUES // d):
            part = right.slice(lo, 1 + REGION_VALUES // d).combine_chunks()
            part = part.take(pa.compute.sort_indices(part, [("query", "ascending")]))
            names, z, g, f = _columns(part, "query")
            order, starts = _alike(z, g, f)
            lead = order[starts]
            z, g, f = z[lead], g[lead], f[lead]
            row, place, distance = block[0].nearest(z, g, f, k, np.full(len(z), np.inf)) if block else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            count, bound = np.bincount(row, minlength=len(z)), np.full(len(z), -np.inf)
            np.maximum.at(bound, row, distance)
            bound[count < k] = np.inf
            by = np.argsort(row, kind="stable")
            lists = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            found = (block[1] if block else pa.array([], names_type["ref"])).take(pa.array(place[by]))
            cuts, key = np.r_[0, np.cumsum(count)], int(part.column("key")[0].as_py())
            rep = names.take(pa.array(lead))
            out.append(
                pa.table({
                    "key": pa.array(np.full(len(z), key), pa.int32()), "rep": rep, "names": lists(names.take(pa.array(order)), np.r_[starts, len(order)]),
                    "refs": lists(found, cuts), "found": lists(pa.array(distance[by]), cuts),
                })
            )
            unit = int(np.flatnonzero(key_of == key)[0])
            home = int(np.searchsorted(base, unit, "right")) - 1
            i, j = divmod(unit - int(base[home]), int(r_blocks[home]))
            row, at = plan.value.within(z, bound)
            more, other = _each(r_blocks[at])
            row, at = row[more], at[more]
            away = (at != home) | (other != j)
            row, at, other = row[away], at[away], other[away]
            there = key_of[base[at] + i % q_blocks[at] * r_blocks[at] + other]
            out.append(pa.table({"key": pa.array(there, pa.int32()), "rep": rep.take(pa.array(row)), "z": _lists(z[row]), "g": pa.array(g[row]), "f": pa.array(f[row]), "bound": pa.array(bound[row])}))
        return pa.concat_tables([passed.empty_table(), *out], promote_options="permissive").cast(passed)

    def further(left: pa.Table, right: pa.Table) -> pa.Table:
        """What was found at home, and the nearest of another block within the bound."""
        right = right.combine_chunks()
        known = right.filter(pa.compute.is_valid(right.column("names")))
        cells = [known.column(c).combine_chunks() for c in ("rep", "names", "refs", "found")]
        size = np.maximum(1, pa.compute.list_value_length(cells[2]).to_numpy())
        # A query of which nothing was found at home has one row, which says its names.
        row, number = _each(size)
        empty = pa.compute.list_value_length(cells[2]).to_numpy()[row] == 0
        start = np.r_[0, np.cumsum(np.where(pa.compute.list_value_length(cells[2]).to_numpy() > 0, size, 0))][:-1][row] + number if len(row) else np.zeros(0, int)
        at = pa.array(start, pa.int64(), mask=empty)
        out = [pa.table({"rep": cells[0].take(pa.array(row)), "names": cells[1].take(pa.array(row, pa.int64(), mask=number > 0)), "ref": cells[2].flatten().take(at), "distance": cells[3].flatten().take(at)})]
        asked, block = right.filter(pa.compute.is_null(right.column("names"))), _references(left, rule, k)
        if block:
            for lo in range(0, asked.num_rows, 1 + REGION_VALUES // d):
                part = asked.slice(lo, 1 + REGION_VALUES // d).combine_chunks()
                names, z, g, f = _columns(part, "rep")
                row, place, distance = block[0].nearest(z, g, f, k, part.column("bound").to_numpy())
                out.append(pa.table({"rep": names.take(pa.array(row)), "ref": block[1].take(pa.array(place)), "distance": pa.array(distance)}))
        return pa.concat_tables([best.empty_table(), *out], promote_options="permissive").cast(best)

    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

    names_type = {name: to_arrow_type(side.schema[name].dataType) for name, side in (("query", queries), ("ref", refs))}
    many = lambda kind: pa.list_(kind)
    passed = pa.schema([("key", pa.int32()), ("rep", names_type["query"]), ("names", many(names_type["query"])), ("refs", many(names_type["ref"])), ("found", many(pa.float64())), ("z", many(pa.float64())), ("g", pa.int64()), ("f", pa.int64()), ("bound", pa.float64())])
    best = pa.schema([("rep", names_type["query"]), ("names", many(names_type["query"])), ("ref", names_type["ref"]), ("distance", pa.float64())])
    home = first.groupBy("key").cogroup(given.groupBy("key")).applyInArrow(lambda right, left: at_home(left, right), from_arrow_schema(passed))
    near = home.repartition(width, "key").groupBy("key").cogroup(given.groupBy("key")).applyInArrow(lambda right, left: further(left, right), from_arrow_schema(best))
    w = Window.partitionBy("rep")
    ranked = near.withColumn("names", F.first("names", ignorenulls=True).over(w)).where(F.col("ref").isNotNull()).withColumn("rank", F.row_number().over(w.orderBy("distance", "ref"))).where(F.col("rank") <= k)
    return ranked.select(F.explode("names").alias("query"), "ref", "distance", "rank")


def kth_distances(queries: DataFrame, refs: DataFrame, k: int, group: str | None = None, fold: str | None = None, band: int = 0) -> DataFrame:
    """(query, distance): of each query that has as many, its squared distance to its k-th neighbour, as nearest_blocked has it.

    query is a whole number. For what asks for no names: in a search by regions these are not sent at all, rows
    go in packs, and queries take turns: in each about twice as many rows are sent as there are references, and its shuffles go with it.
    """
    p = _planned(queries, refs, k, group, fold, band)
    if p is None:
        return _in_blocks(queries, refs, k, group, fold, False, band).where(F.col("rank") == k).select("query", "distance")
    spark = queries.sparkSession
    d, rule, r_blocks = p.d, p.rule, p.r_blocks
    sent = p.n_queries * (1 + p.touched.sum())
    turns = min(MOST_TURNS, math.ceil(sent / max(2 * p.n, REGION_VALUES / d)))
    # Smaller than those of a search with names: a unit's packs are one batch.
    q_blocks = np.maximum(1, np.ceil(p.n_queries / turns * d * np.maximum(p.own, p.touched / 2) / (2 * REGION_VALUES))).astype(int)
    base, width, key_of = _units(spark, p, q_blocks)
    plan = spark.sparkContext.broadcast(p.regions)

    def deal_refs(batches):
        for b in batches:
            if b.num_rows:
                z = _matrix(b.column("z"))
                at = plan.value.of(z)
                j = b.column("h").to_numpy() % r_blocks[at]
                row, i = _each(q_blocks[at])
                yield from _packs(key_of[base[at[row]] + i * r_blocks[at[row]] + j[row]], z=z[row], kind=_kinds(b)[row])

    def deal_queries(batches):
        for b in batches:
            if b.num_rows:
                z, h = _matrix(b.column("z")), b.column("h").to_numpy()
                at = plan.value.of(z)
                yield from _packs(key_of[base[at] + h % q_blocks[at] * r_blocks[at] + h % r_blocks[at]], id=b.column("query").to_numpy(), z=z, kind=_kinds(b))

    def references(t: pa.Table) -> _Close | None:
        if not t.num_rows:
            return None
        z, kind = _unpacked(t, "z", float, d), _unpacked(t, "kind", np.int64, 2)
        at = _wanted(z, kind[:, 0], kind[:, 1], rule, k)
        return _Close(z[at], kind[at, 0], kind[at, 1], rule)

    def at_home(key, right: pa.Table, left: pa.Table) -> pa.Table:
        """Names and numbers of a unit's different queries, their nearest there, and packs for each other unit where nearer ones can be."""
        out, block, key = [], references(left), key[0].as_py()
        unit = int(np.flatnonzero(key_of == key)[0])
        home = int(np.searchsorted(base, unit, "right")) - 1
        i, j = divmod(unit - int(base[home]), int(r_blocks[home]))
        ids, every, kinds = (_unpacked(right, *x) for x in (("id", np.int64, 1), ("z", float, d), ("kind", np.int64, 2)))
        begin = 0
        for lo in range(0, len(every), 1 + REGION_VALUES // d):
            part = slice(lo, lo + 1 + REGION_VALUES // d)
            order, starts = _alike(every[part], kinds[part, 0], kinds[part, 1])
            lead = order[starts]
            z, kind = every[part][lead], kinds[part][lead]
            number = begin + np.arange(len(lead), dtype=np.int32)
            row, distance = np.zeros(0, int), np.zeros(0)
            if block:
                row, _, distance = block.nearest(z, kind[:, 0], kind[:, 1], k, np.full(len(z), np.inf))
            bound = np.full(len(z), -np.inf)
            np.maximum.at(bound, row, distance)
            bound[np.bincount(row, minlength=len(z)) < k] = np.inf
            out += _packs(np.full(len(order), key), id=ids[part][order, 0], lead=np.repeat(number, np.diff(np.r_[starts, len(order)])))
            out += _packs(np.full(len(row), key), number=number[row], distance=distance)
            row, at = plan.value.within(z, bound)
            more, other = _each(r_blocks[at])
            row, at = row[more], at[more]
            away = (at != home) | (other != j)
            row, at, other = row[away], at[away], other[away]
            out += _packs(key_of[base[at] + i % q_blocks[at] * r_blocks[at] + other], number=number[row], z=z[row], kind=kind[row], bound=bound[row])
            begin += len(lead)
        passed = [c for c in PASSED if c != "home"]
        found = _table(out, passed)
        return found.add_column(1, "home", pa.array(np.full(found.num_rows, key), pa.int32()))

    def further(right: pa.Table, left: pa.Table) -> pa.Table:
        """What was found at home, and the nearest of another block within the bound."""
        far = pa.compute.greater(pa.compute.binary_length(right.column("z")), 0)
        out, asked = [right.filter(pa.compute.invert(far)).select(FOUND)], right.filter(far)
        block = references(left) if asked.num_rows else None
        if block:
            for part in _runs(asked, 1 + REGION_VALUES // d, 8 * d):
                homes = np.repeat(part.column("home").to_numpy(), pa.compute.binary_length(part.column("number")).to_numpy() // 4)
                number, z, kind, bound = (_unpacked(part, *x) for x in (("number", np.int32, 1), ("z", float, d), ("kind", np.int64, 2), ("bound", float, 1)))
                row, _, distance = block.nearest(z, kind[:, 0], kind[:, 1], k, bound[:, 0])
                out.append(_table(_packs(homes[row], number=number[row, 0], distance=distance), ["key", *FOUND[1:]]).rename_columns(FOUND))
        return pa.concat_tables(out)

    def merged(t: pa.Table) -> pa.Table:
        """The k-th distance of each query of a unit, of all that was found of it."""
        ids, lead, number, distance = (_unpacked(t, *x)[:, 0] for x in (("id", np.int64, 1), ("lead", np.int32, 1), ("number", np.int32, 1), ("distance", float, 1)))
        order = np.lexsort((distance, number))
        number, distance = np.r_[number[order], np.full(k, -1, np.int32)], np.r_[distance[order], np.zeros(k)]
        at = np.searchsorted(number[:-k], lead, "left") + k - 1
        there = number[at] == lead
        return pa.table({"query": pa.array(ids[there], pa.int64()), "distance": pa.array(distance[at[there]], pa.float64())})

    def turn(number: int) -> DataFrame:
        q = p.q.withColumn("query", F.col("query").cast("long"))
        if turns > 1:
            q = q.where(F.pmod(F.shiftrightunsigned("h", 40), F.lit(turns)) == number)
        given = p.r.mapInArrow(deal_refs, "key int, z binary, kind binary").repartition(width, "key")
        first = q.mapInArrow(deal_queries, "key int, id binary, z binary, kind binary").repartition(width, "key")
        spelled = lambda names: ", ".join(f"{c} {'int' if c in ('key', 'home') else 'binary'}" for c in names)
        home = first.groupBy("key").cogroup(given.groupBy("key")).applyInArrow(at_home, spelled(PASSED))
        found = home.repartition(width, "key").groupBy("key").cogroup(given.groupBy("key")).applyInArrow(further, spelled(FOUND))
        return found.repartition(width, "home").groupBy("home").applyInArrow(merged, "query long, distance double")

    with copies.shuffles_dropped(spark):
        out = [copies.kept(turn(i)) for i in range(turns)]
    return reduce(DataFrame.unionByName, out)


#: Turns that the queries of kth_distances take at most.
MOST_TURNS = 16
#: Bytes of a pack's largest column, and packs of one batch.
PACK_BYTES, PACKS = 4_000_000, 64
#: What goes on from a unit: names of queries, and which different one each is; numbers with distances, or with what is compared further.
PASSED = ["key", "home", "id", "lead", "number", "distance", "z", "kind", "bound"]
#: What is found, by the unit that a query came from.
FOUND = ["home", "id", "lead", "number", "distance"]


def _kinds(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column("g").to_numpy(), b.column("f").to_numpy()], 1)


def _packs(key: np.ndarray, **columns: np.ndarray) -> list[pa.RecordBatch]:
    """Rows of one key in one cell for each column, as bytes, but for PACK_BYTES at most."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    step = 1 + PACK_BYTES // max(x.itemsize * math.prod(x.shape[1:]) for x in columns.values())
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, int)
    places = [slice(at, min(hi, at + step)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for at in range(lo, hi, step)]
    out = []
    for lo in range(0, len(places), PACKS):
        part = places[lo : lo + PACKS]
        cells = {name: pa.array([x[order[at]].tobytes() for at in part], pa.binary()) for name, x in columns.items()}
        out.append(pa.record_batch([pa.array(key[[at.start for at in part]], pa.int32()), *cells.values()], names=["key", *cells]))
    return out


def _table(packs: list[pa.RecordBatch], names: list[str]) -> pa.Table:
    """Packs of some of these columns, the others empty."""
    empty = lambda b: pa.array([b""] * b.num_rows, pa.binary())
    schema = pa.schema([(c, pa.int32() if c == "key" else pa.binary()) for c in names])
    return pa.Table.from_batches([pa.record_batch([b.column(c) if c in b.schema.names else empty(b) for c in names], schema=schema) for b in packs], schema)


def _unpacked(t: pa.Table, name: str, kind: type, width: int) -> np.ndarray:
    """All rows of a column of packs."""
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(-1, width)


def _runs(t: pa.Table, most: int, row: int):
    """Packs of together at least ``most`` rows of so many bytes of z, as long as there are."""
    rows = np.cumsum(pa.compute.binary_length(t.column("z")).to_numpy() // row)
    lo = 0
    while lo < len(rows):
        hi = int(np.searchsorted(rows, (rows[lo - 1] if lo else 0) + most)) + 1
        yield t.slice(lo, hi - lo)
        lo = hi


def _spread_keys(spark, units: int, width: int) -> np.ndarray:
    """For each unit a number that hash partitioning puts into another partition than the next one's, as far as there are so many."""
    numbers = spark.range(0, 40 * max(width, units), 1, 1).select(F.col("id").cast("int").alias("id"))
    place = numbers.select("id", F.pmod(F.hash("id"), F.lit(width)).alias("p")).toPandas()
    turn = place.groupby("p").cumcount().to_numpy()
    order = np.lexsort((place["p"].to_numpy(), turn))
    return place["id"].to_numpy()[order][:units].astype(np.int32)


def _columns(t: pa.Table, name: str) -> tuple:
    cells = [t.column(c).combine_chunks() for c in (name, "z", "g", "f")]
    return cells[0], _matrix(cells[1]), cells[2].to_numpy(), cells[3].to_numpy()


def _lists(z: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))


def _alike(z: np.ndarray, g: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows of equal vectors, groups and folds together, in their own order within."""
    rows = np.ascontiguousarray(np.concatenate([z, g[:, None].view(float), f[:, None].view(float)], 1))
    same = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    return order, np.flatnonzero(np.r_[True, np.diff(same[order]) != 0]) if len(order) else np.zeros(0, int)


def _references(left: pa.Table, rule: _Rule, k: int) -> tuple[_Close, pa.Array] | None:
    """References in the order of their names, but for copies that k others of smaller names stand before for all queries."""
    if not left.num_rows:
        return None
    left = left.combine_chunks()
    names, z, g, f = _columns(left.take(pa.compute.sort_indices(left, [("ref", "ascending")])), "ref")
    kept = _wanted(z, g, f, rule, k)
    return _Close(z[kept], g[kept], f[kept], rule), names.take(pa.array(kept))


def _wanted(z: np.ndarray, g: np.ndarray, f: np.ndarray, rule: _Rule, k: int) -> np.ndarray:
    """Places of references but for copies that k others stand before for all queries."""
    order, starts = _alike(z, g, np.zeros_like(f))
    if len(starts) == len(z):
        return np.arange(len(z))
    first = np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    before = np.arange(len(order)) - first
    # Those before it of the fold that has most of them, not its own: a query of that fold does not see these.
    unseen = np.zeros(len(order), int)
    for fold in rule.folds:
        mine = f[order] == fold
        run = np.cumsum(mine) - mine
        unseen = np.maximum(unseen, np.where(mine, 0, run - run[first]))
    return np.sort(order[before - unseen < k])


#: Regions that a query reaches, of a few dozen or more, at which blocks are used instead.
MOST_REACHED = 16


def _each(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number): each row as many times as it says, counted from 0."""
    row = np.repeat(np.arange(len(times)), times)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)


def _dealt(key: np.ndarray, b: pa.RecordBatch, row: np.ndarray, name: str, columns: tuple[str, ...] = ("z", "g", "f")) -> pa.RecordBatch:
    at = pa.array(row)
    return pa.record_batch([pa.array(key, pa.int32()), *(b.column(c).take(at) for c in (name, *columns))], names=["key", name, *columns])


def cells_of(n: int) -> int:
    """How many cells an index of n references has; fewer than 2 mean exact search."""
    return max(1, min(int(4 * math.sqrt(n)), n // 39, n))


#: Queries whose neighbours are looked up exactly to measure recall.
MEASURED = 256


#: References that cells are fitted on at most, drawn by hash; all are placed in them.
FITTED = 100_000


def probes_for(queries: DataFrame, placed: DataFrame, centres: np.ndarray, k: int, recall: float, group: str | None = None, band: int = 0) -> int:
    """The fewest cells that hold the share ``recall`` of the true neighbours of a hash-drawn sample of queries.

    References equal to the query, such as the query itself, are easy to find and don't count.
    """
    sample = queries.orderBy(F.xxhash64("query"), "query").limit(MEASURED).select("query", "z", *([group] if group else [])).persist()
    true = nearest_blocked(sample, placed.select("ref", "z", *([group] if group else [])), k + 1, group, band=band).where("distance > 1e-9")
    found = true.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "ref"))).where(F.col("rank") <= k)
    rows = placed.select("ref", "cell").join(F.broadcast(found), "ref").dropDuplicates(["query", "ref"]).join(F.broadcast(sample.select("query", "z")), "query").select("z", "cell").toPandas()
    sample.unpersist()
    if not len(rows):
        return len(centres)
    order = np.argsort(distances(np.stack(rows["z"].to_numpy()).astype(float), centres), 1, kind="stable")
    rank = np.sort((order == rows["cell"].to_numpy()[:, None]).argmax(1))
    return int(rank[max(0, math.ceil(recall * len(rank)) - 1)]) + 1


def nearest_in_cells(queries: DataFrame, refs: DataFrame, k: int, probes: int | None = None, seed: int = 0, recall: float = 0.95, group: str | None = None, band: int = 0) -> DataFrame:
    """Approximate: k-means cells; each query looks at the ``probes`` cells whose centres are nearest.

    Without ``probes``, as many as hold the share ``recall`` of true neighbours in a sample of the
    queries. With ``group`` only references of the query's group, or with ``band`` of groups at most so far away, count.
    Cells that are close to each other make a unit: a reference is sent once, and a query once to each
    unit with some of its cells. A unit of many references, or of many queries, is dealt to several tasks by hash.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = queries.sparkSession
    shape = refs.agg(F.count("*").alias("n"), F.max(F.size("z")).alias("d")).first()
    n, d = shape["n"], shape["d"]
    cells = cells_of(n)
    if cells < 2:
        return nearest_blocked(queries, refs, k, group, band=band)
    lot = F.shiftrightunsigned(F.xxhash64(F.lit("fitted"), "ref"), 11).cast("double") / F.lit(float(2**53))
    fitted = refs.where(lot <= FITTED / n) if n > FITTED else refs
    model = KMeans(k=cells, seed=seed, maxIter=5, initMode="random", featuresCol="__v", predictionCol="cell").fit(fitted.select(array_to_vector(F.col("z").cast("array<double>")).alias("__v")))
    centres = np.array(model.clusterCenters())

    def nearest_centres(z: np.ndarray, m: int) -> np.ndarray:
        step = 1 + SLICE // len(centres)
        return np.concatenate([smallest(distances(z[lo : lo + step], centres), m)[0] for lo in range(0, len(z), step)])

    @F.pandas_udf("int")
    def cell_of(z: pd.Series) -> pd.Series:
        return pd.Series(nearest_centres(np.stack(z.to_numpy()).astype(float), 1)[:, 0].astype("int32")) if len(z) else pd.Series([], dtype="int32")

    placed = refs.withColumn("cell", cell_of("z"))
    if probes is None:
        probes = probes_for(queries, placed, centres, k, recall, group, band)
    probes = min(probes, len(centres))
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "ref": refs.schema["ref"].dataType.simpleString()}
    g = ((F.col(group).cast("long") if band else F.xxhash64(group)) if group else F.lit(0).cast("long")).alias("g")
    some = lambda df: df.where(F.col(group).isNotNull()) if group else df
    q = some(queries).select("query", F.col("z").cast("array<double>").alias("z"), g, F.xxhash64(F.lit("block"), "query").alias("h"))
    r = some(placed).select("ref", F.col("z").cast("array<double>").alias("z"), g, F.xxhash64(F.lit("block"), "ref").alias("h"), "cell")
    # Units: runs of cells in the order of a tree of their centres, with about as many references each as make a task's share.
    size = np.zeros(len(centres))
    for row in placed.groupBy("cell").count().toPandas().itertuples(index=False):
        size[row[0]] = row[1]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1.0, min(REGION_VALUES / d, n / tasks))
    order = _Tree(centres, 1).order
    unit_of = np.zeros(len(centres), np.int64)
    unit_of[order] = ((np.cumsum(size[order]) - size[order]) // share).astype(int)
    unit_of = np.unique(unit_of, return_inverse=True)[1].ravel()
    units = int(unit_of.max()) + 1
    r_blocks = np.maximum(1, np.ceil(np.bincount(unit_of, size, units) * d / (2 * REGION_VALUES))).astype(int)
    n_queries = q.count()
    if not n_queries:
        return nearest_joined(queries, refs, k, by=group)
    asked = q.where(F.shiftrightunsigned(F.xxhash64(F.lit("drawn"), "query"), 11).cast("double") / F.lit(float(2**53)) <= SAMPLE_VALUES / 8 / d / n_queries).select("z").toArrow().combine_chunks()
    touched = np.zeros(units)
    if asked.num_rows:
        hit = np.zeros((asked.num_rows, units), bool)
        hit[np.arange(asked.num_rows)[:, None], unit_of[nearest_centres(_matrix(asked.column("z").combine_chunks()), probes)]] = True
        touched = hit.mean(0)
    q_blocks = np.maximum(1, np.ceil(n_queries * touched * d / (2 * REGION_VALUES))).astype(int)
    base = np.r_[0, np.cumsum(r_blocks * q_blocks)]
    width = max(tasks, int(base[-1]))
    key_of = _spread_keys(spark, int(base[-1]), width)

    def deal_refs(batches):
        for b in batches:
            if b.num_rows:
                cell = b.column("cell").to_numpy()
                at, j = unit_of[cell], b.column("h").to_numpy() % r_blocks[unit_of[cell]]
                row, i = _each(q_blocks[at])
                out = _dealt(key_of[base[at[row]] + i * r_blocks[at[row]] + j[row]], b, row, "ref", ("z", "g"))
                yield out.append_column("cell", pa.array(cell[row], pa.int32()))

    def deal_queries(batches):
        for b in batches:
            if b.num_rows:
                near, h = nearest_centres(_matrix(b.column("z")), probes), b.column("h").to_numpy()
                unit = unit_of[near]
                by = np.argsort(unit, 1, kind="stable")
                near, unit = np.take_along_axis(near, by, 1).ravel(), np.take_along_axis(unit, by, 1).ravel()
                row = np.repeat(np.arange(b.num_rows), probes)
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (unit[1:] != unit[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)], pa.int32()), pa.array(near, pa.int32()))
                row, at = row[starts], unit[starts]
                more, j = _each(r_blocks[at])
                row, at = row[more], at[more]
                out = _dealt(key_of[base[at] + h[row] % q_blocks[at] * r_blocks[at] + j], b, row, "query", ("z", "g"))
                yield out.append_column("cells", lists.take(pa.array(more)))

    wide = lambda name, more: f"key int, {name} {kinds[name]}, z array<double>, g long, {more}"
    given = r.mapInArrow(deal_refs, wide("ref", "cell int")).repartition(width, "key")
    sought = q.mapInArrow(deal_queries, wide("query", "cells array<int>")).repartition(width, "key")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return best.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        left = left.take(pa.compute.sort_indices(left, [("cell", "ascending"), ("ref", "ascending")]))
        cell, rg, rz = left.column("cell").to_numpy(), left.column("g").to_numpy(), _matrix(left.column("z").combine_chunks())
        first = np.searchsorted(cell, np.arange(len(centres) + 1))
        lists = right.column("cells").combine_chunks()
        z, qg = _matrix(right.column("z").combine_chunks()), right.column("g").to_numpy()
        row = np.repeat(np.arange(len(z)), pa.compute.list_value_length(lists).to_numpy())
        wanted = lists.flatten().to_numpy()
        by = np.argsort(wanted, kind="stable")
        row, wanted = row[by], wanted[by]
        cuts = np.flatnonzero(np.r_[True, wanted[1:] != wanted[:-1], True])
        rows, places, found = [], [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a, b = int(first[wanted[lo]]), int(first[wanted[lo] + 1])
            for at in range(lo, hi if b > a else lo, 1 + SLICE // max(1, b - a)):
                mine = row[at : min(hi, at + 1 + SLICE // (b - a))]
                distance = np.zeros((len(mine), b - a))
                for i in range(rz.shape[1]):
                    gap = z[mine, i, None] - rz[None, a:b, i]
                    distance += gap * gap
                if group:
                    distance[np.abs(qg[mine][:, None] - rg[None, a:b]) > band if band else qg[mine][:, None] != rg[None, a:b]] = np.inf
                column, value = smallest(distance, k)
                there = np.isfinite(value)
                rows.append(np.broadcast_to(mine[:, None], value.shape)[there])
                places.append(column[there] + a)
                found.append(value[there])
        if not rows:
            return best.empty_table()
        row, place, distance = np.concatenate(rows), np.concatenate(places), np.concatenate(found)
        turn = np.empty(len(cell), np.int64)
        turn[pa.compute.sort_indices(left.column("ref")).to_numpy()] = np.arange(len(cell))
        order = np.lexsort((turn[place], distance, row))
        row, place, distance = row[order], place[order], distance[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        names = right.column("query").combine_chunks(), left.column("ref").combine_chunks()
        return pa.table({"query": names[0].take(pa.array(row[kept])), "ref": names[1].take(pa.array(place[kept])), "distance": pa.array(distance[kept])}).cast(best)

    from pyspark.sql.pandas.types import to_arrow_type

    best = pa.schema([("query", to_arrow_type(queries.schema["query"].dataType)), ("ref", to_arrow_type(refs.schema["ref"].dataType)), ("distance", pa.float64())])
    found = sought.groupBy("key").cogroup(given.groupBy("key")).applyInArrow(lambda right, left: compare(left, right), f"query {kinds['query']}, ref {kinds['ref']}, distance double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "ref"))).where(F.col("rank") <= k)


def nearest_hashed(queries: DataFrame, refs: DataFrame, k: int, tables: int = 8, bucket: float | None = None, reach: float = 1e9, seed: int = 0, group: str | None = None) -> DataFrame:
    """Approximate: random projections in buckets; pairs that share a bucket in one of the tables are compared.

    Without ``bucket``, its width is the root mean square of the references' numbers, times three. With
    ``group`` only references of the query's group count. References are dealt once, by hash to blocks of
    about BLOCK_VALUES numbers, and queries to each block; buckets are made within a block, so no pair
    and no copy for a table is shuffled.
    """
    if bucket is None:
        square = F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)
        bucket = 3 * math.sqrt((refs.agg((F.sum(square) / F.sum(F.size("z"))).alias("v")).first()["v"]) or 1.0)
    shape = refs.agg(F.count("*").alias("n"), F.max(F.size("z")).alias("d")).first()
    d = shape["d"] or 1
    blocks = max(1, math.ceil(shape["n"] * d / BLOCK_VALUES))
    lines = np.random.default_rng(seed).normal(size=(d, tables))
    lines /= np.sqrt((lines * lines).sum(0))
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "ref": refs.schema["ref"].dataType.simpleString()}
    g = (F.xxhash64(group) if group else F.lit(0).cast("long")).alias("g")
    vector = F.col("z").cast("array<double>").alias("z")
    some = lambda df: df.where(F.col(group).isNotNull()) if group else df
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    r = some(refs).select(F.pmod(F.xxhash64(F.lit("block"), "ref"), F.lit(blocks)).cast("int").alias("key"), F.lit(0).alias("side"), none("query"), "ref", vector, g)
    q = some(queries).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("key"), F.lit(1).alias("side"), "query", none("ref"), vector, g)
    width = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    dealt = r.unionByName(q).repartition(width, "key").sortWithinPartitions("key", "side", "ref")

    def hashed(z: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        cells = np.floor(z @ lines / bucket).astype(np.int64)
        # Group and bucket as one key: of equal keys only those of both equal are compared.
        return [cells[:, t] * np.int64(1_000_003) ^ g for t in range(tables)]

    def compare(batches):
        key, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sides = batch.column("key").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (sides[1:] != sides[:-1])]).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                part = batch.slice(lo, hi - lo)
                if keys[lo] != key:
                    key, held, block = keys[lo], [], None
                z, g = _matrix(part.column("z")), part.column("g").to_numpy()
                if sides[lo] == 0:
                    held.append((z, g, part.column("ref")))
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    rz, rg = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    sorted_ = [(np.argsort(h, kind="stable"), h) for h in hashed(rz, rg)]
                    block = rz, rg, pa.concat_arrays([h[2] for h in held]), [(o, h[o]) for o, h in sorted_]
                    held = []
                rz, rg, names, cells = block
                asked = hashed(z, g)
                rows, places, found = [], [], []
                for i in range(len(z)):
                    hits = [o[np.searchsorted(h, a[i], "left") : np.searchsorted(h, a[i], "right")] for (o, h), a in zip(cells, asked, strict=True)]
                    mark = np.zeros(len(rz), bool)
                    for hit in hits:
                        mark[hit] = True
                    at = np.flatnonzero(mark & (rg == g[i]))
                    for lo_ in range(0, len(at), 1 + SLICE // d):
                        near = at[lo_ : lo_ + 1 + SLICE // d]
                        distance = ((rz[near] - z[i]) ** 2).sum(1)
                        keep = np.flatnonzero(distance <= reach * reach)
                        keep = keep[np.argsort(distance[keep], kind="stable")[:k]]
                        rows.append(np.full(len(keep), i))
                        places.append(near[keep])
                        found.append(distance[keep])
                if rows:
                    row, place = np.concatenate(rows), np.concatenate(places)
                    yield pa.record_batch([part.column("query").take(pa.array(row)), names.take(pa.array(place)), pa.array(np.concatenate(found))], names=["query", "ref", "distance"])

    pairs = dealt.mapInArrow(compare, f"query {kinds['query']}, ref {kinds['ref']}, distance double")
    w = Window.partitionBy("query").orderBy("distance", "ref")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(kind: str, queries: DataFrame, refs: DataFrame, k: int, group: str | None = None, nprobe: int | None = None, tables: int = 8, band: int = 0) -> DataFrame:
    """(query, ref, distance, rank) by the index of that kind: exact, cells or hashed; groups at most ``band`` away count."""
    if kind == "exact":
        return nearest_blocked(queries, refs, k, group, band=band)
    if kind == "cells":
        return nearest_in_cells(queries, refs, k, nprobe, group=group, band=band)
    if band:
        refs = banded(refs.withColumnRenamed(group, "depth"), band).drop("depth").withColumnRenamed("probe", group)
    if kind == "hashed":
        return nearest_hashed(queries, refs, k, tables, group=group)
    raise ValueError(f"no index {kind!r}: exact, cells or hashed")


def stratified(rows: DataFrame, key: str, fraction: float, seed: int = 0, by: str = "depth") -> DataFrame:
    """Of each depth, the rounded fraction of its rows, one at least, in the order of a hash of the key."""
    w = Window.partitionBy(by)
    order = w.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    n = F.greatest(F.lit(1), F.rint(F.lit(fraction) * F.count("*").over(w)))
    return rows.withColumn("__n", n).withColumn("__r", F.row_number().over(order)).where("__r <= __n").drop("__n", "__r")


def score_distribution(found: DataFrame, depths: DataFrame) -> DataFrame:
    """Per depth: n, median, p90, p99 and max of each query's nearest distance, and max over median."""
    d = found.where("rank = 1").join(depths, "query")
    q = lambda p: F.percentile("distance", F.lit(p))
    return d.groupBy("depth").agg(F.count("*").alias("n"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("distance").alias("max"))


def leaves_span(pairs: DataFrame, subspace: np.ndarray, threshold: float, query: str = "raw", ref: str = "ref_raw") -> Column:
    """Whether each row's difference of the arrays query and ref lies outside the corpus' span by more than the threshold."""

    @F.pandas_udf("boolean")
    def outside(q: pd.Series, r: pd.Series) -> pd.Series:
        if not len(q):
            return pd.Series([], dtype=bool)
        known = r.notna() & q.notna()
        out = pd.Series(False, index=q.index)
        if known.any():
            out[known] = off_manifold(np.stack(q[known].to_numpy()).astype(float), np.stack(r[known].to_numpy()).astype(float), subspace) > threshold
        return out

    return outside(query, ref)


def off_manifold(query: np.ndarray, ref: np.ndarray, subspace: np.ndarray) -> np.ndarray:
    """The share of the difference of raw vectors that lies outside the corpus' span."""
    d = query - ref
    size = np.linalg.norm(d, axis=-1)
    rest = np.linalg.norm(d - d @ subspace.T @ subspace, axis=-1)
    return np.where(size > 0, rest / np.where(size > 0, size, 1), 0.0)
