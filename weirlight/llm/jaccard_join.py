"""N-gram Jaccard self-join by chosen paths.

Texts are sets of hashed shingles. Sets that are equal are one node. A node's signature is ``SLOTS``
MinHash values; a value at a slot is a shared token, sampled with probability equal to the Jaccard
similarity. A path is a sequence of (slot, value); the slots that continue a path are chosen by a hash
of the path alone, each with probability 1 / (similarity x SLOTS) and one at least, so that a pair at
the sought similarity has on average more than one path in common at every depth: it keeps one for
ever with probability ``1 - lost_in_a_run(similarity)``, 0.54 at 0.8. Runs repeat this from other
roots, as many as ``target_recall`` takes (``runs_for``).

1. Nodes that share a path make a bucket. Buckets of ``SMALL`` nodes or fewer are compared whole, by
   signatures. In a larger one, each of a few pivots takes the nodes whose signature is near to its own:
   the near ones are in its component, and the very near ones leave the bucket, because by the triangle
   inequality of the distance of signatures all their partners are near to the pivot too. What stays
   is split by the tokens of the path's continuations, and so on, until all buckets are small. A bucket of
   ``TASK`` nodes or fewer is split to its end in one task; a larger one is split by one step on the
   cluster. A bucket whose nodes are in one component already has no more to find.
2. Components of the links found are candidate groups, and in each group every pair of sets is compared
   exactly, in blocks of bounded size, by counts of shared shingles. Links are pairs of at least the
   similarity; classes are the components of these.

So similarity is exact; candidates are found with the probability that ``target_recall`` states. Pairs
are compared and counted inside tasks, and never become rows.

Cases: null texts and texts without a word have no set: each is a class by itself, without links. Texts
of fewer than ``n`` words have one shingle, all their words. Texts are compared whole. Equal sets are in
one class; a class is named by the least doc_id in it (null ids count last). Repeated rows are rows of
their own. An empty table has no classes. Ids that are no whole numbers raise Spark's cast error.
Columns to keep are carried along in a struct, so they may have any names.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise, small_batches, working_tables
from ._words import mix, shingle_hashes, word_hashes
from .components import components

_U = np.uint64
SLOTS, SMALL, PIVOTS = 64, 200, 4
#: Nodes of a bucket that one task splits to the end; their signatures take 256 bytes each.
TASK = 50_000
#: Signatures that agree on this share of slots or more are a candidate link.
NEAR = 0.55
#: The share from which a node leaves a pivot's bucket. What is this near to a pivot has its partners
#: at a similarity of 0.7 or more to it, which is NEAR with a margin of 2.6 standard errors in each run.
VERY_NEAR = 0.90
#: Shingles in one side of a block of the exact comparison.
BLOCK = 1_000_000

_SPREAD = mix(np.arange(1, SLOTS + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SLOTS MinHash values of 32 bits."""
    least = np.full(SLOTS, np.iinfo(_U).max, _U)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(least, ((part[:, None] ^ (part[:, None] >> _U(29))) * _SPREAD).min(0), out=least)
    return (mix(least) >> _U(32)).astype(np.uint32)


def chosen_slots(paths: np.ndarray, similarity: float) -> np.ndarray:
    """Which slots continue each path: a row of booleans for each."""
    draw = mix(paths[:, None] + np.arange(1, SLOTS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    chosen = (draw >> _U(11)).astype(float) / 2.0**53 < 1 / (similarity * SLOTS)
    none = ~chosen.any(1)
    chosen[none, draw[none].argmin(1)] = True
    return chosen


def longer(paths: np.ndarray, signatures: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of each path's continuations by that row's signature."""
    row, slot = np.nonzero(chosen_slots(paths, similarity))
    return row, _step(paths[row], signatures[row, slot], slot)


def _step(paths: np.ndarray, values: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Paths with one more (slot, value) each."""
    return mix(paths ^ mix((values.astype(_U) << _U(8)) + slots.astype(_U) + _U(1)))


def lost_in_a_run(similarity: float) -> float:
    """The probability that a pair at the similarity has no path in common at some depth of a run.

    Each common path has k continuations, as chosen_slots draws them, and each of them is common with
    the similarity as probability: the least fixed point of this branching process.
    """
    p = 1 / (similarity * SLOTS)
    chance = [math.comb(SLOTS, k) * p**k * (1 - p) ** (SLOTS - k) for k in range(SLOTS + 1)]
    chance[1] += chance[0]
    lost = 0.0
    for _ in range(200):
        stays_lost = 1 - similarity + similarity * lost
        lost = sum(c * stays_lost**k for k, c in enumerate(chance) if k)
    return lost


def runs_for(target_recall: float, similarity: float) -> int:
    """How many runs miss a pair at the similarity with probability 1 - target_recall at most."""
    if not 0 < target_recall < 1:
        raise ValueError("target_recall is between 0 and 1")
    return max(1, math.ceil(math.log(1 - target_recall) / math.log(lost_in_a_run(similarity)) - 1e-9))


def _roots(similarity: float, runs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    starts = mix(np.arange(1, runs + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
    run, slot = np.nonzero(chosen_slots(starts, similarity))
    return starts[run], slot


def sketches(docs: DataFrame, id_col: str, text_col: str, keep: list[str], n: int, similarity: float, runs: int) -> DataFrame:
    """docs with a row number, the set's hash, size, signature and first paths, written to the shared folder."""
    starts, slots = _roots(similarity, runs)

    @F.pandas_udf("set_a long, set_b long, size int, sig binary, paths array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            s = np.unique(shingle_hashes(word_hashes(text), n))
            if not len(s):
                rows.append((None, None, 0, None, None))
                continue
            sig = signature(s)
            paths = _step(starts, sig[slots], slots)
            a, b = np.add.reduce(mix(s ^ _U(0x5851F42D4C957F2D))), np.bitwise_xor.reduce(mix(s + _U(0x14057B7EF767814F)))
            rows.append((int(a.view(np.int64)), int(b.view(np.int64)), len(s), sig.tobytes(), paths.view(np.int64)))
        a, b, size, sig, paths = zip(*rows, strict=True) if rows else ((),) * 5
        # Whole numbers with nulls among them, which must not pass through floats.
        return pd.DataFrame({"set_a": pd.array(a, "Int64"), "set_b": pd.array(b, "Int64"), "size": np.array(size, np.int32), "sig": list(sig), "paths": list(paths)})

    kept = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *kept)
    return materialise(rows.withColumn("s", sketched("text")).select(F.monotonically_increasing_id().alias("uid"), "id", "text", "s.*", *(["kept"] if keep else [])), "sketches")


def likely_in(table: DataFrame, few: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of table whose uid may be among those of few: a filter before a join that would shuffle all texts.

    One bit for each hash of a uid, in words of 64: at most 2**(bits - 6) rows of two numbers, which is
    why they can be sent to all executors. With far more uids than bits it lets all rows through.
    """
    h = F.pmod(F.xxhash64("uid"), F.lit(1 << bits))
    word, bit = F.shiftright(h, 6), h.bitwiseAND(F.lit(63)).cast("int")
    mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(uid), {1 << bits}L) & 63L as int))")
    words = few.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return table.withColumn("word", word).join(F.broadcast(words), "word").where(F.getbit("mask", bit) == 1).drop("word", "mask")


def _labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the pairs (left, right)."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def _stars(uids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    moved = label != np.arange(len(label))
    return pd.DataFrame({"a": uids[moved], "b": uids[label[moved]]})


def _by_key(batches, keys: list[str]):
    """Frames of whole keys from batches sorted by them: many keys at a time, none of them cut."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        last = np.logical_and.reduce([batch[k].to_numpy() == batch[k].iloc[-1] for k in keys])
        same = not held or all(held[-1][k].iloc[-1] == batch[k].iloc[0] for k in keys)
        if last.all() and same:
            held.append(batch)
            continue
        yield pd.concat([*held, batch[~last]]) if held else batch[~last]
        held = [batch[last]]
    if held:
        yield pd.concat(held)


def _buckets(similarity: float):
    """A kernel: star links of whole buckets, (path, uid, sig) in the order of path."""

    def kernel(batches):
        for frame in _by_key(batches, ["path"]):
            if not len(frame):
                continue
            path, uid = frame["path"].to_numpy(), frame["uid"].to_numpy()
            sig = np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(-1, SLOTS)
            at = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            size = np.diff(np.r_[at, len(path)])
            # Small buckets, those of equal size at a time.
            lefts, rights = [], []
            for c in np.unique(size[(size > 1) & (size <= SMALL)]):
                i, j = np.triu_indices(c, 1)
                own = at[size == c]
                for lo in range(0, len(own), max(1, 60_000 // len(i))):
                    part = own[lo : lo + max(1, 60_000 // len(i)), None]
                    left, right = (part + i).ravel(), (part + j).ravel()
                    near = _agree(sig[left], sig[right]) >= NEAR
                    lefts.append(left[near])
                    rights.append(right[near])
            if lefts:
                yield _stars(uid, _labels(len(uid), np.concatenate(lefts), np.concatenate(rights))).drop_duplicates()
            for lo, n in zip(at[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                rows = slice(lo, lo + n)
                yield _stars(uid[rows], split_to_the_end(uid[rows], sig[rows], path[lo].view(_U), similarity))

    return kernel


def split_to_the_end(uids: np.ndarray, sigs: np.ndarray, path: np.uint64, similarity: float) -> np.ndarray:
    """Of each node of a bucket, the least node of its component: the bucket is split by longer paths until all are small."""
    root = np.arange(len(uids))

    def roots(rows: np.ndarray) -> np.ndarray:
        r = root[rows]
        while (up := root[r]).tolist() != r.tolist():
            r = up
        root[rows] = r
        return r

    def join(rows: np.ndarray) -> None:
        r = np.unique(roots(rows))
        root[r] = r[0]

    pending = [(path, np.arange(len(uids)))]
    while pending:
        path, rows = pending.pop()
        r = roots(rows)
        if (r == r[0]).all():
            continue
        sig = sigs[rows]
        if len(rows) <= SMALL:
            i, j = np.nonzero(np.triu(_agree(sig[:, None], sig[None]) >= NEAR, 1))
            label = _labels(len(rows), i, j)
            for first in np.unique(label[label != np.arange(len(rows))]):
                join(rows[label == first])
            continue
        draw = mix(uids[rows].view(_U) ^ path)
        stay = np.ones(len(rows), bool)
        for p in np.argsort(draw, kind="stable")[:PIVOTS]:
            share = _agree(sig, sig[p])
            join(rows[share >= NEAR])
            stay &= share < VERY_NEAR
        rows, sig = rows[stay], sig[stay]
        for slot in np.flatnonzero(chosen_slots(np.array([path], _U), similarity)[0]):
            value = sig[:, slot]
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(value[order]) != 0, True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    pending.append((_step(np.array([path], _U), value[order[lo : lo + 1]], np.array([slot]))[0], rows[order[lo:hi]]))
    return roots(np.arange(len(uids)))


def candidate_links(nodes: DataFrame, similarity: float) -> list[DataFrame]:
    """Tables of (a, b): star links whose components hold every pair at the similarity that the runs find."""
    spark = nodes.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sigs = nodes.select("uid", "sig")
    rows = nodes.select("uid", F.explode("paths").alias("path"))
    found = []
    for depth in itertools.count():
        counts = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        live = materialise(rows.join(counts, "path").join(sigs, "uid"), "buckets")
        ordered = live.where(F.col("n") <= TASK).select("path", "uid", "sig").repartition(width, "path").sortWithinPartitions("path")
        found.append(materialise(ordered.mapInPandas(_buckets(similarity), "a long, b long"), "near"))
        large = live.where(F.col("n") > TASK)
        if large.isEmpty():
            return found
        # Pivots: the nodes of least hash in each large bucket; there are few buckets for many rows.
        draw = F.struct(F.xxhash64("uid", F.lit(depth)).alias("draw"), "uid", "sig")
        pivots = large.groupBy("path").agg(*[F.min(F.when(F.pmod(F.xxhash64("uid"), F.lit(PIVOTS)) == k, draw)).alias(f"p{k}") for k in range(PIVOTS)])
        pivots = pivots.select("path", F.filter(F.array(*[f"p{k}" for k in range(PIVOTS)]), lambda p: p.isNotNull()).alias("pivots"))
        pivots = pivots.select("path", F.col("pivots.uid").alias("pivot_uids"), F.col("pivots.sig").alias("pivot_sigs"))

        def peeled(batches):
            for b in batches:
                if not len(b):
                    continue
                sig = np.frombuffer(b"".join(b["sig"]), np.uint32).reshape(-1, SLOTS)
                uid, path = b["uid"].to_numpy(), b["path"].to_numpy().view(_U)
                count = np.array([len(x) for x in b["pivot_uids"]])
                row = np.repeat(np.arange(len(b)), count)
                name = np.concatenate([np.asarray(x, np.int64) for x in b["pivot_uids"]])
                share = _agree(sig[row], np.frombuffer(b"".join(x for values in b["pivot_sigs"] for x in values), np.uint32).reshape(-1, SLOTS))
                # A node has a link to its first near pivot; pivots that a node is near to are linked once.
                near = np.flatnonzero(share >= NEAR)
                at, first = np.unique(row[near], return_index=True)
                anchor = np.zeros(len(b), np.int64)
                anchor[at] = name[near[first]]
                links = np.unique(np.r_[np.c_[uid[at], anchor[at]], np.c_[anchor[row[near]], name[near]]], axis=0)
                links = links[links[:, 0] != links[:, 1]]
                stay = np.ones(len(b), bool)
                stay[row[share >= VERY_NEAR]] = False
                kept, onward = longer(path[stay], sig[stay], similarity)
                yield pd.DataFrame({"kind": 0, "x": links[:, 0], "y": links[:, 1]})
                yield pd.DataFrame({"kind": 1, "x": uid[stay][kept], "y": onward.view(np.int64)})

        # Rows of a node stand together, so that a link that several of its paths find is made once.
        met = large.join(pivots, "path").select("path", "uid", "sig", "pivot_uids", "pivot_sigs")
        met = met.repartition(width, "uid").sortWithinPartitions("uid")
        seen = materialise(met.mapInPandas(peeled, "kind int, x long, y long"), "peeled")
        found.append(seen.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
        rows = seen.where("kind = 1").select(F.col("x").alias("uid"), F.col("y").alias("path"))


def _in_blocks(rows: DataFrame, key: str, k: str) -> DataFrame:
    """Rows of a key in k blocks, each in every pair of blocks that has it: columns key, lo, hi, ... in sorted partitions."""
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col(k).cast("long") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))
    paired = rows.withColumn("pair", F.explode(others)).select(key, "pair.lo", "pair.hi", *[c for c in rows.columns if c != key])
    spark = rows.sparkSession
    return paired.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of intersections of all pairs of sorted sets, by products of blocks of columns."""
    size = [len(s) for s in sets]
    row = np.repeat(np.arange(len(sets)), size)
    token, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column, width = row[common], number[column[common]], int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    step = max(256, 8_000_000 // max(1, len(sets)))
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        x = np.zeros((len(sets), min(step, width - at)), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        shared += x @ x.T
    return shared


def exact_links(uids: np.ndarray, sets: list[np.ndarray], first: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(least uid reached, links) of each node of a block pair. first: rows of the one block; all are if there is one."""
    size = np.array([len(s) for s in sets], np.float64)
    linked = np.zeros((len(sets), len(sets)), bool)
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        linked[0, 1] = linked[1, 0] = both >= similarity * (size.sum() - both) - 1e-9
    else:
        both = shared_counts(sets)
        linked = both >= similarity * (size[:, None] + size[None] - both) - 1e-6
    np.fill_diagonal(linked, False)
    if not first.all():
        linked &= first[:, None] != first[None]
    i, j = np.nonzero(linked)
    return uids[_labels(len(uids), i, j)], linked.sum(1)


def verified(groups: DataFrame, n: int, similarity: float) -> DataFrame:
    """(uid, root, links, k) from (component, uid, text, block, k): k blocks make up the component."""

    def compare(batches):
        for frame in _by_key(batches, ["component", "lo", "hi"]):
            out = []
            for (_, lo, hi), b in frame.groupby(["component", "lo", "hi"], sort=False):
                b = b.sort_values("uid")
                uids = b["uid"].to_numpy()
                sets = [np.unique(shingle_hashes(word_hashes(t), n)) for t in b["text"]]
                root, links = exact_links(uids, sets, (b["block"] == lo).to_numpy(), similarity)
                out.append(pd.DataFrame({"uid": uids, "root": root, "links": links, "k": b["k"].to_numpy()}))
            if out:
                yield pd.concat(out)

    return _in_blocks(groups, "component", "k").mapInPandas(compare, "uid long, root long, links long, k long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), n: int = 5, similarity: float = 0.8, target_recall: float = 0.99999) -> DataFrame:
    """One row for each row of docs: (id, class_id, n_links, first_of_class), and the columns to keep as the struct ``kept``.

    n_links is the number of other sets of shingles at the similarity or more; copies of one set count
    once. first_of_class marks one row of each class. A pair at the similarity is found as a candidate
    with a probability of target_recall at least, and a pair above it with a higher one.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    # The text is carried once.
    carried = [c for c in keep if c != text_col]
    table = sketches(docs, id_col, text_col, carried, n, similarity, runs_for(target_recall, similarity))
    with working_tables() as mine:
        classes = _classes(table, n, similarity)
    # The result reads the sketches and the classes only.
    discard(spark, *[path for path in mine if path != classes.weirlight_path])
    in_class = table.where("size > 0").join(classes, ["set_a", "set_b"])
    kept = [F.struct(*[(F.col("text") if c == text_col else F.col(f"kept.`{c}`")).alias(c) for c in keep]).alias("kept")] if keep else []
    own = F.col("id").alias(id_col)
    some = in_class.select(own, F.col("head.id").alias("class_id"), F.col("links").cast("long").alias("n_links"), (F.col("uid") == F.col("head.uid")).alias("first_of_class"), *kept)
    alone = table.where("size = 0").select(own, F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first_of_class"), *kept)
    return some.unionByName(alone)


def _classes(table: DataFrame, n: int, similarity: float) -> DataFrame:
    """(set_a, set_b, links, head) of every set of the sketches."""
    # One node for each set: its least row number; the first row by id names it.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid"))
    sets = materialise(table.where("size > 0").groupBy("set_a", "set_b").agg(F.min("uid").alias("uid"), first.alias("first")), "sets")
    nodes = materialise(table.select("uid", "sig", "paths").join(sets.select("uid"), "uid"), "nodes")
    links = candidate_links(nodes, similarity)
    together = links[0]
    for more in links[1:]:
        together = together.unionByName(more)
    groups = materialise(components(together).withColumnsRenamed({"node": "uid"}), "groups")
    texts = likely_in(table.select("uid", "text", "size"), groups).join(groups, "uid").select("uid", "component", "text", "size")
    texts = materialise(texts, "group-texts")
    blocks = texts.groupBy("component").agg(F.greatest(F.ceil(F.sum("size") / BLOCK), F.ceil(F.count("*") / 2000)).cast("long").alias("k"))
    dealt = texts.join(blocks, "component").select("component", "uid", "text", "k").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("k")))
    seen = materialise(verified(dealt, n, similarity), "verified")
    across = components(seen.where("k > 1").select(F.col("uid").alias("a"), F.col("root").alias("b")))
    roots = seen.groupBy("uid").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    roots = roots.join(across.select(F.col("node").alias("uid"), "component"), "uid", "left").select("uid", F.coalesce("component", "root").alias("root"), "links")
    named = sets.join(roots, "uid", "left").select("set_a", "set_b", "first", F.coalesce("root", "uid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    return materialise(named.join(heads, "root").select("set_a", "set_b", "links", "head"), "classes")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) END)) AS s
  FROM words WHERE len(w) > 0),
sets AS (SELECT min(doc_id) AS node, s, len(s) AS size FROM shingles GROUP BY s),
parts AS (SELECT node, size, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM parts a JOIN parts b ON a.g = b.g AND a.node <> b.node
  AND a.size >= 0.8 * b.size AND b.size >= 0.8 * a.size
  GROUP BY a.node, b.node, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
reach AS (
  SELECT node AS start, node FROM sets UNION SELECT r.start, p.b FROM reach r JOIN pairs p ON p.a = r.node),
classes AS (SELECT node, class_id FROM (SELECT start AS node, min(node) AS class_id FROM reach GROUP BY start)),
links AS (SELECT a AS node, count(*) AS n FROM pairs GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN shingles h USING (doc_id) LEFT JOIN sets s ON s.s = h.s
LEFT JOIN classes c USING (node) LEFT JOIN links l USING (node)
"""
