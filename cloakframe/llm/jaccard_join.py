"""N-gram Jaccard self-join by chosen paths, and near-duplicate grouping on top of it.

A document is the set of its word n-grams. In each run sets are split recursively: at a node ``BRANCHES``
tokens are sampled (the minimum of a random order over the set, so two sets draw the same token
with probability equal to their Jaccard similarity), and the sets that drew the same token form a
child node. A node of at most ``SMALL`` sets is compared pair by pair, and so is one that splitting
wouldn't make cheaper: if the squares of its children's sizes add up to its own square or more, as they do
among near copies of one text. Other nodes split again, to ``DEPTH`` levels, after which even a large node
is compared completely. Large comparisons are done in tiles. Every branch of every level of every run draws
by an order of its own, so what a pair meets with on one level or in one run tells nothing of the others; the
nodes of a level share its orders. A pair at the threshold so gets down to the last level of a run
with probability (1 - (1 - threshold) ^ BRANCHES) ^ DEPTH at least, and the runs are
repeated (``runs``) until the chance to miss it in all of them is under ``1 - recall``. Orders are made for as many
runs as a threshold needs, without a bound.

The comparison in a node uses signatures, dropping pairs 3 standard errors under the threshold, and pairs
that an earlier node of the first level has compared already. The
rest are verified exactly: connected candidates share a verification group, so that a text is
shipped once, and only the texts of candidates are shipped at all. Equal sets are one set from the
start, found by a 128-bit digest of the sorted set, so groups of copies cost nothing to search, and links are counted
by set, never expanded into pairs of rows.

Nodes of more than ``CROWD`` sets that would be compared completely aren't: sets that such nodes connect are a crowd, all pairs
of which are verified exactly and at once, in tiles whose overlaps come from matrix products. A tile gives the number of links of
each of its sets and what connects them, so that a crowd's pairs are never rows. A crowd that nodes string together so loosely
that it has more pairs than they (the square of its size against the sum of theirs) is compared node by node instead.

What grows faster than the input is the comparison of different texts that are all similar to each other: k of them have
k * (k - 1) / 2 links, each of which is counted.

Defined cases: null texts and texts without words have no links; a text of fewer than n words is
one shingle; repeated rows are similar to each other by 1; rows without links are classes of their own; a class bears the
least ``doc_id``, and a null one only if it has no other; a null ``doc_id`` is kept as null; an empty table gives an empty
one; texts of any length are read whole; extra columns, whatever their names, are ignored by the join and kept by the filter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, drop_tables, each, groups, shingles, small_enough, with_row_id, without_rows, write_table

NGRAM = 3
THRESHOLD = 0.5
RECALL = 0.99
#: Coordinates of a signature at least; it has as many as the draws of all runs need.
COORDINATES = 64
BRANCHES = 3
SMALL = 64
DEPTH = 3
#: Sets in a tile of a node that stayed large, of a verification group and of a crowd, and characters in one of a crowd.
TILE = 2048
TILE_CHARS = 16_000_000
#: Nodes of more sets than these that are compared completely make crowds.
CROWD = 256


def runs(threshold: float, recall: float, branches: int = BRANCHES, depth: int = DEPTH) -> int:
    """Repetitions after which a pair at the threshold is found with probability ``recall``, even
    if all its nodes are large down to the last level."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("the threshold must lie in (0, 1], the recall in (0, 1)")
    q = (1 - (1 - threshold) ** branches) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-q) - 1e-9)) if q < 1 else 1


class Plan:
    """The coordinates of a signature: those of the first level of all runs, then those of the deeper levels, run by run."""

    def __init__(self, threshold: float, recall: float) -> None:
        self.runs = runs(threshold, recall)
        self.first = self.runs * BRANCHES
        self.size = max(COORDINATES, self.first * DEPTH)
        #: Coordinates of the first level that are packed whole, to tell pairs that have met.
        self.heads = min(62, self.first)
        rng = np.random.default_rng(20240607)
        self.muls, self.adds = (rng.integers(1, 1 << 32, self.size, dtype=np.uint64).astype(np.uint32) for _ in range(2))
        self.muls |= np.uint32(1)
        self.least = math.ceil(self.size * max(0.0, threshold - 3 * math.sqrt(threshold * (1 - threshold) / self.size)))

    def deeper(self, level: int, branch: int) -> str:
        """SQL for the coordinate that a branch draws by on a level from 1 on, counted from 1; ``run`` is the node's run."""
        return f"{self.first} + (run * {DEPTH - 1} + {level - 1}) * {BRANCHES} + {branch + 1}"

    def signature(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 4096):  # a piece stays in the processor's cache
            y = x[None, k : k + 4096] * self.muls[:, None]
            y ^= y >> np.uint32(15)
            y += self.adds[:, None]
            y *= np.uint32(0x85EBCA6B)
            np.minimum(out, y.min(axis=1), out=out)
        return out

    def packed(self, sig: np.ndarray) -> bytes:
        return sig[: self.heads].tobytes() + sig.astype(np.uint8).tobytes()


def _sketch(n: int, plan: Plan):
    def sketch(batches):
        cache = WordHashes()
        for b in batches:
            rid, fp, sig = [], [], []
            for r, text in zip(b.column(0).to_pylist(), each(b.column(1))):
                s = shingles(text, n, cache)
                if len(s):
                    s = np.unique(s)
                    rid.append(r)
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(plan.signature(s))
            values = np.concatenate(sig).view(np.int32) if sig else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid, pa.int64()),
                    pa.array(fp, pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, len(values) + 1, plan.size, dtype=np.int32), pa.array(values)),
                    pa.array([plan.packed(x) for x in sig], pa.binary()),
                ],
                ["rid", "fp", "sig", "pack"],
            )

    return sketch


def _compare(plan: Plan):
    """Pairs within each node whose signatures agree in ``plan.least`` coordinates. Rows are (node, side, rid, first, leaves, crowd, pack);
    side 1 and 2 are compared across only, side 0 with all of its node; ``first`` is the node's number on the
    first level or -1, ``leaves`` has the bits of the row's nodes on the first level that are compared. Pairs of one ``crowd`` (-1: none) are left out."""
    heads_n, least = plan.heads, plan.least

    def compare(batches):
        for t in groups(batches, "node"):
            node, side, rid, first, leaves, crowd = (t.column(c).to_numpy() for c in ("node", "side", "rid", "first", "leaves", "crowd"))
            pack = np.frombuffer(b"".join(t.column("pack").to_pylist()), np.uint8).reshape(len(node), -1)
            heads, sig = np.ascontiguousarray(pack[:, : 4 * heads_n]).view(np.uint32), np.ascontiguousarray(pack[:, 4 * heads_n :])
            before = (np.int64(1) << np.where((first < 0) | (first > heads_n), heads_n, first)) - 1
            n, found = len(node), []
            idx = np.arange(n)
            for d in range(1, n):
                idx = idx[: np.searchsorted(idx, n - d)]
                idx = idx[node[idx] == node[idx + d]]
                if not len(idx):
                    break
                i = idx[((side[idx] == 0) | (side[idx] != side[idx + d])) & ((crowd[idx] < 0) | (crowd[idx] != crowd[idx + d]))]
                for k in range(0, len(i), 65536):
                    a = i[k : k + 65536]
                    a = a[np.count_nonzero(sig[a] == sig[a + d], axis=1) >= least]
                    if len(a):
                        met = (heads[a] == heads[a + d]) @ (np.int64(1) << np.arange(heads_n))
                        a = a[(met & leaves[a] & before[a]) == 0]
                        found.append(np.stack([rid[a], rid[a + d]]))
            if found:
                ab = np.concatenate(found, axis=1)
                ab.sort(axis=0)
                ab = np.unique(ab[:, ab[0] != ab[1]], axis=1)
                for k in range(0, ab.shape[1], 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(ab[0, k : k + 100_000]), pa.array(ab[1, k : k + 100_000])], ["a", "b"])

    return compare


def _crowds(leaves: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(rid, crowd) of the rows in crowds, and (node) of the nodes that they were made of, both written; None if there are none.
    ``leaves`` are rows (node, rid, n) in nodes that are to be compared."""
    big = write_table(leaves.filter(F.col("n") > CROWD).select("node", "rid", "n"))
    if big.isEmpty():
        drop_tables(big)
        return None
    heads = write_table(big.groupBy("node").agg(F.min("rid").alias("head"), F.first("n").alias("n")))
    roots = components(big.join(heads.select("node", "head"), "node").select(F.col("rid").alias("a"), F.col("head").alias("b")))
    size = roots.groupBy("root").agg(F.count("*").alias("m"))
    placed = write_table(heads.join(roots.withColumnRenamed("rid", "head"), "head").select("node", "root", "n"))
    tight = placed.groupBy("root").agg(F.sum(F.col("n") * F.col("n")).alias("squares")).join(size, "root").filter("m * m <= squares").select("root")
    tight = write_table(tight)
    rows = write_table(roots.join(tight, "root").select("rid", F.col("root").alias("crowd")))
    nodes = write_table(placed.join(tight, "root").select("node"))
    drop_tables(big, heads, roots, placed, tight)
    return rows, nodes


def _candidates(sets: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs (a, b) of rows of ``sets`` (rid, sig, pack) that meet in a leaf and whose signatures are near enough, without
    pairs within a crowd; the crowds' rows (rid, crowd), None if there are none."""
    start = F.expr(f"posexplode(slice(sig, 1, {plan.first}))").alias("first", "token")
    rows = write_table(sets.select("rid", start).select("rid", F.xxhash64("first", "token").alias("node"), "first", F.expr(f"first div {BRANCHES}").cast("int").alias("run")))
    sizes = write_table(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
    leaves, written = [], [rows, sizes]

    def leaf(which: DataFrame) -> None:
        leaves.append(write_table(rows.join(which, "node").select("node", "rid", "first", "n")))

    for level in range(1, DEPTH + 1):
        large = sizes.filter(F.col("n") > SMALL)
        if level == DEPTH or large.isEmpty():
            leaf(sizes)
            break
        leaf(sizes.filter(F.col("n") <= SMALL))
        kid = lambda j: F.expr(f"xxhash64(node, {j}, element_at(sig, {plan.deeper(level, j)}))")  # noqa: B023, E731
        split = rows.join(large, "node").join(sets.select("rid", "sig"), "rid")
        split = write_table(split.select("rid", "run", F.col("node").alias("parent"), "n", F.explode(F.array(*map(kid, range(BRANCHES)))).alias("node")))
        kids = write_table(split.groupBy("parent", "n", "node").agg(F.count("*").alias("c")))
        dense = write_table(kids.groupBy("parent", "n").agg(F.sum(F.col("c") * F.col("c")).alias("squares")).filter("squares >= n * n").select(F.col("parent").alias("node"), "n"))
        written += [split, kids, dense]
        leaf(dense)
        gone = dense.select(F.col("node").alias("parent"))
        rows = write_table(split.join(gone, "parent", "left_anti").select("rid", "node", F.lit(-1).alias("first"), "run"))
        sizes = write_table(kids.filter("c > 1").join(gone, "parent", "left_anti").select("node", F.col("c").alias("n")))
        written += [rows, sizes]
    all_leaves = leaves[0]
    for x in leaves[1:]:
        all_leaves = all_leaves.unionByName(x)
    crowds = _crowds(all_leaves)
    if crowds:
        crowd, nodes = crowds
        all_leaves = all_leaves.join(nodes, "node", "left_anti")
        written.append(nodes)
    # A node that stayed large becomes tiles: (i, i) compares a tile with itself, (i, j) two tiles with each other.
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("rid"), tiles).cast("int")
    tiled = (
        all_leaves.filter(F.col("n") > TILE)
        .select("rid", "first", "node", mine.alias("i"), tiles.alias("m"))
        .select("rid", "first", "node", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
        .select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"), "first", "rid")
    )
    met = all_leaves.filter(F.col("n") <= TILE).select("node", F.lit(0).alias("side"), "first", "rid").unionByName(tiled)
    # All places of a row travel together to its signature, which is read once and then copied to each.
    bit = F.when((F.col("first") >= 0) & (F.col("first") < plan.heads), F.expr("shiftleft(1L, first)")).otherwise(F.lit(0).cast("long"))
    places = met.groupBy("rid").agg(F.collect_list(F.struct("node", "side", "first")).alias("at"), F.bit_or(bit).alias("leaves"))
    packs = sets.select("rid", "pack")
    packs = packs.join(crowd, "rid", "left") if crowds else packs.withColumn("crowd", F.lit(-1).cast("long"))
    pairs = (
        places.join(packs, "rid")
        .select(F.explode("at").alias("at"), "rid", "leaves", F.coalesce("crowd", F.lit(-1).cast("long")).alias("crowd"), "pack")
        .select("at.node", "at.side", "rid", "at.first", "leaves", "crowd", "pack")
        .repartition("node")
        .sortWithinPartitions("node")
        .mapInArrow(_compare(plan), "a long, b long")
        .distinct()
    )
    out = write_table(pairs)
    drop_tables(*written, *leaves)
    return out, crowd if crowds else None


def components(edges: DataFrame) -> DataFrame:
    """(rid, root) for the rows in ``edges`` (a, b), as a written table; root is the least rid that is connected.

    Each round gives every row the least root among its neighbours', then follows roots of roots,
    so paths shorten by half; it ends when no root changes.
    """
    both = write_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    roots = write_table(both.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("rid", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots.rid == near.a).select("rid", "root", F.least("root", "near").alias("new"))
        hop = roots.select(F.col("rid").alias("new"), F.col("root").alias("hop"))
        nxt = write_table(step.join(hop, "new", "left").select("rid", F.col("root").alias("old"), F.least("new", F.coalesce("hop", "new")).alias("root")))
        drop_tables(roots)
        roots = nxt.select("rid", "root")
        roots._scratch = nxt._scratch
        if nxt.filter("old <> root").isEmpty():
            drop_tables(both)
            return roots


def _verify(n: int, threshold: float):
    def verify(batches):
        cache, sets, now = WordHashes(), {}, None
        for b in batches:
            out = []
            for block, a, c, text in zip(*(each(b.column(i)) for i in range(4))):
                if block != now:
                    sets, now = {}, block
                if c is None:
                    if a not in sets:
                        sets[a] = np.unique(shingles(text, n, cache))
                else:
                    x, y = sets[a], sets[c]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    j = both / (len(x) + len(y) - both)
                    if j >= threshold:
                        out.append((a, c, j))
            a, c, j = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(j, pa.float64())], ["a", "b", "jaccard"])

    return verify


#: Columns of a matrix of sets by shingles, and overlaps that are added one by one, at a time.
_COLUMNS, _ADDED = 512, 1 << 21


def _overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of ``xs`` with each of ``ys``. Shingles that many sets have are columns of matrices,
    whose products are added up; the pairs of sets that share another are counted one by one."""
    nx, ny = len(xs), len(ys)
    rx, ry = (np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (xs, ys))
    values, col = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    cx, cy = col[: len(rx)], col[len(rx) :]
    dx, dy = (np.bincount(c, minlength=len(values)) for c in (cx, cy))
    out = np.zeros((nx, ny), np.int32)
    many = dx * dy * 512 > nx * ny
    place = np.cumsum(many) - 1
    total = int(many.sum())
    (rx1, px), (ry1, py) = ((r[m], place[c[m]]) for r, c, m in ((rx, cx, many[cx]), (ry, cy, many[cy])))
    ox, oy = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    rx1, px, ry1, py = rx1[ox], px[ox], ry1[oy], py[oy]
    for k in range(0, total, _COLUMNS):
        a, b = np.zeros((nx, _COLUMNS), np.float32), np.zeros((ny, _COLUMNS), np.float32)
        for m, r, p in ((a, rx1, px), (b, ry1, py)):
            lo, hi = np.searchsorted(p, [k, k + _COLUMNS])
            m[r[lo:hi], p[lo:hi] - k] = 1
        out += (a @ b.T).astype(np.int32)
    few = ~many[cx] & (dy[cx] > 0)
    rx, cx = rx[few], cx[few]
    ry = ry[np.argsort(cy, kind="stable")]
    first, times = np.cumsum(dy) - dy, dy[cx]
    ends = np.cumsum(times)
    lo = 0
    while lo < len(rx):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _ADDED)))
        t = times[lo:hi]
        within = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        flat = np.repeat(rx[lo:hi], t) * ny + ry[np.repeat(first[cx[lo:hi]], t) + within]
        out += np.bincount(flat, minlength=nx * ny).reshape(nx, ny)
        lo = hi
    return out


def _parts(hits: np.ndarray) -> np.ndarray:
    """The least row number that each row and then each column of a matrix is connected with; its own for those without hits."""
    nx, ny = hits.shape
    rows, columns = np.arange(nx), nx + np.arange(ny)
    fresh, back = np.ones(nx, bool), np.ascontiguousarray(hits.T)
    new = hits.any(axis=0)
    for seed in np.flatnonzero(hits.any(axis=1)):
        if not fresh[seed]:
            continue
        fresh[seed], at = False, np.array([seed])
        while len(at):
            reached = np.flatnonzero(hits[at].any(axis=0) & new)
            new[reached] = False
            columns[reached] = seed
            at = np.flatnonzero(back[reached].any(axis=0) & fresh)
            fresh[at] = False
            rows[at] = seed
    return np.concatenate([rows, columns])


def _whole(n: int, threshold: float, listed: bool):
    """All pairs of the blocks of a crowd, exactly. Rows are (block, side, rid, weight, text), sides as in ``_compare``. Gives pairs (a, b,
    jaccard) if ``listed``, else for each row with links (a, b, links): a row that it is connected with, itself or one before it, and the weights of the
    rows that are similar to it."""

    def block(side, rid, weight, sets):
        side, rid, weight = np.array(side), np.array(rid, np.int64), np.array(weight, np.int64)
        one = not side.any()
        x, y = (np.arange(len(rid)),) * 2 if one else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        if not len(x) or not len(y):
            return
        x, y = x[np.argsort(rid[x])], y[np.argsort(rid[y])]
        both = _overlaps([sets[i] for i in x], [sets[i] for i in y])
        size = np.array([len(s) for s in sets])
        hits, links = np.zeros(both.shape, bool), np.zeros(len(rid), np.int64)
        for k in range(0, len(x), 256):
            j = both[k : k + 256] / (size[x[k : k + 256], None] + size[y] - both[k : k + 256])
            h = j >= threshold
            if one:
                h[np.arange(len(h)), np.arange(k, k + len(h))] = False
            if listed:
                a, b = np.nonzero(h & (np.arange(k, k + len(h))[:, None] < np.arange(len(y))) if one else h)
                ends = np.sort(np.stack([rid[x[k + a]], rid[y[b]]]), axis=0)
                yield ends[0], ends[1], j[a, b]
            hits[k : k + 256] = h
        if listed:
            return
        links[x] += hits @ weight[y]
        if not one:
            links[y] += hits.T @ weight[x]
        ends, part = np.concatenate([x, y]), _parts(hits)
        least = np.full(len(ends), np.iinfo(np.int64).max)
        np.minimum.at(least, part, rid[ends])
        root = np.full(len(rid), np.iinfo(np.int64).max)
        np.minimum.at(root, ends, least[part])
        some = np.flatnonzero(links)
        yield rid[some], root[some], links[some]

    def whole(batches):
        cache, now, held = WordHashes(), None, ([], [], [], [])

        def flush():
            for a, b, v in block(*held) if held[0] else ():
                for k in range(0, len(a), 100_000):
                    s = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), pa.array(v[s])], ["a", "b", "jaccard" if listed else "links"])

        for b in batches:
            for key, side, rid, weight, text in zip(*(each(b.column(i)) for i in range(5))):
                if key != now:
                    yield from flush()
                    now, held = key, ([], [], [], [])
                for of, v in zip(held, (side, rid, weight, np.unique(shingles(text, n, cache)))):
                    of.append(v)
        yield from flush()

    return whole


def _verified_crowds(texts: DataFrame, members: DataFrame, crowd: DataFrame, n: int, threshold: float, listed: bool) -> DataFrame:
    """What ``_whole`` gives of all crowds (rid, crowd), written."""
    weights = members.join(crowd.withColumnRenamed("rid", "rep"), "rep").groupBy("rep", "crowd").agg(F.count("*").alias("weight")).withColumnRenamed("rep", "rid")
    side = write_table(weights)
    small = F.broadcast(side) if small_enough(side, 32) else side
    held = write_table(texts.join(small, "rid"))
    tiles = held.groupBy("crowd").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.length("text")) / TILE_CHARS)).cast("int").alias("m"))
    placed = held.join(F.broadcast(tiles) if small_enough(side, 24) else tiles, "crowd").withColumn("i", F.pmod(F.xxhash64("rid"), "m").cast("int"))
    blocks = (
        placed.select("rid", "crowd", "weight", "text", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
        .select(
            F.xxhash64("crowd", F.least("i", "j"), F.greatest("i", "j")).alias("block"), F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"), "rid", "weight", "text"
        )
        .repartition("block")
        .sortWithinPartitions("block")
    )
    out = write_table(blocks.mapInArrow(_whole(n, threshold, listed), "a long, b long, " + ("jaccard double" if listed else "links long")))
    drop_tables(side, held)
    return out


def _similar(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, listed: bool = False):
    """rows with a row id; (rid, rep) of every row with words; (a, b, jaccard) of pairs of reps; None or, of crowds, rows (a, b, links) of ``_whole``;
    all written. With ``listed`` the crowds' pairs are among the others."""
    plan = Plan(threshold, recall)
    rows, rid = with_row_id(docs)
    texts = rows.select(F.col(rid).alias("rid"), F.col(text_col).alias("text"))
    sketches = write_table(texts.mapInArrow(_sketch(n, plan), "rid long, fp binary, sig array<int>, pack binary"))
    reps = sketches.groupBy("fp").agg(F.min(F.struct("rid", "sig", "pack")).alias("x"))
    sets = write_table(reps.select("fp", "x.rid", "x.sig", "x.pack"))
    members = write_table(sketches.select("rid", "fp").join(sets.select("fp", F.col("rid").alias("rep")), "fp").select("rid", "rep"))
    drop_tables(sketches)
    near, crowd = _candidates(sets.select("rid", "sig", "pack"), plan)
    drop_tables(sets)
    roots = components(near)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    placed = roots.join(sizes, "root").select("rid", "root", F.ceil(F.col("n") / TILE).cast("int").alias("m"))
    tile = lambda c: F.pmod(F.xxhash64(c), F.col("m"))
    checks = write_table(
        near.join(placed.select(F.col("rid").alias("a"), "root", "m"), "a").select("a", "b", F.xxhash64("root", F.least(tile("a"), tile("b")), F.greatest(tile("a"), tile("b"))).alias("block"))
    )
    wanted = write_table(checks.select("block", F.col("a").alias("rid")).unionByName(checks.select("block", F.col("b").alias("rid"))).distinct())
    side = F.broadcast(wanted) if small_enough(wanted, 24) else wanted
    shipped = texts.join(side, "rid").select("block", F.col("rid").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    asked = checks.select("block", "a", "b", F.lit(None).cast("string").alias("text"))
    verified = shipped.unionByName(asked).repartition("block").sortWithinPartitions("block", F.col("b").isNotNull())
    pairs = write_table(verified.mapInArrow(_verify(n, threshold), "a long, b long, jaccard double"))
    drop_tables(near, roots, checks, wanted)
    if crowd is None:
        return rows, rid, members, pairs, None
    links = _verified_crowds(texts, members, crowd, n, threshold, listed)
    drop_tables(crowd)
    if listed:
        return rows, rid, members, pairs.unionByName(links), None
    return rows, rid, members, pairs, links


def _edges(pairs: DataFrame, links: DataFrame | None) -> DataFrame:
    """(a, b) that connect what is similar."""
    edges = pairs.select("a", "b")
    return edges if links is None else edges.unionByName(links.select("a", "b").filter("a <> b").distinct())


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets, ``set_a``, ``set_b`` and ``jaccard``, and the rows that have each, ``set_id`` and ``doc_id``: the join
    in full, without the pairs of rows that it stands for."""
    rows, rid, members, pairs, _ = _similar(docs, id_col, text_col, n, threshold, recall, True)
    named = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc_id")).join(members, "rid")
    return pairs.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), "jaccard"), named.select(F.col("rep").alias("set_id"), "doc_id")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each document: ``doc_id``, ``class_id`` (the least ``doc_id`` that similar rows connect it with, itself included)
    and ``n_links``, the number of rows whose n-gram sets are at least ``threshold`` similar to its own."""
    rows, rid, members, pairs, crowded = _similar(docs, id_col, text_col, n, threshold, recall)
    roots = components(_edges(pairs, crowded))
    crowds = members.groupBy("rep").agg(F.count("*").alias("n"))
    # A set's links: rows of the sets that are similar to it, and its own rows but one.
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    linked = ends.join(crowds.select(F.col("rep").alias("other"), "n"), "other").select("rep", F.col("n").alias("links"))
    if crowded is not None:
        linked = linked.unionByName(crowded.select(F.col("a").alias("rep"), "links"))
    linked = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    sets = crowds.join(linked, "rep", "left").join(roots.withColumnRenamed("rid", "rep"), "rep", "left")
    sets = write_table(sets.select("rep", F.coalesce("root", "rep").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).filter("n_links > 0"))
    keyed = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc"))
    placed = write_table(members.join(sets, "rep").select("rid", "root", "n_links").join(keyed, "rid"))
    firsts = placed.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc")).alias("first"))
    named = write_table(placed.join(firsts, "root").select("rid", F.col("first.doc").alias("class_id"), "n_links"))
    drop_tables(members, pairs, roots, sets, placed, *([] if crowded is None else [crowded]))
    return keyed.join(named, "rid", "left").select(
        F.col("doc").alias("doc_id"), F.when(F.col("n_links").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each connected group of similar rows: that of the least ``doc_id``, the earliest among equals."""
    rows, rid, members, pairs, crowded = _similar(docs, id_col, text_col, n, threshold, recall)
    roots = components(_edges(pairs, crowded))
    grouped = members.join(roots.withColumnRenamed("rid", "rep"), "rep", "left").select("rid", F.coalesce("root", "rep").alias("root"))
    crowds = grouped.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    grouped = write_table(grouped.join(crowds, "root"))
    side = F.broadcast(grouped) if small_enough(grouped, 24) else grouped
    keyed = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc")).join(side, "rid")
    firsts = keyed.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "rid")).alias("first"))
    removed = write_table(grouped.join(firsts.select("root", F.col("first.rid").alias("kept")), "root").filter("rid <> kept").select(F.col("rid").alias(rid)))
    out = without_rows(rows, rid, removed)
    drop_tables(members, pairs, roots, grouped, *([] if crowded is None else [crowded]))
    return out
