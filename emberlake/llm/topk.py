"""Exact top-k inner products by ball trees, branch and bound, one tree per shard.

Shards are clusters: a router, fitted on a bounded sample, sends each vector to a leaf, and a leaf with
more rows than a shard holds is dealt to several. Blocks of like queries first search the shards with
the highest bounds; then each block goes, with its k-th scores, only to shards whose bound still
reaches the k-th score of one of its queries. The sample decides where vectors lie, never what is found.
"""
from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import column_of, grouped, lean, pack, unpack
from .workspace import Workspace

SHARD = 4096  # vectors of a tree
LEAF = 128  # vectors of a leaf
BLOCK = 8192  # queries that travel together
ABREAST = 512  # queries that walk a tree together
TOGETHER = 8  # trees that a task visits one after another, sharing each query's k-th score
PACK = 256  # shards whose balls travel together
SAMPLE, LEAVES = 16384, 4096  # vectors that the router is fitted on; its leaves at most
EXACT = 2.0**53  # up to here sums of integers are exact in doubles
TOP = 2**63 - 1


def _coded(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, named by the first byte."""
    most = np.abs(x).max(initial=0)
    kind = "b" if most < 128 else "h" if most < 2**15 else "i" if most < 2**31 else "d"
    return kind.encode() + x.astype("<" + kind).tobytes()


def _whole(blob) -> np.ndarray:
    blob = memoryview(blob)
    return np.frombuffer(blob[1:], "<" + chr(blob[0])).astype(np.float64)


def _matrix(column) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which add nothing to a product."""
    parts = [_whole(v.as_buffer()) for c in column.chunks for v in c]
    out = np.zeros((len(parts), max(map(len, parts), default=0)))
    for k, x in enumerate(parts):
        out[k, : len(x)] = x
    return out


@lean
def _integers(batches, scale: float):
    """Rows with an id whose vector is there, holds only finite numbers and stays finite: each component as floor(scale * x), a whole double."""
    for batch in batches:
        ids = column_of(batch, "vec_id")
        vectors = column_of(batch, "embedding")
        offs = vectors.offsets.to_numpy().astype(np.int64)
        flat = vectors.values
        gone = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        x = np.floor(scale * flat.cast(pa.float64()).fill_null(0.0).to_numpy())
        gone[1:] += np.cumsum(~np.isfinite(x))
        good = np.flatnonzero(~vectors.is_null().to_numpy(zero_copy_only=False) & ~ids.is_null().to_numpy(zero_copy_only=False) & (gone[offs[1:]] == gone[offs[:-1]]))
        blobs = [_coded(x[offs[k] : offs[k + 1]]) for k in good.tolist()]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), column_of(batch, "row").take(pa.array(good)), pa.array(blobs, pa.binary())], ["vec_id", "row", "v"])


def _halves(part: np.ndarray) -> np.ndarray:
    """Where the rows lie between two that are far apart."""
    away = ((part - part.mean(0)) ** 2).sum(1)
    one = part[away.argmax()]
    other = part[((part - one) ** 2).sum(1).argmax()]
    return other - one


class Router:
    """A binary tree of hyperplanes; its leaves are numbered."""

    def __init__(self, normal: np.ndarray, cut: np.ndarray, child: np.ndarray, leaf: np.ndarray):
        self.normal, self.cut, self.child, self.leaf = normal, cut, child, leaf

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int) -> Router:
        normal, cut, child, leaf = [], [], [], []

        def node(rows: np.ndarray, many: int) -> int:
            k = len(cut)
            normal.append(np.zeros(x.shape[1]))
            cut.append(0.0)
            child.append([0, 0])
            leaf.append(-1)
            side = x[rows] @ (direction := _halves(x[rows])) if many > 1 and len(rows) > 1 else np.zeros(0)
            middle = float(np.median(side)) if len(side) else 0.0
            left = side <= middle
            if many > 1 and len(side) and np.isfinite(side).all() and 0 < left.sum() < len(rows):
                normal[k], cut[k] = direction, middle
                child[k] = [node(rows[left], many // 2), node(rows[~left], many - many // 2)]
            else:
                leaf[k] = sum(y >= 0 for y in leaf)
            return k

        with np.errstate(all="ignore"):
            node(np.arange(len(x)), leaves)
        return cls(np.array(normal), np.array(cut), np.array(child), np.array(leaf))

    def of(self, x: np.ndarray) -> np.ndarray:
        d = min(x.shape[1], self.normal.shape[1])
        at = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.leaf[at] < 0)
        with np.errstate(all="ignore"):
            while len(open_):
                k = at[open_]
                right = ~((x[open_, :d] * self.normal[k, :d]).sum(1) <= self.cut[k])
                at[open_] = self.child[k, right.astype(int)]
                open_ = open_[self.leaf[at[open_]] < 0]
        return self.leaf[at]


@lean
def _routed(batches, router: Router):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            leaf = router.of(_matrix(pa.chunked_array([column_of(part, "v")])))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf, pa.int64())], [*part.schema.names, "leaf"])


class BallTree:
    def __init__(self, ids, x, start, end, left, right, centre, radius):
        self.ids, self.x, self.start, self.end, self.left, self.right, self.centre, self.radius = ids, x, start, end, left, right, centre, radius

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(ids))
        nodes: list[list] = []

        def ball(a: int, b: int) -> int:
            k, part = len(nodes), x[order[a:b]]
            centre = part.mean(0)
            away = np.sqrt(((part - centre) ** 2).sum(1)).max(initial=0.0)
            # rounded outwards; what doubles can't hold is unbounded
            away = away * (1 + 1e-9) + 1e-9 * np.abs(centre).max(initial=0.0)
            nodes.append([a, b, -1, -1, np.nan_to_num(centre, nan=0.0, posinf=0.0, neginf=0.0), float(away) if np.isfinite(away) and np.isfinite(centre).all() else np.inf])
            if b - a > leaf:
                side = part @ _halves(part)
                rank = np.argsort(side, kind="stable")
                order[a:b] = order[a:b][rank]
                cut = a + int(np.searchsorted(side[rank], (side.max() + side.min()) / 2))
                if not a + (b - a) // 16 < cut < b - (b - a) // 16:
                    cut = (a + b) // 2
                nodes[k][2], nodes[k][3] = ball(a, cut), ball(cut, b)
            return k

        if len(ids):
            with np.errstate(all="ignore"):
                ball(0, len(ids))
        start, end, left, right = (np.array([n[i] for n in nodes], np.int64) for i in range(4))
        centre = np.array([n[4] for n in nodes]).reshape(len(nodes), x.shape[1])
        return cls(ids[order], x[order], start, end, left, right, centre, np.array([n[5] for n in nodes]))

    def to_bytes(self) -> bytes:
        x = _coded(self.x.reshape(-1))
        return pack(np.array(self.x.shape), self.ids, np.frombuffer(x, np.uint8), self.start, self.end, self.left, self.right, self.centre.astype("<f8").reshape(-1), self.radius)

    @classmethod
    def from_bytes(cls, blob) -> BallTree:
        (n, d), ids, x, start, end, left, right, centre, radius = unpack(blob)
        return cls(ids, _whole(x.tobytes()).reshape(n, d), start, end, left, right, centre.reshape(-1, d), radius)


def bounds(q: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What the inner product of each query with a member of each ball reaches at most, rounded outwards."""
    with np.errstate(all="ignore"):
        size = np.sqrt((centre * centre).sum(1))
        out = q @ centre.T + norm[:, None] * (radius + 1e-12 * size)[None, :]
        out += 1e-9 * np.abs(out) + 1e-3
    return np.where(np.isnan(out), np.inf, out)


class Best:
    """The k best of each query so far: score descending, then id ascending. A candidate must reach the k-th, or `floor`, what the k-th is known to reach.

    Scores are exact: below 2 ** 53 in doubles; a query that has met greater ones keeps whole numbers of any size in `large`.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.own, self.q, self.k = ids, q, k
        with np.errstate(all="ignore"):
            self.norm = np.sqrt((q * q).sum(1)) * (1 + 1e-12)
        self.score = np.full((len(q), k), -np.inf)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self.large: dict[int, list[tuple[int, int]]] = {}

    def least(self, rows) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def visit(self, tree: BallTree) -> None:
        """Branch and bound: the node with the highest bound first, for the queries whose k-th score it may still reach."""
        if not len(tree.ids) or not len(self.q):
            return
        for a in range(0, len(self.q), ABREAST):
            self._visit(tree, np.arange(a, min(a + ABREAST, len(self.q))))

    def _visit(self, tree: BallTree, every: np.ndarray) -> None:
        d = min(self.q.shape[1], tree.x.shape[1])
        q, x, centre = self.q[:, :d], tree.x[:, :d], tree.centre[:, :d]
        bound = lambda n, rows: bounds(q[rows], self.norm[rows], centre[n : n + 1], tree.radius[n : n + 1])[:, 0]
        first = bound(0, every)
        heap = [(-float(first.max()), 0, every, first)]
        while heap:
            _, n, rows, most = heapq.heappop(heap)
            rows = rows[most >= self.least(rows)]
            if not len(rows):
                continue
            if tree.left[n] < 0:
                self._leaf(rows, q, x[tree.start[n] : tree.end[n]], tree.ids[tree.start[n] : tree.end[n]])
                continue
            for child in (int(tree.left[n]), int(tree.right[n])):
                m = bound(child, rows)
                heapq.heappush(heap, (-float(m.max()), child, rows, m))

    def _leaf(self, rows: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            got = q[rows] @ x.T
            wide = ~(self.norm[rows][:, None] * np.sqrt((x * x).sum(1))[None, :] < EXACT)  # sums that doubles may round
        got[self.own[rows][:, None] == ids[None, :]] = -np.inf
        exact = wide.any(1)
        for i in np.flatnonzero(exact).tolist():
            r = int(rows[i])
            mine = [int(a) for a in q[r]]
            new = [(sum(a * int(b) for a, b in zip(mine, x[j], strict=True)), int(ids[j])) for j in range(len(ids)) if ids[j] != self.own[r]]
            self._keep(r, new)
        rows, got = rows[~exact], got[~exact]
        if self.large:
            for i, r in enumerate(rows.tolist()):
                if r in self.large:
                    self._keep(r, [(int(got[i, j]), int(ids[j])) for j in np.flatnonzero(got[i] > -np.inf)])
            plain = np.array([r not in self.large for r in rows.tolist()], bool)
            rows, got = rows[plain], got[plain]
        self._take(rows, got, ids)

    def _keep(self, r: int, new: list[tuple[int, int]]) -> None:
        """Candidates of a query whose scores may exceed doubles."""
        old = self.large.get(r)
        if old is None:
            old = [(int(s), int(k)) for s, k in zip(self.score[r], self.id[r], strict=True) if s > -np.inf]
        best = self.large[r] = sorted([*old, *new], key=lambda c: (-c[0], c[1]))[: self.k]
        self.score[r], self.id[r] = -np.inf, np.iinfo(np.int64).max
        for k, (s, who) in enumerate(best):
            self.score[r, k], self.id[r, k] = _under(s), who

    def _take(self, rows: np.ndarray, got: np.ndarray, ids: np.ndarray) -> None:
        better = ((got >= self.least(rows)[:, None]) & (got > -np.inf)).any(1)
        rows, got = rows[better], got[better]
        if not len(rows):
            return
        score = np.concatenate([self.score[rows], got], 1)
        who = np.concatenate([self.id[rows], np.broadcast_to(ids, got.shape)], 1)
        order = np.lexsort((who, -score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.id[rows] = np.take_along_axis(who, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Query numbers, ids and whole scores."""
        row, col = np.nonzero(self.id < np.iinfo(np.int64).max) if not self.large else np.nonzero(self.score > -np.inf)
        return row, self.id[row, col], [self.large[r][c][0] if r in self.large else int(self.score[r, c]) for r, c in zip(row.tolist(), col.tolist(), strict=True)]


def _under(s: int) -> float:
    """A double that s reaches, close to it."""
    try:
        x = float(s)
    except OverflowError:
        return np.finfo(float).max if s > 0 else np.finfo(float).min
    return float(np.nextafter(x, -np.inf)) if abs(s) >= EXACT else x


def _order(s: int) -> str | None:
    """For scores beyond a long, a string in their order."""
    if abs(s) < TOP:
        return None
    digits = str(abs(s))
    return f"1{len(digits):05d}{digits}" if s > 0 else f"0{99999 - len(digits):05d}{''.join(str(9 - int(c)) for c in digits)}"


TREES = "shard long, tree binary, ball binary"
FOUND = "block long, n long, query_id long, vec_id long, score long, over string"


def _tree(table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    x = _matrix(table.column("v"))
    order = np.argsort(ids, kind="stable")
    tree = BallTree.of(ids[order], x[order])
    ball = pack(tree.centre[0], tree.radius[:1])
    return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([tree.to_bytes()], pa.binary()), "ball": pa.array([ball], pa.binary())})


def _pack(table: pa.Table) -> pa.Table:
    """The balls of many shards in one value."""
    balls = [unpack(b.as_buffer()) for c in table.column("ball").chunks for b in c]
    centre = np.zeros((len(balls), max(len(c) for c, _ in balls)))
    for k, (c, _) in enumerate(balls):
        centre[k, : len(c)] = c
    blob = pack(np.array(centre.shape), table.column("shard").to_numpy(), centre.reshape(-1), np.concatenate([r for _, r in balls]))
    return pa.table({"pack": table.column("pack").slice(0, 1), "balls": pa.array([blob], pa.binary())})


def _block(table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    x = _matrix(table.column("v"))
    return pa.table({"block": table.column("block").slice(0, 1), "queries": pa.array([pack(np.array(x.shape), ids, np.frombuffer(_coded(x.reshape(-1)), np.uint8), np.full(len(ids), -np.inf))], pa.binary())})


def _queries(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n, d), ids, x, floor = unpack(blob)
    return ids, _whole(x.tobytes()).reshape(n, d), floor


@lean
def _reached(batches):
    """For each block and shard the highest bound of a query that may still reach its k-th score there."""
    for batch in batches:
        block, shard, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k in range(batch.num_rows):
            _, q, floor = _queries(column_of(batch, "queries")[k].as_buffer())
            (n, d), shards, centre, radius = unpack(column_of(batch, "balls")[k].as_buffer())
            width = min(d, q.shape[1])
            with np.errstate(all="ignore"):
                norm = np.sqrt((q * q).sum(1)) * (1 + 1e-12)
            b = bounds(q[:, :width], norm, centre.reshape(n, d)[:, :width], radius)
            reach = np.where(b >= floor[:, None], b, -np.inf).max(0, initial=-np.inf)
            some = reach > -np.inf
            block.append(np.full(int(some.sum()), column_of(batch, "block")[k].as_py()))
            shard.append(shards[some])
            most.append(reach[some])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block)), pa.array(np.concatenate(shard)), pa.array(np.concatenate(most))], ["block", "shard", "most"])


def _search(left: pa.Table, right: pa.Table, k: int) -> Best | None:
    if not left.num_rows or not right.num_rows:
        return None
    best = Best(*_queries(left.column("queries")[0].as_buffer())[:2], k, _queries(left.column("queries")[0].as_buffer())[2])
    for chunk in right.column("tree").chunks:
        for tree in chunk:
            best.visit(BallTree.from_bytes(tree.as_buffer()))
    return best


def _finds(left: pa.Table, best: Best | None) -> pa.Table:
    row, who, score = best.found() if best else (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    block = left.column("block")[0].as_py() if best else 0
    own = best.own[row] if best else who
    return pa.table({"block": pa.array(np.full(len(row), block), pa.int64()), "n": pa.array(row, pa.int64()), "query_id": pa.array(own), "vec_id": pa.array(who), "score": pa.array([max(-TOP - 1, min(TOP, s)) for s in score], pa.int64()), "over": pa.array([_order(s) for s in score], pa.string())})


def _floors(left: pa.Table, right: pa.Table) -> pa.Table:
    """Blocks whose queries know their k-th scores so far."""
    out = []
    for k in range(left.num_rows):
        ids, q, floor = _queries(left.column("queries")[k].as_buffer())
        floor = floor.copy()
        floor[right.column("n").to_numpy()] = right.column("kth").to_numpy()
        out.append(pack(np.array(q.shape), ids, np.frombuffer(_coded(q.reshape(-1)), np.uint8), floor))
    return pa.table({"block": left.column("block"), "queries": pa.array(out, pa.binary())})


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query among all other rows.

    Components are floor(scale * x); sums are exact whatever their size, a score beyond a long is ranked by its
    true value and returned as the nearest long. Null ids, null vectors and those that hold nulls or numbers that
    aren't finite (before or after scaling) take no part; shorter vectors count as ending in zeros. Ties go to the
    smaller vec_id. A query is a distinct (vec_id, vector) for which is_query(vec_id) holds; rows with its vec_id
    are no candidates for it. A candidate row that repeats counts as often. Fewer rows than k give all; an empty
    table gives none; extra columns play no part.
    """
    work = Workspace(vectors.sparkSession, "top-k")
    numbered = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.monotonically_increasing_id().alias("row"))
    rows = work.save(numbered.mapInArrow(partial(_integers, scale=scale), "vec_id long, row long, v binary"))
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(-(-n // SAMPLE) or 1)) == 0).select("v").limit(SAMPLE).toArrow()
    router = Router.fit(_matrix(sample.column("v")), max(1, min(LEAVES, -(-n // SHARD))))
    routed = work.save(rows.mapInArrow(partial(_routed, router=router), "vec_id long, row long, v binary, leaf long"))
    work.drop(rows)
    queries = routed.where(is_query(F.col("vec_id"))).groupBy("vec_id", "v").agg(F.min("leaf").alias("leaf"))
    queries = work.save(queries.select("vec_id", "v", "leaf"))
    # a row for each leaf of the router, LEAVES at most
    many, asked = ({r.leaf: r["count"] for r in t.groupBy("leaf").count().collect()} for t in (routed, queries))
    starts, first, begin = {}, 0, 0
    for leaf in range(LEAVES):
        parts, ask = -(-many.get(leaf, 0) // SHARD), asked.get(leaf, 0)
        if parts:
            starts[leaf] = (leaf, first, parts, begin, ask)
        first, begin = first + parts, begin + ask
    n_shards, n_blocks = first, -(-begin // BLOCK)
    known = F.broadcast(vectors.sparkSession.createDataFrame([*starts.values()], "leaf long, first long, parts long, begin long, ask long"))
    shard = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))
    trees = routed.join(known, "leaf").select(shard.alias("shard"), "vec_id", "v").groupBy("shard").applyInArrow(grouped(_tree), TREES)
    trees = work.save(trees)
    block = F.floor((F.col("begin") + F.pmod(F.xxhash64("vec_id", "v"), F.greatest("ask", F.lit(1)))) / F.lit(BLOCK))
    blocks = queries.join(known, "leaf").select(block.cast("long").alias("block"), "vec_id", "v").groupBy("block").applyInArrow(grouped(_block), "block long, queries binary")
    blocks = work.save(blocks)
    packs = work.save(trees.select(F.floor(F.col("shard") / PACK).cast("long").alias("pack"), "shard", "ball").groupBy("pack").applyInArrow(grouped(_pack), "pack long, balls binary"))
    n_packs = max(1, -(-n_shards // PACK))

    def reached(blocks: DataFrame) -> DataFrame:
        # each block of the stated queries meets the balls of all shards, PACK at a time
        pairs = blocks.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_packs - 1).cast("long")))).join(packs, "pack")
        return pairs.select("block", "queries", "balls").mapInArrow(_reached, "block long, shard long, most double")

    def searched(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
        """pairs (block, part, shard): a task visits the trees of a part for a block."""
        wanted = pairs.join(trees.select("shard", "tree"), "shard").select(F.col("block").alias("for"), F.col("part").alias("of"), "tree")
        at = blocks.join(pairs.select("block", "part").distinct(), "block")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return _finds(left, _search(left, right, k))

        return work.save(at.groupBy("block", "part").cogroup(wanted.groupBy("for", "of")).applyInArrow(run, FOUND))

    place = Window.partitionBy("block", "n").orderBy(F.desc("score"), F.desc("over"), "vec_id")
    nth = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("most"), "shard"))
    ranked = work.save(reached(blocks).withColumn("nth", nth))
    found = searched(blocks, ranked.where(F.col("nth") <= TOGETHER).select("block", "shard", F.lit(0).cast("long").alias("part")))
    if n_shards > TOGETHER:
        seen = ranked.where(F.col("nth") <= TOGETHER).select("block", "shard")
        kth = found.groupBy("block", "n").agg(F.count(F.lit(1)).alias("got"), F.min("score").cast("double").alias("kth")).where(F.col("got") >= k)
        kth = kth.select("block", "n", (F.col("kth") - F.abs("kth") * F.lit(1e-15)).alias("kth"))
        again = work.save(blocks.groupBy("block").cogroup(kth.groupBy("block")).applyInArrow(_floors, "block long, queries binary"))
        more = reached(again).join(seen, ["block", "shard"], "left_anti")
        more = more.withColumn("part", F.floor(nth / TOGETHER).cast("long")).select("block", "shard", "part")
        found = found.unionByName(searched(again, work.save(more)))
    out = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
