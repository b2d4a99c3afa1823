"""Exact top-k inner-product search with dual cover trees.

1. At most `PIVOTS` rows, chosen by a seeded hash, are pivots. Every row goes to
   the data block of its nearest pivot; a pivot of too many rows (a hot vector, a
   dense cluster) has several blocks, dealt by a hash. Rows of a length that no
   pivot has are dealt by a hash alone.
2. Each block builds its cover tree once, and answers the queries that are at home
   in it, which gives each query a first k-th score. Trees and answers are written.
3. Only a block's centre, radius and norm go to all tasks (at most `MOST_BLOCKS`
   times two, plus the pivots, of them). Each query goes on to those blocks alone
   whose bound reaches its k-th score, best bound first in each block. Data is
   moved twice, queries once per block that may hold an answer.
4. The best k of all blocks are merged per query.

A tree's levels are nested: a node's centre is its first child's, and further
children are the points farthest from all centres so far, at most `FANOUT`; each
point belongs to its nearest centre. So centres are further apart than the radius
that covers their points. In a block both sides have a tree, and a pair of nodes
is dropped when no product between them can reach the worst k-th score of the
query node's queries: q.p <= cq.cp + |cq| rp + |cp| rq + rq rp for centres c and
covering radii r. Equal bounds are not dropped, so ties go to the smaller id.
Dealing rows to pivots and building the trees take at most a quarter each of the
products between the rows and all queries, so where nothing can be pruned the
whole search takes at most about one and a half times what brute force does.

Components are integers, floor(scale * x); products are exact, and scores beyond a
long are cut to the nearest long.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; vectors meet only those of their own length; a query
leaves out all rows with its own id; of repeated query ids one query is asked;
repeated rows are candidates each; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import heapq
import io
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm._tables import written

SCALE = 1024
K = 10
DATA_BLOCK = 8192
PIVOTS = 256
MOST_BLOCKS = 16_384
LEAF = 256
QUERY_LEAF = 8
FANOUT = 5
LONG = 2**63


class CoverTree:
    """Points ordered so that every node is a range; leaves hold at most `leaf` points, or any number of equal ones.

    At most `distances` distances per point are taken to build it. `taken` counts them.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, distances: float = float("inf")):
        self.order, self.taken = np.arange(len(points)), 0
        lo, hi, radius, centre, children = [], [], [], [], []
        todo = [(0, len(points), 0, -1, None, 0)] if len(points) else []
        while todo:
            a, b, own_centre, parent, away, spent = todo.pop()
            node = len(lo)
            if parent >= 0:
                children[parent].append(node)
            own = self.order[a:b]
            if away is None:
                away, spent = self._away(points, own, own_centre), spent + 1
            lo.append(a), hi.append(b), radius.append(float(away.max())), centre.append(own_centre), children.append([])
            if b - a <= leaf or radius[-1] == 0 or spent + FANOUT - 1 > distances:
                continue
            near, which, centres = away, np.zeros(b - a, int), [own_centre]
            while len(centres) < FANOUT and near.max() > 0:
                centres.append(int(own[near.argmax()]))
                d = self._away(points, own, centres[-1])
                closer = d < near
                near = np.where(closer, d, near)
                which[closer] = len(centres) - 1
            by = np.argsort(which, kind="stable")
            self.order[a:b] = own[by]
            near, ends = near[by], np.cumsum(np.bincount(which, minlength=len(centres)))
            for i, c in enumerate(centres):
                start = int(ends[i - 1]) if i else 0
                if ends[i] > start:  # distances to a child's centre are known already
                    todo.append((a + start, a + int(ends[i]), c, node, near[start : ends[i]], spent + len(centres) - 1))
        self.lo, self.hi, self.children = np.array(lo, int), np.array(hi, int), children
        self.points, self.r = points[self.order], np.array(radius)
        self.c = points[centre] if centre else points
        self.norm = np.sqrt((self.c**2).sum(1))

    def _away(self, points: np.ndarray, own: np.ndarray, centre: int) -> np.ndarray:
        self.taken += len(own)
        d = points[own] - points[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def dump(self) -> bytes:
        out = io.BytesIO()
        parents = np.full(len(self.lo), -1)
        for n, kids in enumerate(self.children):
            parents[kids] = n
        np.savez(out, lo=self.lo, hi=self.hi, parents=parents, points=self.points, r=self.r, c=self.c, norm=self.norm, taken=self.taken)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            tree.__dict__.update({n: z[n] for n in z.files})
        tree.children = [[] for _ in tree.lo]
        for n, parent in enumerate(tree.parents.tolist()):
            if parent >= 0:
                tree.children[parent].append(n)
        return tree


def _products(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    if not wide:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return whole(a) @ whole(b).T


def dual_search(queries: np.ndarray, query_ids: np.ndarray, td: CoverTree, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[list[list[tuple]], int]:
    """For each query its best (score, id) pairs that reach its `floor`, best first, and how many distances and products were taken.

    `data_ids` stand in the tree's order.
    """
    tq = CoverTree(queries, QUERY_LEAF)
    qid, did = query_ids[tq.order], data_ids
    best: list[list[tuple]] = [[] for _ in qid]
    worst = np.full(len(qid), -np.inf) if floor is None else floor[tq.order].astype(float)
    # beyond 2**53 doubles don't hold every integer
    wide = len(did) > 0 and len(queries) > 0 and float(np.abs(queries).max()) * float(np.abs(td.points).max()) * queries.shape[1] >= 2**53
    taken = tq.taken

    def reach(q: int, nodes: list[int]) -> np.ndarray:
        c, norm, r = td.c[nodes], td.norm[nodes], td.r[nodes]
        return _bound(c @ tq.c[q], tq.norm[q], tq.r[q], norm, r)

    # best bound first: a query group meets its most promising data before all else
    heap = [(-float(reach(0, [0])[0]), 0, 0)] if len(qid) and len(did) else []
    while heap:
        bound, q, d = heapq.heappop(heap)
        if -bound < worst[tq.lo[q] : tq.hi[q]].min():
            continue
        if not tq.children[q] and not td.children[d]:
            a, b, x, y = tq.lo[q], tq.hi[q], td.lo[d], td.hi[d]
            s = _products(tq.points[a:b], td.points[x:y], wide)
            taken += s.size
            for i in np.flatnonzero((s >= worst[a:b, None]).any(1)).tolist():
                at = np.flatnonzero((s[i] >= worst[a + i]) & (did[x:y] != qid[a + i]))
                if len(at) > k:  # of many candidates only the best k can stay: highest score, then smallest id
                    at = at[np.lexsort((did[x:y][at], -s[i][at].astype(np.float64)))[:k]] if not wide else np.array(sorted(at.tolist(), key=lambda j: (-s[i][j], did[x + j]))[:k])
                merged = best[a + i] + [(int(s[i][j]), int(did[x + j])) for j in at.tolist()]
                merged.sort(key=lambda e: (-e[0], e[1]))
                best[a + i] = merged[:k]
                if len(merged) >= k:
                    worst[a + i] = max(worst[a + i], float(best[a + i][-1][0]))
            continue
        if td.children[d] and (not tq.children[q] or td.r[d] >= tq.r[q]):
            nodes = td.children[d]
            pairs = [(-u, q, n) for u, n in zip(reach(q, nodes).tolist(), nodes, strict=True)]
        else:
            pairs = [(-float(reach(n, [d])[0]), n, d) for n in tq.children[q]]
        for p in pairs:
            heapq.heappush(heap, p)
    out: list[list[tuple]] = [[] for _ in qid]
    for at, i in enumerate(tq.order.tolist()):
        out[i] = best[at]
    return out, taken


def _bound(products, q_norm, q_radius, norm, radius):
    """No product of points in the two balls is above this, rounding included."""
    bound = products + q_norm * radius + norm * q_radius + q_radius * radius
    return bound + np.abs(bound) * 1e-9 + 1e-3


def _points(t: pa.Table, scale: int) -> np.ndarray:
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(t) else np.zeros(0)
    return np.floor(scale * flat.astype(float)).reshape(len(t), -1) if len(t) else np.zeros((0, 0))


_FOUND = ("query_id", "vec_id", "score", "exact")
_ANSWER = "n int, block long, tree binary, ids binary, query_id long, vec_id long, score long, exact double"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _double(s: int) -> float:
    """The score as a double, or the next below where doubles don't hold every integer."""
    if abs(s) < 2**53:
        return float(s)
    try:
        return math.nextafter(float(s), -math.inf)
    except OverflowError:
        return sys.float_info.max if s > 0 else -math.inf


def _answers(rows: list[tuple], n: int = 0, block: int = 0, tree: bytes | None = None, ids: bytes | None = None) -> pa.Table:
    """A block's tree, if any, and its (query, row, score) answers; scores beyond a long are cut."""
    flat = [(n, block, tree, ids, None, None, None, None)] * (tree is not None) + [(n, block, None, None, q, i, max(-LONG, min(LONG - 1, s)), _double(s)) for q, i, s in rows]
    schema = pa.schema([(c, _TYPES[t]) for c, t in (f.split() for f in _ANSWER.split(", "))])
    return pa.table([pa.array([r[c] for r in flat], f.type) for c, f in enumerate(schema)], schema=schema)


def nearest(pivots: dict[int, tuple[np.ndarray, np.ndarray]], vectors: pa.Array, scale: int) -> np.ndarray:
    """For each vector the number of the nearest pivot of its length; -1 if there is none."""
    sizes, starts = np.diff(vectors.offsets.to_numpy()), vectors.offsets.to_numpy()[:-1]
    flat, out = vectors.values.to_numpy(zero_copy_only=False), np.full(len(vectors), -1)
    for n in np.unique(sizes).tolist():
        if n in pivots:
            at = np.flatnonzero(sizes == n)
            numbers, points = pivots[n]
            x = np.floor(scale * flat[starts[at][:, None] + np.arange(n)])
            out[at] = numbers[((points * points).sum(1) - 2 * x @ points.T).argmin(1)]
    return out


def top_k(df: DataFrame, key: str, vector: str, is_query, k: int = K, scale: int = SCALE, data_block: int = DATA_BLOCK, n_pivots: int = PIVOTS) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id` and `score` of the k best rows for every row that meets the condition `is_query`."""
    v = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))))
    n_rows, n_asked = rows.agg(F.count("*"), F.count_distinct(F.when(F.col("asked"), F.col("id")))).first()
    blocks = max(1, min(MOST_BLOCKS, -(-n_rows // data_block)))

    chosen: dict[int, list] = {}  # at most `n_pivots` vectors come to the driver
    some = rows.orderBy(F.xxhash64("id", "v", F.lit(3)), "id", "v").limit(max(1, min(n_pivots, blocks, n_asked // 4))).select("v").collect()
    for number, p in enumerate(dict.fromkeys(tuple(r["v"]) for r in some)):
        chosen.setdefault(len(p), []).append((number, p))
    pivots = {n: (np.array([i for i, _ in some]), np.floor(scale * np.array([p for _, p in some], float))) for n, some in chosen.items()}

    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest(pivots, b.column(1), scale), pa.int32())], names=["id", "v", "asked", "pivot"])

    dealt = written(rows.mapInArrow(deal, "id long, v array<double>, asked boolean, pivot int"))
    sizes = {r["pivot"]: r["count"] for r in dealt.groupBy("pivot").count().collect()}  # as many as pivots, and one
    parts = {p: max(1, -(-c * blocks // max(1, n_rows))) for p, c in sizes.items()}
    first = np.cumsum([0, *parts.values()]).tolist()
    start, many = (F.create_map(*[F.lit(x) for p, c in zip(parts, values, strict=True) for x in (p, c)]) if parts else F.create_map(F.lit(0), F.lit(0)) for values in (first[: len(parts)], parts.values()))
    block = (start[F.col("pivot")] + F.pmod(F.xxhash64("id", "v"), many[F.col("pivot")])).cast("long")
    data = dealt.select("id", "v", F.size("v").alias("n"), block.alias("block"))
    queries = dealt.where("asked").groupBy("id").agg(F.min_by(F.struct("v", F.size("v").alias("n"), block.alias("block")), "v").alias("q")).select("id", "q.*")

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's tree, and the answers for the queries at home in it."""
        if not len(left):
            return _answers([])
        ids, asked = left.column("id").to_numpy(), right.column("id").to_numpy()
        tree = CoverTree(_points(left, scale), LEAF, n_asked / 4)
        ids = ids[tree.order]
        found, _ = dual_search(_points(right, scale), asked, tree, ids, k) if len(right) else ([], 0)
        return _answers([(int(q), i, s) for q, best in zip(asked, found, strict=True) for s, i in best], left.column("n")[0].as_py(), left.column("block")[0].as_py(), tree.dump(), ids.tobytes())

    built = written(data.groupBy("n", "block").cogroup(queries.groupBy("n", "block")).applyInArrow(build, _ANSWER))
    trees, home = built.where("tree is not null"), built.where("query_id is not null").select(*_FOUND)

    def roots(batches):
        for b in batches:
            for n, number, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                t = CoverTree.load(data)
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((n, pa.int32()), (number, pa.int64()), (t.c[0].tolist(), pa.list_(pa.float64())), (float(t.r[0]), pa.float64()))], names=["n", "block", "c", "r"])

    tops: dict[int, list] = {}  # one centre per block: see MOST_BLOCKS
    for r in trees.select("n", "block", "tree").mapInArrow(roots, "n int, block long, c array<double>, r double").collect():
        tops.setdefault(r["n"], []).append((r["block"], r["c"], r["r"]))
    tops = {n: (np.array([b for b, _, _ in some]), np.array([c for _, c, _ in some]), np.array([r for *_, r in some])) for n, some in tops.items()}
    shared = df.sparkSession.sparkContext.broadcast(tops)

    floors = home.groupBy("query_id").agg(F.count("*").alias("found"), F.min("exact").alias("least")).select(F.col("query_id").alias("id"), F.when(F.col("found") >= k, F.col("least")).alias("floor"))
    waiting = queries.join(floors, "id", "left").select("id", "v", "n", "block", "floor")

    def onward(batches):
        """A query's rows for the blocks, other than its own, that may hold an answer."""
        step = max(1, 50_000 // max((len(numbers) for numbers, _, _ in shared.value.values()), default=1))
        for b in (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
            at, to = [], []
            for i, (x, own, floor) in enumerate(zip(*(b.column(c).to_pylist() for c in ("v", "block", "floor")), strict=True)):
                numbers, c, r = shared.value[len(x)]
                q = np.floor(scale * np.array(x, float))
                bound = _bound(c @ q, np.sqrt(q @ q), 0.0, np.sqrt((c * c).sum(1)), r)
                go = numbers[~(bound < (-np.inf if floor is None else floor)) & (numbers != own)]
                at += [i] * len(go)
                to += go.tolist()
            t = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column("id"), t.column("v"), t.column("n"), pa.array(to, pa.int64()), t.column("floor")], names=["id", "v", "n", "block", "floor"])

    going = waiting.mapInArrow(onward, "id long, v array<double>, n int, block long, floor double")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _answers([])
        (row,) = left.to_pylist()
        asked = right.column("id").to_numpy()
        floor = np.array([-np.inf if x is None else x for x in right.column("floor").to_pylist()])
        found, _ = dual_search(_points(right, scale), asked, CoverTree.load(row["tree"]), np.frombuffer(row["ids"], np.int64), k, floor)
        return _answers([(int(q), i, s) for q, best in zip(asked, found, strict=True) for s, i in best], row["n"])

    abroad = trees.select("n", "block", "tree", "ids").groupBy("n", "block").cogroup(going.groupBy("n", "block")).applyInArrow(search, _ANSWER)
    met = home.unionByName(abroad.where("query_id is not null").select(*_FOUND))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_cover_trees(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
