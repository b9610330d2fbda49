"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample. Every vector goes down to its leaf; a leaf is stored as
blocks of bounded size. A query walks the tree best bin first: a priority queue holds the nodes not
yet opened, by the distance to their centres, and yields the leaves in order. How many leaves a
query visits is calibrated: for some vectors the true neighbours are found by brute force over all
rows, and visits widen until enough of them lie in the visited leaves.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from urlvane.llm.shared import blob, discard, written

#: Vectors that the tree is fitted on, the first by a hash of the id.
FIT_ROWS = 20_000
BRANCHES = 8
LEAF_ROWS = 100
#: Vectors whose true neighbours calibrate the visits.
CALIBRATION = 64
TARGET_RECALL = 0.97
BLOCK_ROWS = 2048
QUERY_BLOCK = 64
#: Found rows that a task holds while it looks through its blocks.
HELD_ROWS = 400_000


@dataclass
class Node:
    centre: np.ndarray
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


def _k_means(points: np.ndarray, k: int, rng) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(12):
        near = _squared(points, centres).argmin(axis=1)
        for i in range(k):
            own = points[near == i]
            if len(own):
                centres[i] = own.mean(axis=0)
    return centres


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, fast and only for routing."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def build_tree(points: np.ndarray, leaf_rows: int) -> tuple[Node, int]:
    rng = np.random.default_rng(10)
    count = 0

    def grow(own: np.ndarray) -> Node:
        nonlocal count
        node = Node(own.mean(axis=0))
        if len(own) > leaf_rows and len(np.unique(own, axis=0)) > BRANCHES:
            centres = _k_means(own, BRANCHES, rng)
            near = _squared(own, centres).argmin(axis=1)
            for i in range(BRANCHES):
                if (near == i).any():
                    node.children.append(grow(own[near == i]))
        if len(node.children) < 2:
            node.children, node.leaf = [], count
            count += 1
        return node

    return grow(points), count


def route(tree: Node, points: np.ndarray) -> np.ndarray:
    """The leaf of each vector: down the nearest centres."""
    leaves = np.zeros(len(points), np.int64)

    def down(node: Node, own: np.ndarray) -> None:
        if not len(own):
            return
        if node.leaf >= 0:
            leaves[own] = node.leaf
            return
        near = _squared(points[own], np.array([c.centre for c in node.children])).argmin(axis=1)
        for i, child in enumerate(node.children):
            down(child, own[near == i])

    down(tree, np.arange(len(points)))
    return leaves


def best_bins(tree: Node, query: np.ndarray, visits: int) -> list[int]:
    """The first leaves of the best-bin-first order."""
    queue, order, turn = [(0.0, 0, tree)], [], 1
    while queue and len(order) < visits:
        _, _, node = heapq.heappop(queue)
        if node.leaf >= 0:
            order.append(node.leaf)
            continue
        gaps = _squared(query[None, :], np.array([c.centre for c in node.children]))[0]
        for gap, child in zip(gaps, node.children):
            heapq.heappush(queue, (float(gap), turn, child))
            turn += 1
    return order


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Per query the k nearest other rows: query id, id, distance."""
    for at, query in enumerate(queries):
        gap = vectors - query
        far = np.sqrt((gap * gap).sum(axis=1))
        own = np.flatnonzero(ids != query_ids[at])
        order = own[np.lexsort((ids[own], far[own]))[:k]] if len(own) <= 4 * k else None
        if order is None:
            limit = np.partition(far[own], k - 1)[k - 1]
            close = own[far[own] <= limit]
            order = close[np.lexsort((ids[close], far[close]))[:k]]
        yield np.full(len(order), query_ids[at]), ids[order], far[order]


class Best:
    """The k nearest rows found so far of each query that a task meets: query id, id, distance and more columns.

    Rows are cut to the k nearest of each query when there are HELD_ROWS; what is left is handed on, to be
    merged later, if it is more than half of that.
    """

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def cut(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.lexsort((columns[1], columns[2], columns[0]))
        query = columns[0][order]
        begins = np.flatnonzero(np.diff(query, prepend=query[0] - 1))
        rank = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        order = order[rank < self.k]
        self.parts, self.size = [[c[order] for c in columns]], len(order)
        return self.parts[0]

    def full(self) -> bool:
        if self.size >= HELD_ROWS:
            self.cut()
        return self.size > HELD_ROWS // 2

    def taken(self, names: list[str]) -> pa.RecordBatch:
        columns = self.cut()
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """Rows with an id and a vector that is finite, not zero and of the commonest size (the smaller if tied); and that size."""
    v = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = sizes[0].n if sizes else 0
    return rows.filter(F.size("embedding") == size), size


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
           target: float = TARGET_RECALL) -> DataFrame:
    """Return query_id, rank (from 1), vec_id and score (Euclidean distance in double precision).

    Queries are the rows for which the column `is_query` (over vec_id) holds. A query's own row is no
    candidate; equal distances go to the smaller id. Null, zero and non-finite vectors take no part. Repeated
    ids are taken once for each different vector. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, size = usable(vectors, vec_id, embedding)
    schema = "query_id long, vec_id long, score double"
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(rows.dropDuplicates(["vec_id", "embedding"]), "vectors")
    queries = rows.filter(is_query)
    # of equal vectors only the first k + 1 ids can be among the k nearest, whoever asks
    same = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()
    points = np.array(sample["embedding"].tolist(), np.float64)
    tree, leaves = build_tree(points, LEAF_ROWS)
    shared = spark.sparkContext.broadcast(tree)

    def routed(batches):
        for batch in batches:
            if batch.num_rows:
                where = route(shared.value, _matrix(batch.column("embedding"), size))
                yield pa.RecordBatch.from_arrays([pa.array(where), *batch.columns], ["leaf", *batch.schema.names])

    def blocks(batches):
        """Rows in the order of leaves, in blocks that end with their leaf or with BLOCK_ROWS rows."""
        kind = pa.schema([("leaf", pa.int64()), ("ids", pa.binary()), ("points", pa.binary())])
        waiting, leaf, held = [], None, 0

        def packed():
            ids, points = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            for lo in range(0, len(ids), BLOCK_ROWS):
                yield pa.RecordBatch.from_pydict(
                    {"leaf": [leaf], "ids": [blob(ids[lo:lo + BLOCK_ROWS])], "points": [blob(points[lo:lo + BLOCK_ROWS])]}, schema=kind)

        for batch in batches:
            if not batch.num_rows:
                continue
            where, ids = batch.column("leaf").to_numpy(), batch.column("vec_id").to_numpy()
            points = _matrix(batch.column("embedding"), size)
            cuts = np.flatnonzero(np.diff(where, prepend=where[0] - 1))
            for first, last in zip(cuts, [*cuts[1:], len(where)]):
                if waiting and (where[first] != leaf or held >= BLOCK_ROWS):
                    yield from packed()
                    waiting, held = [], 0
                leaf = int(where[first])
                waiting.append((ids[first:last], points[first:last]))
                held += last - first
        if waiting:
            yield from packed()

    # ranges are cut by row count, within a leaf too, so that a leaf with many rows is many tasks' work
    leaves_of = written(kept.select("vec_id", "embedding").mapInArrow(routed, "leaf long, vec_id long, embedding array<double>"), "leaves")
    in_order = leaves_of.repartitionByRange("leaf", "vec_id").sortWithinPartitions("leaf", "vec_id")
    index = written(in_order.mapInArrow(blocks, "leaf long, ids binary, points binary"), "leaf-blocks")
    discard(leaves_of)

    # calibration: where the true neighbours of some vectors lie in their own order of leaves
    trial = sample.head(CALIBRATION)
    trial_points, trial_ids = np.array(trial["embedding"].tolist(), np.float64), trial["vec_id"].to_numpy(np.int64)
    orders = np.zeros((len(trial), leaves), np.int64)
    for at, point in enumerate(trial_points):
        orders[at, best_bins(tree, point, leaves)] = np.arange(leaves)
    place = dict(zip(trial_ids.tolist(), orders))

    def brute(batches):
        best = Best(k)
        names = ["query_id", "vec_id", "score", "visit"]
        for batch in batches:
            for leaf, ids, block in zip(*[batch.column(c).to_pylist() for c in ("leaf", "ids", "points")]):
                for q, i, d in _nearest(trial_points, trial_ids, np.frombuffer(block).reshape(-1, size), np.frombuffer(ids, np.int64), k):
                    if len(q):
                        best.add(q, i, d, np.full(len(q), place[int(q[0])][leaf]))
                if best.full():
                    yield best.taken(names)
        if best.size:
            yield best.taken(names)

    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    true = index.mapInArrow(brute, schema + ", visit long").withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k)
    at = np.sort([r.visit for r in true.select("visit").collect()])
    visits = int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1 if len(at) else 1

    def probes(batches):
        """Queries of one task, by leaf to visit, in blocks."""
        waiting: dict[int, list] = {}
        kind = pa.schema([("leaf", pa.int64()), ("query_ids", pa.binary()), ("queries", pa.binary())])
        pack = lambda leaf, own: pa.RecordBatch.from_pydict(
            {"leaf": [leaf], "query_ids": [blob(np.array([i for i, _ in own], np.int64))], "queries": [blob(np.array([p for _, p in own]))]},
            schema=kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            for query_id, point in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("embedding"), size)):
                for leaf in best_bins(shared.value, point, visits):
                    own = waiting.setdefault(leaf, [])
                    own.append((query_id, point))
                    if len(own) == QUERY_BLOCK:
                        yield pack(leaf, waiting.pop(leaf))
        for leaf, own in waiting.items():
            yield pack(leaf, own)

    def compared(batches):
        best = Best(k)
        names = ["query_id", "vec_id", "score"]
        for batch in batches:
            for q_ids, q, ids, block in zip(*[batch.column(c).to_pylist() for c in ("query_ids", "queries", "ids", "points")]):
                for found in _nearest(np.frombuffer(q).reshape(-1, size), np.frombuffer(q_ids, np.int64),
                                      np.frombuffer(block).reshape(-1, size), np.frombuffer(ids, np.int64), k):
                    best.add(*found)
                if best.full():
                    yield best.taken(names)
        if best.size:
            yield best.taken(names)

    pairs = queries.mapInArrow(probes, "leaf long, query_ids binary, queries binary").join(index, "leaf")
    found = pairs.select("query_ids", "queries", "ids", "points").mapInArrow(compared, schema)
    return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
