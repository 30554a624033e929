"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample, which grows with the table until it
reaches MOST_SAMPLE rows, so that leaves keep their size up to several million
rows; every row is assigned to a leaf.
Largest inner products become smallest distances by one more coordinate,
sqrt(M - |x|^2), with M the largest squared norm. A query goes down the tree
best bin first, through a priority queue of nodes by distance to their
centres. How many leaves it visits is calibrated: the visits are widened until
a bounded set of queries, compared with brute force over all rows, reaches the
asked recall; a query whose leaves hold too few rows goes on to further ones.

Leaves are searched exactly. Neighbouring leaves share a block of a bounded
number of rows, a large leaf has several; a query goes to each block once, with
the leaves that it visits there, and blocks meet a bounded number of queries at
a time. A query's first leaves give a score that the rest must reach, so that
blocks return little, and results are merged.

Defined results: vectors that are null, empty, zero, of another dimension
than most, or hold null or non-finite components take no part, nor do rows
without an id; rows that share an id count as one (the smallest of their
vectors); ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

#: Rows that the tree is fitted on, for small tables and at most, and queries of
#: the calibration.
LEAST_SAMPLE, MOST_SAMPLE, CALIBRATION_QUERIES = 20_000, 200_000, 200
#: Children of a node; rows of a leaf aimed at; sample rows of a leaf at least.
BRANCHES, LEAF_ROWS, LEAF_SAMPLE = 8, 400, 12
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
#: Leaves that give a query's first neighbours.
FIRST_LEAVES = 4


@dataclass
class Tree:
    """Centres and children by node; leaves have the numbers from 0."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    top: float

    @property
    def n_leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child, level by level."""
        x, out = self.lifted(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = _distances(x[rows], self.centres[kids]).argmin(axis=1)
            todo += [(int(k), rows[near == i]) for i, k in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray, n: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``n`` leaves, best bin first; more until they hold
        ``least`` rows, with ``sizes`` the rows of each leaf."""
        q = np.append(query, 0.0)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < n or held < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                held += 0 if sizes is None else int(sizes[out[-1]])
                continue
            kids = self.children[node]
            gap = self.centres[kids] - q
            for d, k in zip((gap * gap).sum(axis=1).tolist(), kids.tolist(), strict=True):
                heapq.heappush(queue, (d, k))
        return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(axis=1) - 2 * (x @ centres.T)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and assignment; k-means++ start, a few rounds of Lloyd."""
    centres = [x[rng.integers(len(x))]]
    gap = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and gap.sum() > 1e-12:
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(8):
        near = _distances(x, centres).argmin(axis=1)
        used = np.unique(near)
        centres = np.array([x[near == i].mean(axis=0) for i in used])
    return centres, _distances(x, centres).argmin(axis=1)


def fit_tree(sample: np.ndarray, n_rows: int, top: float) -> Tree:
    rng = np.random.default_rng(7)
    tree = Tree(np.zeros((0, 0)), [], np.zeros(0), top)
    x = tree.lifted(sample)
    size = max(LEAF_SAMPLE, LEAF_ROWS * len(x) / max(n_rows, 1))
    centres, children, leaf = [x.mean(axis=0)], [np.zeros(0, np.int64)], [-1]
    todo, n_leaves = [(0, x)], 0
    while todo:
        node, rows = todo.pop()
        kids, near = _k_means(rows, BRANCHES, rng) if len(rows) > size else (rows[:0], None)
        if len(kids) < 2:
            leaf[node], n_leaves = n_leaves, n_leaves + 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(kids))
        for i, c in enumerate(kids):
            todo.append((len(centres), rows[near == i]))
            centres.append(c)
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
    return Tree(np.array(centres), children, np.array(leaf), top)


def best(members: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray | None = None, able: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, member number and score of the ``k`` best per query, of
    those that score at least ``least`` and are ``able`` (a row a query)."""
    rough = queries @ members.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if able is not None:
        rough[~able] = -np.inf
    slack = 1e-9 * (1 + np.abs(members).max(initial=0) * np.abs(queries).max(initial=0) * members.shape[1])
    cut = np.full(len(queries), -np.inf) if least is None else least.copy()
    if rough.shape[1] > k:
        cut = np.maximum(cut, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k])
    who, what = np.nonzero((rough >= cut[:, None] - slack) & (rough > -np.inf))
    score = np.empty(len(who))
    for at in range(0, len(who), 65_536):  # summed row by row: equal vectors have equal scores
        part = slice(at, at + 65_536)
        score[part] = (members[what[part]] * queries[who[part]]).sum(axis=1)
    order = np.lexsort((ids[what], -score, who))
    who, what, score = who[order], what[order], score[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    keep = (rank < k) & (True if least is None else score >= least[who])
    return who[keep], what[keep], score[keep]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (doubles) of the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size[0] if size else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(batch, name: str = "v") -> np.ndarray:
    column = batch.column(name)
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _brute(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int, tree: Tree) -> list:
    """Leaves of the true neighbours of a bounded number of queries."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column("id").to_numpy(), _matrix(batch)
                leaf = tree.assign(x)
                who, what, score = best(x, ids, queries, query_ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[what]), pa.array(leaf[what]), pa.array(score)], names=["q", "id", "leaf", "score"])

    found = rows.mapInArrow(run, "q long, id long, leaf long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "leaf").collect()


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row for which
    ``is_query`` (over ``id``) holds, its ``k`` nearest other rows found."""
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors, id_col, vector_col), "ann-rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n_rows, top = rows.agg(F.count("*"), F.max(square)).first()
    if not n_rows:
        return spark.createDataFrame([], out_schema)

    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, n_rows * LEAF_SAMPLE // LEAF_ROWS))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(size).toArrow()
    tree = fit_tree(_matrix(sample), n_rows, float(top))
    probe = rows.filter(is_query).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION_QUERIES).toArrow()
    if not probe.num_rows:
        return spark.createDataFrame([], out_schema)
    probe_v, probe_ids = _matrix(probe), probe.column("id").to_numpy()
    order = [{leaf: i for i, leaf in enumerate(tree.visits(q, tree.n_leaves))} for q in probe_v]
    need = sorted(order[q][leaf] + 1 for q, leaf in _brute(rows, probe_v, probe_ids, k, tree))
    visits = need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] if need else 1

    shared = spark.sparkContext.broadcast(tree)

    def to_leaf(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(_matrix(batch))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("id"), batch.column("v")], names=["leaf", "id", "v"])

    def to_visits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows_of, first, parts = counted.value
        for batch in batches:
            blocks, leaves, owner, turn = [], [], [], []
            for i, q in enumerate(_matrix(batch) if batch.num_rows else ()):  # k rows and the query itself
                seen = np.array(shared.value.visits(q, visits, rows_of, k + 1))
                for late, own in ((False, seen[:FIRST_LEAVES]), (True, seen[FIRST_LEAVES:])):
                    leaf = np.repeat(own, parts[own])
                    at = np.repeat(first[own] - (np.cumsum(parts[own]) - parts[own]), parts[own]) + np.arange(len(leaf))
                    order = np.lexsort((leaf, at))
                    at, leaf = at[order], leaf[order].astype(np.int32)
                    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
                    blocks += at[cuts].tolist()
                    leaves += [part.tobytes() for part in np.split(leaf, cuts[1:])] if len(at) else []
                    owner += [i] * len(cuts)
                    turn += [late] * len(cuts)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column("id").take(take), batch.column("v").take(take), pa.array(leaves, pa.binary()), pa.array(turn, pa.bool_())], names=["block", "id", "v", "leaves", "late"])

    layout = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    members = written(rows.mapInArrow(to_leaf, layout), "ann-leaves")
    sizes = np.zeros(tree.n_leaves, np.int64)
    for leaf, n in members.groupBy("leaf").count().collect():  # at most MOST_SAMPLE / LEAF_SAMPLE
        sizes[leaf] = n
    first, parts = dealt(sizes)
    counted = spark.sparkContext.broadcast((sizes, first, parts))
    places = spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(len(sizes))], "leaf long, first long, parts long")
    members = members.join(F.broadcast(places), "leaf").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "leaf", "id", "v")
    asked = written(rows.filter(is_query).mapInArrow(to_visits, T.StructType([T.StructField("block", T.LongType()), *layout.fields[1:], T.StructField("leaves", T.BinaryType()), T.StructField("late", T.BooleanType())])), "ann-visits")
    early = asked.filter(~F.col("late")).withColumn("least", F.lit(float("-inf")))
    early = written(_top(_search(members, early, k), k), "ann-early")
    least = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("least"))
    later = asked.filter("late").join(least, F.col("id") == F.col("query_id"), "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return _top(early.drop("rank").union(_search(members, later, k)), k).select("query_id", "rank", "vec_id", "score")


def dealt(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each leaf and how many it has: small neighbours
    share one, leaves over BLOCK_ROWS have their own."""
    parts = np.maximum(1, -(-sizes // BLOCK_ROWS))
    first, block, held = np.zeros(len(sizes), np.int64), -1, BLOCK_ROWS
    for i, (n, own) in enumerate(zip(sizes.tolist(), parts.tolist(), strict=True)):
        if own > 1 or block < 0 or held + n > BLOCK_ROWS:
            block, held = block + 1, 0
        first[i] = block
        block += own - 1
        held = BLOCK_ROWS if own > 1 else held + n
    return first, parts


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search(members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best of each block that each query asks, of the leaves it visits;
    a bounded number of queries at a time.

    The table of counts has a row for each block, some BLOCK_ROWS rows.
    """
    many = asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("long").alias("by_queries"))
    left = members.join(many, "block").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("by_queries") - 1)))
    right = asked.join(many, "block").withColumn("b", F.pmod(F.xxhash64("id"), F.col("by_queries")))

    def search(own, wanted):
        import pyarrow as pa

        if not own.num_rows or not wanted.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids = own.column("id").to_numpy(), wanted.column("id").to_numpy()
        names, leaf = np.unique(own.column("leaf").to_numpy(), return_inverse=True)
        seen = [np.frombuffer(x, np.int32) for x in wanted.column("leaves").to_pylist()]
        at = np.searchsorted(names, np.concatenate(seen))
        at[at == len(names)] = 0
        visited = np.zeros((len(seen), len(names)), bool)
        row, want = np.repeat(np.arange(len(seen)), [len(x) for x in seen]), np.concatenate(seen)
        visited[row[names[at] == want], at[names[at] == want]] = True
        who, what, score = best(_matrix(own), ids, _matrix(wanted), query_ids, k, wanted.column("least").to_numpy(), visited[:, leaf])
        return pa.table({"query_id": query_ids[who], "vec_id": ids[what], "score": score})

    keys = ["block", "b"]
    return left.select(*keys, "leaf", "id", "v").groupBy(*keys).cogroup(right.select(*keys, "id", "v", "leaves", "least").groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("id") % 20 == 0)
