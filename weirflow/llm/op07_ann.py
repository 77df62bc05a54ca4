"""Approximate nearest neighbours by adaptive dimension scan.

Largest inner products are nearest points once every row gets one more
component, sqrt(longest^2 - length^2), and every query a 0. Those points are
turned by a random rotation and dealt to the nearest of some centroids. A query
probes its nearest lists. Within a list, distances are summed block of columns
by block of columns. After a rotation the share of a squared distance that d of
D columns hold is a draw from Beta(d/2, (D-d)/2), so after each block the
hypothesis that a candidate is no farther than the query's bound is tested: it
is abandoned if its partial distance exceeds the bound times that law's quantile
at `CONFIDENCE`. Blocks are matrix products over all pairs until few pairs are
left, then only those are looked at. What survives is scored exactly, in double
precision on the original vectors.

A query's bound, the k-th least distance to a sample that every task has, comes
with it, so no list starts without one; its k nearest of that sample are found
at once and count like all others, so k rows are returned wherever there are as
many, and the sample's rows need not be in the lists. Lists are cut into chunks of about
`chunk_rows`, and the queries that probe a list into blocks of about
`query_rows`; each chunk meets each block in a group of its own, so neither a
list that a third of all rows share nor a list that many queries probe is one
task's work.

Centroids (about the square root of the rows, at most sample_rows / 8) and
bounds come from a sample of at most `sample_rows` vectors (a documented bound);
how many lists to probe comes from `test_queries` queries whose neighbours are
found among all rows, so that `list_recall` of those lie in the lists probed.
Every vector is indexed.

Sizes differ by any power: queries are brought to length 1 and rows measured in
units of the longest. Rows more than 2^FAR times as long as the median one would
drown the others in that; they form a list of their own that every query scans
in double precision.

Defined results: vectors that are null, zero, of another dimension than most or
hold a null or non-finite component take no part, nor do rows without an id;
rows that repeat an id are candidates one by one, but never of a query with that
id, and ask once (with the least vector, as bytes); scores beyond the range of a
double are what the sum of products gives, infinite or NaN, and NaN comes last;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, table

BLOCK = 16
#: Of the rows just at a query's bound, each test keeps this share.
CONFIDENCE = 0.99
#: Rows longer than the median by this power of 2 are scanned apart.
FAR = 4
#: From this share of pairs left on, pairs are looked at one by one.
SPARSE = 0.04
#: Rows of the sample that every task has, for bounds.
NEAR = 4096
#: Pairs of a group that are measured at once.
PAIRS = 1 << 20


def vectors(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, sizes) of a column of arrays; nulls inside become NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    starts = np.asarray(column.offsets, np.int64)[: len(column)]
    values = column.values.cast(pa.float64()).fill_null(np.nan)
    return np.asarray(values).astype(dtype), starts, sizes


def lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary logarithms of the lengths of rows, and the rows over powers of 2 that bring them near length 1."""
    x = x.astype(np.float64)
    power = np.frexp(np.abs(x).max(1, initial=0))[1]
    x = np.ldexp(x, -power[:, None])
    size = np.sqrt((x * x).sum(1))
    return power + np.log2(np.maximum(size, 1e-300)), x / np.maximum(size, 1e-300)[:, None]


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        starts = np.cumsum(n) - n
        sums = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
        centers[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centers


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared, of all rows of x to all of y."""
    out = x @ (-2 * y.T)
    out += (x * x).sum(1)[:, None]
    out += (y * y).sum(1)[None]
    return out


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[a : a + 1024], centers).argmin(1) for a in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def shares(dimensions: int, draws: int = 100_000) -> dict[int, float]:
    """By columns looked at: the quantile of the share of a squared distance that they hold."""
    rng = np.random.default_rng(0)
    found = {}
    for d in range(BLOCK, dimensions, BLOCK):
        a, b = rng.chisquare(d, draws), rng.chisquare(dimensions - d, draws)
        found[d] = float(np.quantile(a / (a + b), CONFIDENCE))
    return found


class Index:
    """Rotation, centroids, and a sample for bounds. `longest` is a binary logarithm."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, rows: np.ndarray, longest: float, lists: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.longest, self.rotation = longest, np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
        x = self.points(sample)
        self.centers = kmeans(x, max(1, min(lists, len(x) // 8)), seed=seed)
        self.shares = shares(d)
        some = rng.permutation(len(x))[:NEAR]
        self.near, self.near_vectors, self.near_ids, self.near_rows = x[some], sample[some], ids[some], rows[some]

    def points(self, x: np.ndarray) -> np.ndarray:
        """Rows as points, rotated."""
        size, unit = lengths(x)
        size = np.exp2(np.minimum(size - self.longest, 0))
        unit = (unit * size[:, None]).astype(np.float32)
        return np.column_stack([unit, np.sqrt(np.maximum(1 - size**2, 0)).astype(np.float32)]) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries as points, rotated."""
        return lengths(q)[1].astype(np.float32) @ self.rotation[:-1]

    def sampled(self, points: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each query: the k-th least distance to the sample less rows with
        its own id, and ids and scores of the k nearest of those."""
        d = distances(points, self.near)
        d[own_rows(ids, self.near_ids)] = np.inf
        n = min(k, d.shape[1])
        bound = np.partition(d, n - 1, axis=1)[:, n - 1] if n == k else np.full(len(q), np.inf, np.float32)
        pairs = np.nonzero((d <= bound[:, None] * (1 + 1e-4) + 1e-5) & np.isfinite(d))
        of, row, score = best_of(q, self.near_vectors, self.near_ids, k, pairs)
        cut = np.searchsorted(of, np.arange(1, len(q)))
        return bound, np.split(self.near_ids[row], cut), np.split(score, cut)

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists for each query (a point), nearest first."""
        return np.argsort(distances(q, self.centers), axis=1, kind="stable")


def groups_first(group: np.ndarray, n: int) -> np.ndarray:
    """Of rows sorted by group, which are among the first n of theirs."""
    start = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    return np.arange(len(group)) - np.repeat(start, np.diff(start, append=len(group))) < n


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, share: dict[int, float], k: int, never: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rows that may be among the k nearest of a query, by
    adaptive dimension scan; pairs in `never` are left out."""
    total = q.shape[1]
    partial = np.zeros((len(q), len(x)), np.float32)
    partial[never] = np.inf
    of = row = None
    for start in range(0, total, BLOCK):
        a, b = q[:, start : start + BLOCK], x[:, start : start + BLOCK]
        d = min(start + BLOCK, total)
        limit = bound * share.get(d, 1) * (1 + 1e-4) + 1e-5
        if of is None:
            partial += np.maximum(distances(a, b), 0)
            keep = partial <= limit[:, None]
            if d == total or np.count_nonzero(keep) <= SPARSE * keep.size:
                of, row = np.nonzero(keep)
                partial = partial[of, row]
        else:
            gap = b[row] - a[of]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            keep = partial <= limit[of]
            of, row, partial = of[keep], row[keep], partial[keep]
    keep = np.isfinite(partial)
    of, row, partial = of[keep], row[keep], partial[keep]
    # Equal distances differ by rounding; the exact scores decide between them.
    order = np.lexsort((partial, of))
    of, row, partial = of[order], row[order], partial[order]
    last = groups_first(of, k)
    bound = np.zeros(len(q), np.float32)
    np.maximum.at(bound, of[last], partial[last])
    keep = partial <= bound[of] * (1 + 1e-4) + 1e-5
    return of[keep], row[keep]


def scan_far(q: np.ndarray, x: np.ndarray, k: int, never: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rows of any length: by sign and logarithm of their inner products."""
    size, unit = lengths(x)
    s = lengths(q)[1] @ unit.T
    key = np.sign(s) * (1e5 + np.log2(np.maximum(np.abs(s), 1e-300)) + size[None])
    key[never] = -np.inf
    n = min(k, len(x))
    last = np.partition(key, len(x) - n, axis=1)[:, len(x) - n]
    return np.nonzero((key >= last[:, None] - 1e-9) & np.isfinite(key))


def own_rows(q_ids: np.ndarray, x_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a row with the same id."""
    order = np.argsort(x_ids, kind="stable")
    first, last = (np.searchsorted(x_ids[order], q_ids, side) for side in ("left", "right"))
    n = last - first
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(np.arange(len(q_ids)), n), order[at]


def best_of(q: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best of each query among the pairs, scored exactly, by query and then best first."""
    of, row = pairs
    with np.errstate(over="ignore", invalid="ignore"):
        score = (x[row].astype(np.float64) * q[of].astype(np.float64)).sum(1)  # row by row, so equal vectors score alike
    order = np.lexsort((x_ids[row], -np.where(np.isnan(score), -np.inf, score), np.isnan(score), of))
    best = order[groups_first(of[order], k)]
    return of[best], row[best], score[best]


def search(
    embeddings: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    sample_rows: int = 1 << 16, chunk_rows: int = 2048, query_rows: int = 4096, test_queries: int = 200, list_recall: float = 0.96, seed: int = 0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query."""
    spark = embeddings.sparkSession
    # Floats are kept as floats: scores of them as doubles are the same.
    kind = "<f4" if embeddings.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    wide = np.dtype(kind).itemsize
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & (F.size("v") > 0))

    def binary(x: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * x.shape[1] * wide), pa.py_buffer(np.ascontiguousarray(x, kind))]).cast(pa.binary()) if len(x) else pa.array([], pa.binary())

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    def clean(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            values, starts, sizes = vectors(batch.column(1), np.dtype(kind))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = values[starts[at][:, None] + np.arange(d)]
                fine = np.isfinite(x).all(1) & (x != 0).any(1)
                at, x = at[fine], x[fine]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), binary(x), batch.column(2).take(pa.array(at)), pa.array(np.arange(row, row + len(at))), pa.array(lengths(x)[0] if len(x) else np.zeros(0))], names=["id", "v", "asks", "row", "size"])
                row += len(at)

    rows = stored(rows.mapInArrow(clean, "id bigint, v binary, asks boolean, row bigint, size double"), "ann-vectors")
    most = rows.groupBy(F.octet_length("v").alias("d")).agg(F.count("*").alias("n"), F.percentile_approx("size", 0.5).alias("m")).orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.octet_length("v") == most.d)
    usual = rows.where(F.col("size") <= most.m + FAR)
    share = int(min(1.0, sample_rows / most.n) * (1 << 32))
    drawn = usual.where(F.pmod(F.xxhash64("id", "row"), F.lit(1 << 32)) < share).select("id", "v", "row").limit(sample_rows).toArrow()
    if not drawn.num_rows:
        drawn = usual.select("id", "v", "row").limit(sample_rows).toArrow()
    index = Index(matrix(drawn.column("v")), np.asarray(drawn.column("id")), np.asarray(drawn.column("row")), float(usual.agg(F.max("size")).first()[0]), round(float(np.sqrt(most.n))), seed)
    shared = spark.sparkContext.broadcast(vars(index))  # sample_rows / 8 centroids and NEAR sample rows at most
    far = len(index.centers)

    def known() -> Index:
        made = Index.__new__(Index)
        vars(made).update(shared.value)
        return made

    def deal(batches):
        index = known()
        for batch in batches:
            own = np.full(batch.num_rows, far)
            near = np.flatnonzero(np.asarray(batch.column(4)) <= most.m + FAR)
            if len(near):
                own[near] = nearest(index.points(matrix(batch.column(1).take(pa.array(near)))), index.centers)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own.astype(np.int32))], names=["id", "v", "asks", "row", "list"])

    dealt = stored(rows.mapInArrow(deal, "id bigint, v binary, asks boolean, row bigint, list int"), "ann-lists")
    counts = np.zeros(far + 1, np.int64)
    for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect():  # one row a list
        counts[r.list] = r.n
    queries = dealt.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    tests = queries.orderBy(F.xxhash64("id"), "id").limit(test_queries).toArrow()
    if not tests.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    probes = probes_for(dealt.where(F.col("list") < far), spark.sparkContext.broadcast((matrix(tests.column("v")), np.asarray(tests.column("id")))), known, matrix, k, list_recall)

    def ask(batches):
        index = known()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, q = np.asarray(batch.column(0)), matrix(batch.column(1))
            points = index.asked(q)
            bound, near, scores = index.sampled(points, q, ids, k)
            order = index.order(points)
            enough = (np.cumsum(counts[order], 1) <= k).sum(1) + 1  # more than k rows, its own among them
            lists = [np.append(o[: max(probes, n)], [far] if counts[far] else []).astype(np.int32) for o, n in zip(order, enough, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bound), pa.array(lists, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["id", "v", "bound", "lists", "near", "scores"])

    answers = stored(queries.mapInArrow(ask, "id bigint, v binary, bound float, lists array<int>, near array<bigint>, scores array<double>"), "ann-queries")
    sampled = answers.select(F.col("id").alias("query_id"), F.inline(F.arrays_zip(F.col("near").alias("vec_id"), F.col("scores").alias("score"))))
    asked = answers.select("id", "v", "bound", F.explode("lists").alias("list"))
    asking = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    chunks = np.maximum(1, -(-counts // chunk_rows))
    first = np.cumsum(chunks) - chunks
    sizes = [(x, int(first[x]), int(chunks[x]), -(-n // query_rows)) for x, n in sorted(asking.items())]
    sizes = F.broadcast(spark.createDataFrame(sizes, "list int, first bigint, chunks bigint, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    no_bound = F.lit(None).cast("float")
    inside = F.broadcast(spark.createDataFrame([(int(x),) for x in index.near_rows], "row bigint"))
    held = dealt.join(inside, "row", "left_anti").join(sizes, "list").select("id", "v", no_bound.alias("bound"), "list", (F.col("first") + F.col("row") % F.col("chunks")).alias("chunk"), every("blocks").alias("block"))
    asked = asked.join(sizes, "list").select("id", "v", "bound", "list", F.pmod(F.xxhash64("id", "list"), F.col("blocks")).cast("int").alias("block"), F.col("first").alias("first"), every("chunks").alias("nth"))
    asked = asked.select("id", "v", "bound", "list", (F.col("first") + F.col("nth")).alias("chunk"), "block")

    def meet(g: pa.Table) -> pa.Table:
        asks = np.asarray(g.column("bound").is_valid())
        ids, v, found = np.asarray(g.column("id")), matrix(g.column("v")), []
        x, x_ids, q, q_ids = v[~asks], ids[~asks], v[asks], ids[asks]
        if len(x) and len(q):
            index = known()
            away = g.column("list")[0].as_py() == far
            points = None if away else index.points(x)
            bound, step = np.asarray(g.column("bound"))[asks].astype(np.float32), max(1, PAIRS // len(x))
            for at in range(0, len(q), step):
                some, some_ids = q[at : at + step], q_ids[at : at + step]
                never = own_rows(some_ids, x_ids)
                pairs = scan_far(some, x, k, never) if away else scan(index.asked(some), points, bound[at : at + step], index.shares, k, never)
                of, row, score = best_of(some, x, x_ids, k, pairs)
                found.append((some_ids[of], x_ids[row], score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))

    hits = held.unionByName(asked).groupBy("chunk", "block").applyInArrow(meet, "query_id bigint, vec_id bigint, score double").unionByName(sampled)
    nan = F.isnan("score")
    order = W.partitionBy("query_id").orderBy(nan, F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def probes_for(rows: DataFrame, tests, known, matrix, k: int, list_recall: float) -> int:
    """How many lists the test queries must probe so that list_recall of their
    true neighbours among all rows lie in them. A task sends k rows a query."""

    def best(batches):
        index = known()
        q, ids = index.asked(tests.value[0]), tests.value[1]
        s, near = np.full((len(q), k), np.inf, np.float32), np.full((len(q), k), -1, np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = index.points(matrix(batch.column(1))), np.asarray(batch.column(2))
            for at in range(0, len(x), 4096):
                d = distances(q, x[at : at + 4096])
                d[own_rows(ids, np.asarray(batch.column(0))[at : at + 4096])] = np.inf
                s = np.column_stack([s, d])
                near = np.column_stack([near, np.broadcast_to(own[at : at + 4096], d.shape)])
                top = np.argpartition(s, k - 1, axis=1)[:, :k]
                s, near = np.take_along_axis(s, top, 1), np.take_along_axis(near, top, 1)
        of = np.repeat(np.arange(len(q), dtype=np.int32), k)
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(s.ravel().astype(np.float64)), pa.array(near.ravel())], names=["q", "d", "list"])

    found = rows.select("id", "v", "list").mapInArrow(best, "q int, d double, list int").where("list >= 0 AND d < double('inf')")
    found = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("d"))).where(F.col("n") <= k).select("q", "list").toArrow()  # k rows a test query
    if not found.num_rows:
        return 1
    order = known().order(known().asked(tests.value[0]))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    needed = np.sort(place[np.asarray(found.column("q")), np.asarray(found.column("list"))])
    return int(needed[int(np.ceil(list_recall * len(needed))) - 1]) + 1


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
