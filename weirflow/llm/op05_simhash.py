"""SimHash near-duplicates by the generalised pigeonhole principle.

Texts become 64-bit fingerprints. Bits that vary together are grouped into m
partitions. A fingerprint q finds every fingerprint within distance t if its
partition thresholds t_i, each -1 (not probed) or more, satisfy
sum(t_i + 1) = t + 1: were each partition's distance over t_i, the sum would
pass t. For each fingerprint a dynamic program picks the thresholds with the
fewest expected candidates, from counts of partition values over all
fingerprints. Probes meet the index in buckets, where candidates are verified
on all 64 bits.

Work is on distinct fingerprints, so copies cost one row. In a bucket only the
links that join two groups not yet joined there leave the task (a spanning
forest), never all pairs; the forest has the components of all links. Buckets
with more than `bucket_rows` fingerprints are cut into chunks and every pair of
chunks meets in a task of its own.

Defined results: null and wordless texts have fingerprint 0 and link like any
other; repeated rows are rows of their own with one fingerprint; null ids never
become a component's id unless the component has no other; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table
from .components import connected_components

BITS = 64


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text. bytes.lower() and bytes.split() know
    ASCII only, as the definition of words asks."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), seed)
    join = b" ".join
    hashes = np.array([xxh64_intdigest(join(x), seed) for x in zip(*(words[k:] for k in range(width)), strict=False)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):  # 2 MB of bits at once
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep=("doc_id",), width: int = 3, name: str = "fp") -> DataFrame:
    """The kept columns and the fingerprint as a signed long."""
    kinds = [docs.schema[c] for c in keep]
    schema = T.StructType([*kinds, T.StructField(name, T.LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            prints = np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=[*keep, name])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    return source.mapInArrow(run, schema)


def correlated_groups(ones: np.ndarray, both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in m groups of about equal size: each group starts with the most
    correlated pair left and takes the bit most correlated with it until full."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        if len(left) == size:
            groups.append(sorted(left))
            break
        sub = corr[np.ix_(left, left)]
        group = [left[x] for x in np.unravel_index(int(np.argmax(sub)), sub.shape)]
        if group[0] == group[1]:
            group = left[:2]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(1)))])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def project(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a group, as an integer."""
    out = np.zeros(len(prints), np.uint64)
    for j, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most radius of width bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def partitions_for(n: int, distance: int, most: int = 4) -> int:
    """How many partitions cost least for n fingerprints of even bits."""

    def cost(m: int) -> float:
        width = BITS // m
        near = [len(ball(width, e)) for e in range(distance)]
        best = {0: 0.0}
        for _ in range(m):
            new: dict[int, float] = {}
            for s, c in best.items():
                for e in range(-1, min(distance, 3)):
                    add = 0 if e < 0 else near[e] * (1 + n / 2**width)
                    if s + e + 1 <= distance + 1:
                        new[s + e + 1] = min(new.get(s + e + 1, np.inf), c + add)
            best = new
        return best.get(distance + 1, np.inf)

    return min(range(2, most + 1), key=cost)


def allocate(costs: list[np.ndarray], distance: int) -> np.ndarray:
    """Thresholds (rows, m) with sum(t + 1) = distance + 1 of least total cost.
    costs[i][:, e + 1]: expected cost of threshold e of partition i, e from -1."""
    n, goal = len(costs[0]), distance + 1
    best = np.full((n, goal + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for c in costs:
        new, pick = np.full((n, goal + 1), np.inf), np.zeros((n, goal + 1), np.int8)
        for take in range(c.shape[1]):
            for s in range(take, goal + 1):
                value = best[:, s - take] + c[:, take]
                better = value < new[:, s]
                new[better, s] = value[better]
                pick[better, s] = take
        best = new
        picks.append(pick)
    out, s = np.zeros((n, len(costs)), np.int8), np.full(n, goal)
    for i in range(len(costs) - 1, -1, -1):
        take = picks[i][np.arange(n), s]
        out[:, i] = take - 1
        s = s - take
    return out


#: Bits of a partition's value that the table of counts tells apart; a wider partition's counts are shared out evenly.
COUNTED = 16


def cost_tables(counts: np.ndarray, widths: list[int], distance: int) -> list[np.ndarray]:
    """By partition a table (value, e + 1) of probes and expected candidates."""
    out = []
    for i, width in enumerate(widths):
        counted = min(width, COUNTED)
        values = np.arange(1 << counted)
        columns = [np.zeros(len(values))]
        for e in range(min(distance, 3)):
            near = sum(counts[i][values ^ mask] for mask in ball(counted, e)) / float(1 << (width - counted))
            columns.append(len(ball(width, e)) + near * (len(ball(width, e)) / len(ball(counted, e))))
        out.append(np.stack(columns, 1).astype(np.float32))
    return out


def spanning_links(key: np.ndarray, prints: np.ndarray, role: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within distance between a query (role 1) and an index row (role 2,
    both: 3) of one key, less those that join what is joined already."""
    order = np.argsort(key, kind="stable")
    key, prints, role = key[order], prints[order], role[order]
    nodes, at = np.unique(prints, return_inverse=True)
    parent = np.arange(len(nodes))
    root = parent.copy()
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    active, d = np.arange(len(key)), 1
    while True:
        active = active[active + d < len(key)]
        active = active[key[active] == key[active + d]]
        if not len(active):
            break
        a, b = active, active + d
        ok = (root[at[a]] != root[at[b]]) & (((role[a] & 1) & (role[b] >> 1)) | ((role[b] & 1) & (role[a] >> 1))).astype(bool)
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(prints[a] ^ prints[b]) <= distance
        joined = False
        for x, y in zip(at[a[ok]], at[b[ok]], strict=True):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
                joined = True
        if joined:
            root = parent.copy()
            while (root != root[root]).any():
                root = root[root]
        d += 1
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def links(prints: DataFrame, distance: int = 3, bucket_rows: int = 4096, group_rows: int = 50_000) -> DataFrame:
    """(fp), distinct -> (a, b): links whose components are those of all pairs
    within distance. prints is read three times and should be a table."""
    spark = prints.sparkSession
    n = prints.count()

    def together(batches):
        both, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for k in range(0, len(bits), 1 << 16):
                both += (bits[k : k + (1 << 16)].T @ bits[k : k + (1 << 16)]).astype(np.float64)
            rows += len(bits)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(both.ravel().astype(np.int64))], names=["k", "n"])

    sums = prints.mapInArrow(together, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # 4096 rows
    both = np.zeros(BITS * BITS)
    both[sums["k"]] = sums["n"]
    both = both.reshape(BITS, BITS)
    m = partitions_for(n, distance)
    groups = correlated_groups(np.diag(both), both, n, m)
    widths = [len(g) for g in groups]

    def values(batches):
        for batch in batches:
            x = np.asarray(batch.column(0)).view(np.uint64)
            for i, g in enumerate(groups):
                v, c = np.unique(project(x, g) & np.uint64((1 << COUNTED) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v.astype(np.int32)), pa.array(c)], names=["i", "v", "n"])

    found = prints.mapInArrow(values, "i int, v int, n bigint").groupBy("i", "v").agg(F.sum("n").alias("n")).toPandas()  # m * 2 ** 16 rows at most
    counts = np.zeros((m, 1 << COUNTED))
    counts[found["i"], found["v"]] = found["n"]
    tables = spark.sparkContext.broadcast((counts.astype(np.float32), cost_tables(counts, widths, distance)))  # about 5 MB at any size
    coarse = max(1, n * (m + 2) // group_rows)
    low = np.uint64((1 << COUNTED) - 1)

    def probes(batches):
        counted, costs = tables.value
        for batch in batches:
            x = np.asarray(batch.column(0)).view(np.uint64)
            v = [project(x, g) for g in groups]
            t = allocate([costs[i][(v[i] & low).astype(np.int64)] for i in range(m)], distance)
            for i in range(m):
                rows = [(v[i], x, np.where(t[:, i] >= 0, 3, 2))]
                for e in range(1, int(t[:, i].max(initial=0)) + 1):
                    q = t[:, i] >= e
                    rows += [(v[i][q] ^ np.uint64(mask), x[q], np.full(int(q.sum()), 1)) for mask in ball(widths[i], e) if mask.bit_count() == e]
                key, fp, role = (np.concatenate(c) for c in zip(*rows, strict=True))
                key = key | np.uint64(i) << np.uint64(56)
                # The table's count bounds the bucket's size; a large bucket's chunks meet pair by pair.
                chunks = np.maximum(1, np.ceil(counted[i][(key & low).astype(np.int64)] / bucket_rows)).astype(np.int64)
                own = (fp % np.uint64(1_000_003)).astype(np.int64) % chunks
                spread = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                for other in range(int(chunks.max(initial=1))):
                    has = chunks > other
                    a, b = np.minimum(own[has], other), np.maximum(own[has], other)
                    big = chunks[has] > 1
                    group = np.where(big, -1 - (spread[has].astype(np.int64) % (1 << 30) * 4096 * 64 + a * 4096 + b), (spread[has] % np.uint64(coarse)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(key[has].view(np.int64)), pa.array(fp[has].view(np.int64)), pa.array(role[has].astype(np.int32))], names=["g", "key", "fp", "role"])

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        a, b = spanning_links(g["key"].to_numpy(), g["fp"].to_numpy().view(np.uint64), g["role"].to_numpy(), distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.mapInArrow(probes, "g bigint, key bigint, fp bigint, role int").groupBy("g").applyInPandas(meet, "a bigint, b bigint")


def near_duplicates(prints: DataFrame, distance: int = 3, doc_id: str = "doc_id") -> DataFrame:
    """A table with doc_id and fp -> the same with component_id (least doc_id
    reached) and component_fp (least fingerprint reached)."""
    distinct = stored(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "prints")
    found = connected_components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    linked = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of = stored(linked, "linked")
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.select(F.col("fp").alias("__fp"), "component").join(ids, "component").select("__fp", "component_id", F.col("component").alias("component_fp"))
    return prints.join(of, F.col("fp") == F.col("__fp")).drop("__fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = stored(with_fingerprints(docs), "fingerprints")
    return near_duplicates(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
