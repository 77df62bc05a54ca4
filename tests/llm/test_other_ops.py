"""SimHash, WARC, nearest neighbours, mixing, components, the pipeline: against plain versions."""

import base64
import collections
import hashlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from weirflow.llm import op05_simhash as sim
from weirflow.llm import op06_warc as warc
from weirflow.llm import op07_ann as ann
from weirflow.llm import op09_mixing as mixing
from weirflow.llm.common import new_path, stored
from weirflow.llm.components import connected_components


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(0, 5))
def test_fingerprint(text, more):
    text += " Ab c\tD" * more
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    assert sim.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_have_all_components(spark, bucket):
    rng = np.random.default_rng(2)
    prints = set(rng.integers(0, 1 << 63, 300).tolist())
    for center in list(prints)[:20]:
        for _ in range(20):
            x = center
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                x ^= 1 << int(b)
            prints.add(x)
    prints |= {0, 7, 3 << 40}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = stored(spark.createDataFrame([(x,) for x in signed], "fp bigint"), "t")
    a = np.array(sorted(signed))
    pairs = [(int(a[i]), int(a[j])) for i in range(len(a)) for j in np.nonzero(np.bitwise_count((a[i] ^ a[i + 1 :]).view(np.uint64)) <= 3)[0] + i + 1]
    want = components(signed, pairs)
    got = {x: x for x in signed} | {r.node: r.component for r in connected_components(sim.links(df, 3, bucket, 500)).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, "  "), (8, "same text here ok"), (2, "Same TEXT here ok"), (2, "Same TEXT here ok"), (None, "same text here ok"), (None, "alone in the whole wide world")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("x"), "least": F.lit(1)})
    out = sim.near_duplicates(stored(sim.with_fingerprints(df), "t")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in out if r.component_id is not None) == [(-1, 2), (2, 2), (2, 2), (3, 3), (5, 3), (8, 2), (9, 3)]
    assert len(out) == len(rows)
    assert sim.near_duplicates(stored(sim.with_fingerprints(df.where("false")), "t")).count() == 0


@given(st.integers(1, 60), st.integers(0, 100))
@settings(max_examples=25, deadline=None)
def test_thresholds_are_the_cheapest(n, seed):
    rng = np.random.default_rng(seed)
    costs = [np.column_stack([np.zeros(n), np.cumsum(rng.random((n, 3)), 1)]) for _ in range(4)]
    t = sim.allocate(costs, 3)
    assert (t.sum(1) + 4 == 4).all()
    best = np.min([sum(c[:, e + 1] for c, e in zip(costs, combo, strict=True)) for combo in np.ndindex(4, 4, 4, 4) if sum(combo) == 4 for combo in [tuple(x - 1 for x in combo)]], axis=0)
    assert np.allclose(sum(c[np.arange(n), t[:, i] + 1] for i, c in enumerate(costs)), best)


def test_warc_round_trip(spark):
    body = "<html>" + "repeated words and more " * 30
    rows = [(1, "http://a", body), (5, "http://b\r\nX: y", body), (3, None, None), (4, "u", ""), (7, "u", "x" * 300_000), (8, "ü", "naïve\r\n\r\nWARC/1.1"), (9, "d", "dup"), (9, "d", "dup"), (None, "n", "lonely")] + [(100 + k, "u", f"{body}{k}") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"archive": F.lit(1), "offset": F.lit(2)})
    index = warc.write_archives(pages, new_path(spark, "t"), archive_bytes=4000)
    assert index.select("archive").distinct().count() > 1
    out = warc.read_records(index).collect()
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.page_id].append(r)
    for i, _, h in rows:
        r, raw = by[i][0], (h or "").encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        of = last.get(h or "")
        assert (r.record_type, r.refers_to) == (("response", None) if i is None or of == i else ("revisit", of))
    one = index.where("page_id = 8").first()
    at, length, raw = next(x for x in warc.scan_archive(one.archive) if x[0] == one.offset)
    assert length == one.length and warc.parse(raw)[1].decode() == "naïve\r\n\r\nWARC/1.1"
    first = open(one.archive.removeprefix("file://"), "rb").read(4)
    assert first == b"\x5d\x2a\x4d\x18"
    ids = [f["warc-record-id"] for a in index.select("archive").distinct().collect() for f, _ in warc.read_archive(a.archive)]
    assert len(set(ids)) == len(rows), "repeated rows are records of their own"
    read = warc.read_records(index)
    assert read.rdd.getNumPartitions() == index.select("archive").distinct().count()
    none = warc.write_archives(pages.where("false"), new_path(spark, "t"))
    assert warc.read_records(none).count() == 0


def test_neighbours_of_repeated_ids(spark):
    """40 rows of the query's own id take no place of its 10 neighbours."""
    rng = np.random.default_rng(6)
    x = 1 + 0.1 * rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[0].tolist())] * 39
    out = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, k=10).collect()
    got = [r.vec_id for r in sorted(out, key=lambda r: r["rank"])]
    s = x @ x[0]
    assert len(got) == 10 and len(set(got) & set(np.argsort(-s[1:])[:10] + 1)) >= 9


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    x = (centers[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:400] = x[100]  # a third of a list and more is one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (2080, [1.0] * 3), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumns({"id": F.lit("x"), "v": F.lit(1), "asks": F.lit(2)})
    out = ann.search(df, F.col("vec_id") % 20 == 0, k=10, sample_rows=800, chunk_rows=100).collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    hit, wide = 0, x.astype(np.float64)
    for q, found in got.items():
        s = (wide * wide[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:10]
        hit += len({v for v, _ in found} & set(best.tolist()))
        assert all(score == pytest.approx(s[v], abs=1e-12) for v, score in found) and len(found) == 10
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hit / 10 / len(got) > 0.9
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") == 0, k=10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def neighbours(out):
    got = collections.defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    return got


def plain_neighbours(x, queries, k):
    s = x @ x[queries].T
    s[queries, np.arange(len(queries))] = -np.inf
    return {q: np.lexsort((np.arange(len(x)), -s[:, j]))[:k].tolist() for j, q in enumerate(queries)}


def test_neighbours_of_any_length(spark):
    """Vectors from 1e-200 to 1e200 drown no others, and ask like others."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)) * np.exp(rng.normal(0, 0.5, 600))[:, None]
    x[5], x[25], x[20], x[40] = x[5] * 1e150, x[25] * 1e100, x[20] * 1e-200, x[40] * 1e140
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got, want = neighbours(ann.search(df, F.col("vec_id") % 20 == 0, k=10)), plain_neighbours(x, list(range(0, 600, 20)), 10)
    assert all(len(v) == 10 for v in got.values()) and got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) for q in want]) > 9
    assert all(got[q][0] == want[q][0] for q in want)
    huge = spark.createDataFrame([(k, [1e200 if k == 3 else float(v) for v in row]) for k, row in enumerate(rng.normal(size=(400, 4)))], "vec_id bigint, embedding array<double>")
    out = ann.search(huge, F.col("vec_id") % 20 == 0, k=5)
    assert out.count() == 100


def test_equal_neighbours_of_many_chunks(spark):
    """Ties go to the smaller id, also where equal vectors lie in different chunks; one row a third of the table."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[100:250] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows + [rows[7]] * 150, "vec_id bigint, embedding array<double>")
    got = neighbours(ann.search(df, F.col("vec_id") == 100, k=12, chunk_rows=16, query_rows=1))
    assert got[100][:12] == list(range(101, 113))
    got = neighbours(ann.search(df, F.col("vec_id").isin(7, 20), k=6, chunk_rows=16))
    assert len(got[7]) == 6 and 7 not in got[7]


def test_recall_against_all_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.zeros((df.count(), 64))
    for r in df.collect():
        x[r.vec_id] = r.embedding
    got, want = neighbours(ann.op7_ann(spark, "/root/testdata/sf0.1")), plain_neighbours(x, list(range(0, len(x), 20)), 20)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.93


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing_of_rows_with_one_id(spark):
    """A third of the rows are one document: no task gets them all, and sums are those of rows apart."""
    rows = [(5, 4, "a")] * 3000 + [(k, 1 + k % 7, "ab"[k % 2]) for k in range(100, 6000)] + [(None, 2, "b")] * 700
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint, source string")
    run = lambda **kw: sorted((r.doc_id is None, r.doc_id or 0, r.size, r.taken, r.target, tuple(r.finish)) for r in mixing.mix(df, F.col("size"), F.col("source"), **kw).collect())
    apart, crowd = run(hot=1 << 20), run(hot=2, range_rows=64)
    assert len(crowd) == len(rows) and crowd == apart
    assert run(hot=2, range_rows=64) == crowd


def test_mixing(spark):
    rng = np.random.default_rng(6)
    names = ["b", "a", None, "Z", "é", "hot"]
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 30))) or None, names[5] if k % 3 == 0 else names[k % 5]) for k in range(3000)]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id bigint, text string, source string")
    run = lambda: mixing.mix(df.withColumn("taken", F.lit(1)), mixing.word_count(F.col("text")), F.col("source"), with_columns=("doc_id", "source"), range_rows=50).collect()
    out = run()
    sizes = collections.Counter()
    for _, t, s in [*rows, rows[0], rows[0]]:
        sizes[s] += len((t or "").split())
    want, taken = plain_targets(sizes), collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert sum(taken.values()) == sum(sizes.values()) * 3 // 2
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, run())) == sorted(map(key, out))
    # Finish times are the running sizes of a source over its target, epoch after epoch.
    by = collections.defaultdict(list)
    for r in out:
        by[r.source] += [(f, r["size"]) for f in r.finish or [] if r["size"]]
    for s, found in by.items():
        ends = np.cumsum([n for _, n in sorted(found)])
        assert np.allclose([f for f, _ in sorted(found)], ends / want[s])


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    one = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    for df, n in ((empty, 0), (one, 2)):
        out = mixing.mix(df, mixing.word_count(F.col("text")), F.col("source"), with_columns=("doc_id",)).collect()
        assert len(out) == n and all(r.taken == 0 and r.target == 0 for r in out)


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "simhash", "mixing", "packing"]
    start = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "1234 .. 5", "en", "src0", 9)], start.schema)
    copy = start.where("doc_id = 0").withColumn("doc_id", F.lit(10_003).cast("bigint"))
    docs, kept = stored(start.unionByName(extra).unionByName(copy), "t"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        kept.append(docs)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = [{r.doc_id for r in d.select("doc_id").distinct().collect()} for d in kept]
    assert 10_001 not in ids[0] and 10_002 not in ids[0] and 10_003 in ids[0] and 10_003 not in ids[1]
    assert ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    prints = sim.near_duplicates(stored(sim.with_fingerprints(kept[1]), "t"))
    assert ids[2] == {r.component_id for r in prints.collect()} and kept[2].count() == len(ids[2])
    most = max(r.n for r in kept[3].groupBy("doc_id").count().withColumnRenamed("count", "n").collect())
    assert most == 2
    words = lambda d: d.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words(kept[3]) == pytest.approx(1.5 * words(kept[2]), rel=0.02)
    assert kept[4].where("start = 0").count() == kept[3].count()
