"""N-gram scoring with a log-frequency Bloom filter.

Training tokens are counted as words and as n-grams of 2 up to `order` tokens (a
document starts after an end, and no n-gram reaches further back). An n-gram's
count is quantised to a level of a logarithmic scale and the n-gram enters the
filter once for each level up to its own, so a count is read back by probing
level after level until one is missing; errors are one-sided and rarer with
every level. Probabilities discount an n-gram's count and give what that frees
to the shorter history:

    P(w | h) = max(c(hw) - D, 0) / C(h) + D * C(h)^(b - 1) * P(w | h less its first token)
    P(w) = (c(w) - D1) / N, or D1 * V / N for all words not in training together

D comes from the numbers of counts 1 and 2, by order. C(h)^b stands for how many
different tokens follow a history: b is the power at which these add up, over
all histories, to the n-grams there are. Words are counted exactly. Levels of
n-grams read back as their lower ends and of histories as their upper ends, so
quantising alone makes no probability greater.

Documents are held in batches of about `batch_tokens` tokens as numbers into
the batch's own sorted list of word hashes. Every batch sends its counts of
words, range of hashes by range, to be added up and gets the totals back in its
own order: a common word is one number a batch, and no task sees more than its
range. N-grams go the same way by ranges of their own hashes, so the n-grams
after a frequent word are spread like all others. Each range fills its own
segment of the filter.

A filter of n training tokens has at most n * (order - 1) * BITS_EACH bits (a
count of c has at most c levels). Where that bound is within `broadcast_bytes`,
the segments are broadcast and probed where the batches are. Beyond it no filter
is sent anywhere: each range probes its segment for all batches at once and
returns the levels in each batch's order. Both give the same scores.

Defined results: a null text has the end token only; repeated rows are scored
(and count in training) one by one; an id of null counts as empty text for the
split; without any training token scores are those of a uniform model over the
one unknown word: 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, stored, table

#: The end of a document as a token.
END = np.uint64(0xE7037ED1A0B428DB)
HASHES, BITS_EACH = 4, 10
#: Lower ends of the levels: whole numbers growing by about half; from level 1 on.
LEVELS = np.append(0, np.unique(np.floor(1.5 ** np.arange(64)).astype(np.int64)))
UPPER = np.append(LEVELS[1:] - 1, LEVELS[-1])
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * C2
    x = (x ^ (x >> np.uint64(29))) * C1
    return x ^ (x >> np.uint64(32))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The number of levels that a count reaches, 1 for counts of 1."""
    return np.searchsorted(LEVELS, counts, "right") - 1


def places(keys: np.ndarray, level: int, sizes):
    """The HASHES bits of (key, level) in segments of the given sizes. Keys are
    32 bits: a segment has those of one range, which tells the rest."""
    h = mix(keys.astype(np.uint64) + np.uint64(level * int(C2) & (1 << 64) - 1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield (((h + np.uint64(i) * step) & LOW) * sizes) >> np.uint64(32)


def build_segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A segment that holds the keys' quantised counts, all at least 1."""
    level = levels_of(counts)
    size = np.uint64(max(64, -(-int(level.sum()) * BITS_EACH // 64) * 64))
    bits = np.zeros(int(size), np.uint8)
    for k in range(1, int(level.max(initial=0)) + 1):
        for at in places(keys[level >= k], k, size):
            bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Segments of the filter, one after another."""

    def __init__(self, segments: bytes, sizes: list[int]):
        self.bits = np.frombuffer(segments, np.uint8)
        self.sizes = 8 * np.array(sizes, np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def levels(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Levels found by probing, 0 if none."""
        level = np.zeros(len(keys), np.uint8)
        alive = np.arange(len(keys))
        for k in range(1, len(LEVELS)):
            size, start = self.sizes[segment[alive]], self.starts[segment[alive]]
            found = np.ones(len(alive), bool)
            for at in places(keys[alive], k, size):
                at += start
                found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[found]
            if not len(alive):
                break
            level[alive] = k
        return level


def batches_of(docs: DataFrame, held_out: Column, doc_id: str, text: str, batch_tokens: int) -> DataFrame:
    """One row a batch: batch, doc (ids), held (flags), sizes (tokens), ids
    (compressed), hashes (sorted) and counts (of training tokens)."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("doc", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), *(T.StructField(x, T.BinaryType()) for x in ("ids", "hashes", "counts")), T.StructField("train_tokens", T.LongType())])

    def run(batches):
        import zstandard
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        pack = zstandard.ZstdCompressor(level=1).compress
        first, n = TaskContext.get().partitionId() << 32, count()

        def flush(found, doc_type):
            number: dict = defaultdict(count().__next__)
            number[None]  # the end is 0
            ids = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for _, _, words in found]
            sizes = np.array([len(x) + 1 for x in ids])
            flat = np.zeros(sizes.sum(), np.int32)
            ends = np.cumsum(sizes)
            mask = np.ones(len(flat), bool)
            mask[ends - 1] = False
            flat[mask] = np.concatenate(ids)
            hashes = np.fromiter((END if w is None else xxh64_intdigest(w, 1) for w in number), np.uint64, len(number))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            flat = rank[flat]
            held = np.array([x[1] for x in found])
            counts = np.bincount(flat[np.repeat(~held, sizes)], minlength=len(order)).astype(np.int64)
            values = [[first | next(n)], [[x[0] for x in found]], [held.tolist()], [sizes.tolist()], [pack(flat.tobytes())], [hashes[order].tobytes()], [pack(counts.tobytes())], [int(counts.sum())]]
            kinds = [pa.int64(), pa.list_(doc_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=schema.names)

        found, size, doc_type = [], 0, None
        for batch in batches:
            doc_type = batch.schema.field(0).type
            # A few rows at a time become Python objects.
            for doc, held, x in (row for k in range(0, batch.num_rows, 128) for row in zip(*(c.to_pylist() for c in batch.slice(k, 128).columns), strict=True)):
                words = (x or b"").lower().split()
                found.append((doc, held, words))
                size += len(words) + 1
                if size >= batch_tokens:
                    yield flush(found, doc_type)
                    found, size = [], 0
        if found:
            yield flush(found, doc_type)

    return docs.select(F.col(f"`{doc_id}`"), held_out, F.col(f"`{text}`").cast("binary")).mapInArrow(run, schema)


def add_up(held: DataFrame, ranges: int) -> DataFrame:
    """(batch, range, totals, types, ones, twos, levels): training counts over
    all batches of the batch's words in the range, in the batch's order. The
    others, of the range, stand in one of its rows; levels says how many words
    reach each level."""

    def send(batches):
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for b, hashes, counts in ((c[row].as_py() for c in batch.columns) for row in range(batch.num_rows)):
                h, c = np.frombuffer(hashes, np.uint64), np.frombuffer(unpack(counts), np.int64)
                r = range_of(h, ranges)
                cut = np.flatnonzero(np.diff(r, prepend=r[:1] + np.uint64(1)))
                end = [*cut[1:], len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(r[cut].astype(np.int64)), pa.array([b] * len(cut)), pa.array([h[s:e].tobytes() for s, e in zip(cut, end, strict=True)]), pa.array([pack(c[s:e].tobytes()) for s, e in zip(cut, end, strict=True)])], names=["range", "batch", "h", "c"])

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in g["h"]])
        c = np.concatenate([np.frombuffer(unpack(x), np.int64) for x in g["c"]])
        _, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, c).astype(np.int64)
        back, ends = total[at], np.cumsum([len(x) // 8 for x in g["h"]])
        one = np.arange(len(g)) == 0
        return pd.DataFrame({"batch": g["batch"], "range": g["range"], "totals": [pack(x.tobytes()) for x in np.split(back, ends[:-1])], "types": one * int((total > 0).sum()), "ones": one * int((total == 1).sum()), "twos": one * int((total == 2).sum()), "levels": [np.bincount(levels_of(total[total > 0]), minlength=len(LEVELS)).tolist(), *[None] * (len(g) - 1)]})

    sent = held.select("batch", "hashes", "counts").mapInArrow(send, "range bigint, batch bigint, h binary, c binary")
    return sent.groupBy("range").applyInPandas(meet, "batch bigint, range bigint, totals binary, types bigint, ones bigint, twos bigint, levels array<bigint>")


def grams(ids: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, order: int):
    """For 2 up to `order` tokens: (hashes of the n-grams that end at each
    token, whether the token has one). An n-gram starts with the end before the
    document at the earliest."""
    word = hashes[ids]
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(ids)) - np.repeat(starts, sizes)
    key = word
    for n in range(2, order + 1):
        before = np.empty_like(key)
        before[1:] = key[:-1]
        if n == 2:
            before[starts] = END
        key = mix(before * C1 + word)
        yield key, place >= n - 2


def count_grams(held: DataFrame, ranges: int, order: int, probe: bool) -> DataFrame:
    """By order and range: the segment (bits) with what the model needs to know
    of all its counts, or if `probe` that and the levels of each batch's n-grams
    in order of their hashes."""

    def send(batches):
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for row in range(batch.num_rows):
                b, flags, sizes, raw, hashes = (c[row].as_py() for c in batch.columns)
                sizes, h = np.array(sizes), np.frombuffer(hashes, np.uint64)
                learn = np.repeat(~np.array(flags), sizes)
                for n, (key, has) in enumerate(grams(np.frombuffer(unpack(raw), np.int32), h, sizes, order), 2):
                    has = has if probe else has & learn
                    key, at = np.unique(key[has], return_inverse=True)
                    if not len(key):
                        continue
                    times = np.bincount(at, learn[has], len(key)).astype(np.uint32)
                    r = range_of(key, ranges)
                    cut = np.flatnonzero(np.diff(r, prepend=r[:1] + np.uint64(1)))
                    end = [*cut[1:], len(key)]
                    low = (key & LOW).astype(np.uint32)
                    columns = [r[cut].astype(np.int64), np.full(len(cut), n, np.int32), np.full(len(cut), b)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([low[s:e].tobytes() for s, e in zip(cut, end, strict=True)], pa.binary()), pa.array([pack(times[s:e].tobytes()) for s, e in zip(cut, end, strict=True)], pa.binary())], names=["range", "n", "batch", "keys", "times"])

    def meet(g: pa.Table) -> pa.Table:
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        sent = [np.frombuffer(x.as_py(), np.uint32) for x in g.column("keys")]
        keys, at = np.unique(np.concatenate(sent), return_inverse=True)
        counts = np.bincount(at, np.concatenate([np.frombuffer(unpack(x.as_py()), np.uint32) for x in g.column("times")])).astype(np.int64)
        own = counts > 0
        bits = build_segment(keys[own], counts[own])
        levels = np.bincount(levels_of(counts[own]), minlength=len(LEVELS))
        stats = {"bits": len(bits), "ones": int((counts == 1).sum()), "twos": int((counts == 2).sum()), "kinds": int(own.sum()), "levels": levels.tolist()}
        batch, answer = [-1], [bits]
        if probe:
            found = Filter(bits, [len(bits)]).levels(keys, np.zeros(len(keys), np.int64))[at]
            batch, answer = [-1, *g.column("batch").to_pylist()], [b"", *(pack(x.tobytes()) for x in np.split(found, np.cumsum([len(x) for x in sent])[:-1]))]
        rest = len(batch) - 1
        return pa.table(
            [pa.array([g.column("n")[0].as_py()] * len(batch), pa.int32()), pa.array([g.column("range")[0].as_py()] * len(batch), pa.int64()), pa.array(batch, pa.int64()), pa.array(answer, pa.binary()), *(pa.array([stats[x], *[0] * rest], pa.int64()) for x in ("bits", "ones", "twos", "kinds")), pa.array([stats["levels"], *[None] * rest], pa.list_(pa.int64()))],
            names=["n", "range", "batch", "answer", "bits", "ones", "twos", "kinds", "levels"],
        )

    sent = held.select("batch", "held", "sizes", "ids", "hashes").mapInArrow(send, "range bigint, n int, batch bigint, keys binary, times binary")
    return sent.groupBy("range", "n").applyInArrow(meet, "n int, range bigint, batch bigint, answer binary, bits bigint, ones bigint, twos bigint, kinds bigint, levels array<bigint>")


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones else 0.5


def growth(kinds: int, values: np.ndarray, numbers: np.ndarray) -> float:
    """The power b at which histories of the given counts have `kinds` different followers in all."""
    low, high = 0.0, 1.0
    for _ in range(40):
        b = (low + high) / 2
        low, high = (low, b) if float((numbers * np.maximum(values, 1) ** b).sum()) > kinds else (b, high)
    return (low + high) / 2


def probability(counts: np.ndarray, context: np.ndarray, rest: np.ndarray, d: float, b: float) -> np.ndarray:
    """P(w | h) from c(hw), C(h) and the probability after the shorter history."""
    c = np.maximum(context, 1).astype(np.float64)
    found = np.maximum(np.minimum(counts, c) - d, 0) / c + np.minimum(d * c ** (b - 1), 1) * rest
    return np.where(context > 0, np.minimum(found, 1), rest)


def score(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = 3, batch_tokens: int = 400_000, range_words: int = 500_000, range_grams: int = 1_000_000, broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. held_out is a condition on the columns of docs."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    held = stored(batches_of(docs, held_out, doc_id, text, batch_tokens), "lm-batches")
    tokens, words = held.agg(F.sum("train_tokens"), F.sum(F.octet_length("hashes") / 8)).first()
    n_all, ranges = int(tokens or 0), max(1, int((words or 0) // range_words))
    totals = stored(add_up(held, ranges), "lm-totals")
    types, ones, twos = (int(x or 0) for x in totals.agg(F.sum("types"), F.sum("ones"), F.sum("twos")).first())
    d1 = discount(ones, twos)
    word_levels = totals.where("levels IS NOT NULL").select(F.posexplode("levels").alias("level", "k")).groupBy("level").agg(F.sum("k").alias("k")).collect()  # a row a level
    parts = max(1, n_all // range_grams)
    broadcast = n_all * (order - 1) * BITS_EACH // 8 <= broadcast_bytes
    counted = stored(count_grams(held, parts, order, not broadcast), "lm-grams")
    # Of every order: its discount, and the growth of what follows the histories one shorter.
    known = {r.n: r for r in counted.groupBy("n").agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos"), F.sum("kinds").alias("kinds")).collect()}
    spread = counted.where("levels IS NOT NULL").select("n", F.posexplode("levels").alias("level", "k")).groupBy("n", "level").agg(F.sum("k").alias("k")).collect()  # a row a level
    numbers = {n: np.zeros(len(LEVELS)) for n in range(1, order + 1)}
    for r in word_levels:
        numbers[1][r.level] += r.k
    for r in spread:
        numbers[r.n][r.level] += r.k
    middle = np.sqrt(LEVELS * np.maximum(UPPER, 1.0))
    model = {n: (discount(known[n].ones, known[n].twos), growth(known[n].kinds, middle, numbers[n - 1])) if n in known else (0.5, 1.0) for n in range(2, order + 1)}
    shared = None
    if broadcast:
        found = {(r.n, r.range): r.answer for r in counted.select("n", "range", "answer").collect()}  # within broadcast_bytes, by the bound above
        blobs = {}
        for n in range(2, order + 1):
            segments = [bytes(found.pop((n, r), bytes(8))) for r in range(parts)]
            blobs[n] = b"".join(segments), [len(x) for x in segments]
        shared = spark.sparkContext.broadcast(blobs)
        del blobs, found

    answers = totals.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("range", "totals"))).alias("answers"))  # as many as the batch has words
    joined = held.select("batch", "doc", "held", "sizes", "ids", "hashes").join(answers, "batch")
    if broadcast:
        joined = joined.withColumn("grams", F.lit(None).cast("array<struct<n:int,range:bigint,answer:binary>>"))
    else:
        returned = counted.where("batch >= 0").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("n", "range", "answer"))).alias("grams"))  # as many as the batch has n-grams
        joined = joined.join(returned, "batch", "left")
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        filters = {n: Filter(*x) for n, x in shared.value.items()} if shared is not None else {}
        for batch in batches:
            doc_type = batch.schema.field(1).type.value_type
            for row in range(batch.num_rows):
                _, doc, flags, sizes, raw, hashes, back, returned = (c[row].as_py() for c in batch.columns)
                sizes, h = np.array(sizes), np.frombuffer(hashes, np.uint64)
                starts = np.cumsum(sizes) - sizes
                ids = np.frombuffer(unpack(raw), np.int32)
                c = np.concatenate([np.frombuffer(unpack(x["totals"]), np.int64) for x in back])
                p = (np.where(c > 0, (c - d1) / max(n_all, 1), d1 * types / max(n_all, 1)) if n_all else np.ones(len(c)))[ids]
                base_word = np.log10((c + 1) / (n_all + types + 1))
                end = np.searchsorted(h, END)
                context = c[np.append(end, ids[:-1])]
                context[starts] = c[end]
                for n, (key, has) in enumerate(grams(ids, h, sizes, order), 2):
                    key, at = np.unique(key[has], return_inverse=True)
                    if returned is not None or not filters:
                        own = [np.frombuffer(unpack(x["answer"]), np.uint8) for x in returned or () if x["n"] == n]
                        level = np.concatenate(own) if own else np.zeros(0, np.uint8)
                    else:
                        level = filters[n].levels(key & LOW, range_of(key, parts).astype(np.int64))
                    level = level[at]
                    p[has] = probability(LEVELS[level], context[has], p[has], *model[n])
                    # The history of the next token, one longer.
                    upper = np.zeros(len(ids), np.int64)
                    upper[has] = UPPER[level] * (level > 0)
                    context = np.append(0, upper[:-1])
                    context[starts] = 0
                sums = [np.add.reduceat(x, starts) for x in ((c[ids] > 0).astype(np.int64), base_word[ids], np.log10(np.maximum(p, 1e-300)))]
                yield pa.RecordBatch.from_arrays([pa.array(doc, doc_type), pa.array(flags), pa.array(sizes.astype(np.int64)), *map(pa.array, sums)], names=schema.names)

    out = joined.mapInArrow(run, schema)
    return out.select(F.col("doc_id").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 7) == 2


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id")))
