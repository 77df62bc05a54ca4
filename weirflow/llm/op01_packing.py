"""Packing documents into sequences as a cutting-stock problem.

Documents are tokenised; each is cut into full sequences and a rest, and a rest
longer than half a sequence into one half and what is left (rests of 600 tokens
alone could not be packed without 40 % padding). A length histogram of at most
`capacity` classes then describes all that must be packed, at any corpus size.

On that histogram the driver solves the linear program of cutting stock by
column generation: a revised simplex method over patterns (how many pieces of
each class one sequence holds), new patterns priced by the dual values with an
unbounded knapsack dynamic program. Patterns are rounded down, what is left
over is packed by best fit, and the result is a table of patterns with their
numbers of use. Pieces are ranked within their length class and the rank alone
tells each piece its sequence, so assignment is one broadcast of the (bounded)
pattern table and no search.

Ranks come in two levels, counts by class and salt and row numbers within one
salt, so a length that a third of all pieces share is not one task's work; the
salt is drawn from a number that each piece has for itself, so repeated rows
are dealt apart too.

Defined results: a null or empty text is the end token alone; repeated rows are
documents of their own; a null id packs like any other; an empty table gives an
empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import release, row_salt, salts, stored, table

CAPACITY = 1024
END = 0
#: Bytes of ids that a batch of pieces holds before it is sent on.
HELD = 16 << 20
#: Rows that are taken from a batch at once.
SLICE = 1024


#: Classes of bytes: other, ASCII letters, digits and signs; first bytes of characters that may be white space; blank or line feed; other white space.
OTHER, LETTER, DIGIT, SIGN, LEAD, BLANK, WHITE = range(7)
#: Fixed value: how the byte-level vocabulary splits text before its merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[33:127] = SIGN
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[[0xC2, 0xE1, 0xE2, 0xE3]] = LEAD
    kind[[9, 11, 12, 13, 28, 29, 30, 31]] = WHITE
    kind[[10, 32]] = BLANK
    return kind


def _starts() -> np.ndarray:
    """Whether a part starts between bytes of two classes, at 8 * first + second."""
    out = np.zeros((8, 8), bool)
    for a in (LETTER, DIGIT, SIGN):
        for b in (LETTER, DIGIT, SIGN):
            out[a, b] = a != b
    out[: LEAD + 1, BLANK] = True
    return out.ravel()


KINDS, STARTS = _kinds(), _starts()


def classes(data: np.ndarray) -> np.ndarray:
    kind = KINDS[data]
    at = np.flatnonzero(kind == LEAD)
    kind[at] = OTHER
    a, b, c = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
    wide = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    short = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    for k in range(3):
        kind[np.minimum(at[wide] + k, len(data) - 1)] = WHITE
    for k in range(2):
        kind[np.minimum(at[short] + k, len(data) - 1)] = WHITE
    return kind


def cuts(data: np.ndarray) -> np.ndarray:
    """Bytes before which the tokenizer always splits, whatever follows or comes before them."""
    kind = classes(data)
    out = np.zeros(len(data), bool)
    out[1:] = STARTS[kind[:-1] << 3 | kind[1:]]
    # An apostrophe and letters may be one token.
    out[1:] &= (data[:-1] != 39) | (kind[1:] != LETTER)
    return out


def byte_level(path: str):
    """(tiktoken encoding, bytes of each id) of the file of a byte-level
    tokenizer whose ids are in order of its merges and that does nothing else
    to a text; None for any other."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, split = made["model"], made["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or made["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    # Bytes that print stand for themselves, the others for characters from 256 on.
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    special = {x["content"] for x in made["added_tokens"]}
    vocab = {x: i for x, i in model["vocab"].items() if x not in special}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    merged = [vocab.get(a + b) for a, b in pairs]
    if any(set(x) - byte_of.keys() for x in vocab) or merged != sorted(set(merged) - {None}) or len(vocab) != 256 + len(pairs):
        return None
    ranks = {bytes(map(byte_of.__getitem__, x)): i for x, i in vocab.items()}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def whole_texts(path: str):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer, None


class BlockTokenizer:
    """Token ids of whole texts, each different part of a block of texts encoded once.

    The tokenizer splits text before its merges, so a text can be cut where it
    always splits: before a blank or line feed after a character that is no
    white space, and between ASCII letters, digits and other signs (but not
    between an apostrophe and a letter). The parts of a block are a dictionary
    array over its bytes; its different values are encoded together, a line
    feed between them, and told apart by the bytes that each token stands for.
    Parts with other white space are encoded one by one. Nothing is kept from
    block to block but the vocabulary.

    Merges are applied by tiktoken, which takes a third of the time, with the
    vocabulary of the tokenizers file given. That holds for byte-level files
    whose merges are in order of their ids; texts are encoded whole by
    `tokenizers` with any other file.
    """

    def __init__(self, path: str, block: int = 4 << 20):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        held = vars(tokenizers).setdefault("_held_by_path", {})
        if path not in held:
            held.clear()
            held[path] = byte_level(path) or whole_texts(path)
        self.encoding, self.sizes = held[path]
        self.block = block

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, a null being empty, as little-endian unsigned 32-bit numbers."""
        if self.sizes is None:
            for x in texts:
                yield np.array(self.encoding.encode(x.as_py() or "", add_special_tokens=False).ids, "<u4")
            return
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + self.block, "right")) - 1)
            own = bounds[first : last + 1] - bounds[first]
            part = data[bounds[first] : bounds[last]]
            if len(part) > 2 * self.block:  # one text
                yield np.concatenate([self.ids(x, np.array([0, len(x)]))[0] for x in self.windows(part)])
            else:
                ids, ends = self.ids(part, own)
                yield from np.split(ids, ends[:-1])
            first = last

    def windows(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A long text in windows that end at cuts."""
        while len(data) > self.block:
            at, more = np.zeros(0, np.int64), self.block
            while not len(at) and more < len(data):
                at = np.flatnonzero(cuts(data[:more]))
                more *= 2
            end = int(at[-1]) if len(at) else len(data)
            yield data[:end]
            data = data[end:]
        if len(data):
            yield data

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where in them each text ends."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(bounds) - 1, np.int64)
        cut = np.append(cuts(data), True)
        cut[bounds] = True
        at = np.flatnonzero(cut)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        flat, sizes = self.encode(parts.dictionary)
        code = parts.indices.to_numpy()
        n = sizes[code]
        ends = np.cumsum(n)
        # The k-th id of a part stands k places after its first.
        move = np.repeat(((np.cumsum(sizes) - sizes)[code] - (ends - n)).astype(np.int32), n)
        move += np.arange(len(move), dtype=np.int32)
        total = np.append(0, ends)
        return flat[move], total[np.searchsorted(at, bounds[1:])]

    def encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after another, and how many each has."""
        at = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1]
        data = np.frombuffer(parts.buffers()[2], np.uint8)
        white = (classes(data) >= BLANK).astype(np.int64)
        count_to = np.append(0, np.cumsum(white))
        leads = classes(data[at[:-1]]) == BLANK
        plain = (count_to[at[1:]] - count_to[at[:-1]] == leads) & (np.diff(at) > leads)
        sizes = np.zeros(len(parts), np.int64)
        odd = {int(k): np.array(self.encoding.encode_ordinary(parts[int(k)].as_py().decode()), "<u4") for k in np.flatnonzero(~plain)}
        own = np.flatnonzero(plain)
        if odd:
            parts = parts.filter(pa.array(plain))
            at, data = (np.frombuffer(parts.buffers()[k], t) for k, t in ((1, np.int64), (2, np.uint8)))
            at = at[: len(parts) + 1]
        found = []
        for k in range(0, len(own), 65536):
            some = at[k : k + 65537]
            raw = np.insert(data[some[0] : some[-1]], some[1:] - some[0], 10).tobytes()
            ids = np.array(self.encoding.encode_ordinary(raw.decode()), "<u4")
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), some[1:] - some[0] + np.arange(1, len(some))) + 1  # with the line feed
            sizes[own[k : k + 65536]] = np.diff(ends, prepend=0) - 1
            keep = np.ones(len(ids), bool)
            keep[ends - 1] = False
            found.append(ids[keep])
        flat = np.concatenate(found) if found else np.zeros(0, "<u4")
        if odd:
            before = np.searchsorted(own, list(odd))
            place = np.append(0, np.cumsum(sizes[own]))[before]
            for k, x in odd.items():
                sizes[k] = len(x)
            flat = np.insert(flat, np.repeat(place, [len(x) for x in odd.values()]), np.concatenate(list(odd.values())))
        return flat, sizes


def pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, __row (a
    number of the piece's own, to deal equal rows apart), and the ids themselves
    (binary) if with_ids. A document of n tokens gives n // capacity full
    pieces, then one of capacity // 2 if more is left, then the rest."""
    fields = [docs.schema[doc_id], *(T.StructField(x, T.LongType(), False) for x in ("start", "length", "ids_crc32", "doc_tokens", "__row"))]
    names = [f.name for f in fields] + ["ids"] * with_ids
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    half = capacity // 2

    def run(batches):
        from pyspark import TaskContext

        encode = BlockTokenizer(tokenizer_path)
        row = TaskContext.get().partitionId() << 40
        # A few rows at a time: memory follows the block and the longest text, not the batch.
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            at, columns, held = [], [[] for _ in range(6)], 0
            for k, ids in enumerate(encode(batch.column(1))):
                raw = ids.tobytes() + END.to_bytes(4, "little")
                n = len(raw) // 4
                cuts = [*range(0, n, capacity), n]
                if n - cuts[-2] > half and n - cuts[-2] < capacity:
                    cuts.insert(-1, cuts[-2] + half)
                for start, end in pairwise(cuts):
                    part = raw[4 * start : 4 * end]
                    at.append(k)
                    for column, value in zip(columns, (start, len(part) // 4, zlib.crc32(part), n, row), strict=False):
                        column.append(value)
                    row += 1
                    if with_ids:
                        columns[5].append(part)
                        held += len(part)
                if held >= HELD:
                    yield batch_of(batch.column(0), at, columns)
                    at, columns, held = [], [[] for _ in range(6)], 0
            yield batch_of(batch.column(0), at, columns)
        release()

    def batch_of(ids, at, columns):
        found = [ids.take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:5])]
        return pa.RecordBatch.from_arrays(found + [pa.array(columns[5], pa.binary())] * with_ids, names=names)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def knapsack(values: np.ndarray, capacity: int, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The pattern of most value: unbounded knapsack by dynamic programming
    over capacities (weights ascending)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    positive = np.nonzero(values > 1e-12)[0]
    w, v = weights[positive], values[positive]
    for c in range(1, capacity + 1):
        k = np.searchsorted(w, c, "right")
        best[c] = best[c - 1]
        if k:
            gain = best[c - w[:k]] + v[:k]
            j = int(np.argmax(gain))
            if gain[j] > best[c] + 1e-12:
                best[c], last[c] = gain[j], j
    pattern, c = np.zeros(len(weights), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[positive[last[c]]] += 1
            c -= int(w[last[c]])
    return float(pattern @ values), pattern


def solve_lp(weights: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 1e-3, most_rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Column generation: minimise the number of sequences so that patterns
    cover the demand. Returns (pattern, use) with use > 0.

    The basis starts with one pattern a class. Each round prices one pattern;
    Farley's bound, sequences / best value, ends it within tolerance of the
    optimum."""
    n = len(weights)
    fit = capacity // weights
    basis = np.diag(fit.astype(float))
    inverse = np.diag(1 / fit)
    x = demand / fit
    for k in range(most_rounds):
        duals = inverse.sum(0)
        value, pattern = knapsack(duals, capacity, weights)
        if value <= 1 + tolerance:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        x = x - theta * step
        x[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out] = pattern
        if k % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
        x = np.maximum(x, 0)
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(n) if x[j] > 1e-9]


def best_fit(weights: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for what rounding leaves: the largest piece first, then always
    the largest that still fits; a pattern is used as often as pieces allow."""
    left, out = left.copy(), []
    while left.any():
        pattern, room = np.zeros(len(weights), np.int64), capacity
        while True:
            k = np.nonzero((weights <= room) & (left > pattern))[0]
            if not len(k):
                break
            take = min(room // weights[k[-1]], left[k[-1]] - pattern[k[-1]])
            pattern[k[-1]] += take
            room -= take * weights[k[-1]]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left = left - times * pattern
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, step: int = 8, tolerance: float = 1e-3) -> list[tuple[dict[int, int], int]]:
    """Length histogram -> [({class: pieces}, sequences)]. A class c holds the
    lengths over (c - 1) * step up to c * step, so patterns fit whatever
    lengths their pieces have; step 1 plans exact lengths."""
    if not histogram:
        return []
    demand_of: dict[int, int] = {}
    for length, n in histogram.items():
        demand_of[-(-length // step)] = demand_of.get(-(-length // step), 0) + n
    room = capacity // step
    full = demand_of.pop(room, 0)
    out = [({room: 1}, full)] if full else []
    if demand_of:
        weights = np.array(sorted(demand_of))
        demand = np.array([demand_of[w] for w in weights])
        rounded = [(p, int(use + 1e-7)) for p, use in solve_lp(weights, demand.astype(float), room, tolerance)]
        left = demand.copy()
        kept = []
        for p, use in sorted(rounded, key=lambda r: -r[1]):
            use = min([use, *(left[p > 0] // p[p > 0])])
            if use:
                kept.append((p, use))
                left = left - use * p
        for p, use in [*kept, *best_fit(weights, left, room)]:
            out.append(({int(weights[k]): int(p[k]) for k in np.nonzero(p)[0]}, int(use)))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, sequences, slot): the
    pieces of a class with these ranks go to consecutive sequences at `slot`."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, use in patterns:
        slot = 0
        for c, n in sorted(pattern.items(), reverse=True):
            for _ in range(n):
                first = ranks.get(c, 0)
                out.append((c, first, first + use, sequence, use, slot))
                ranks[c] = first + use
                slot += 1
        sequence += use
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, step: int = 8, order_by=("doc_id", "start")) -> DataFrame:
    """A table of pieces -> the same with sequence_id and offset in place of
    __row. `found` is read twice and should be a table."""
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(histogram.values())
    table_of = slots(plan(histogram, capacity, step))
    rows = len(table_of)
    assert rows <= 4 * (capacity // step) ** 2 + 4, "the pattern table is bounded by the number of classes"
    by_class: dict[int, list] = {}
    for c, *rest in table_of:
        by_class.setdefault(c, []).append(rest)
    arrays = {c: np.array(sorted(v)) for c, v in by_class.items()}
    shared = found.sparkSession.sparkContext.broadcast(arrays)

    n = salts(total)
    cls = F.ceil(F.col("length") / step).cast("int")
    dealt = found.withColumns({"__class": cls, "__salt": row_salt(n, *[F.col(x) for x in order_by], F.col("__row"))})
    before = W.partitionBy("__class").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    firsts = dealt.groupBy("__class", "__salt").agg(F.count("*").alias("n")).withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = W.partitionBy("__class", "__salt").orderBy(*order_by, "__row")
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1).join(firsts, ["__class", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__first")).drop("__salt", "__first")

    def assign(batches):
        for batch in batches:
            c, rank = (np.asarray(batch.column(batch.schema.names.index(x))) for x in ("__class", "__rank"))
            sequence, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                at, of = np.nonzero(c == k)[0], shared.value[int(k)]
                r = of[np.searchsorted(of[:, 0], rank[at], "right") - 1]
                sequence[at], slot[at] = r[:, 2] + rank[at] - r[:, 0], r[:, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], names=[*batch.schema.names, "sequence_id", "__slot"])

    schema = T.StructType([*ranked.schema, T.StructField("sequence_id", T.LongType()), T.StructField("__slot", T.LongType())])
    placed = ranked.mapInArrow(assign, schema)
    ahead = W.partitionBy("sequence_id").orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)  # a sequence has capacity pieces at most
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("__class", "__rank", "__slot", "__row")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, step: int = 8, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(stored(pieces(docs, tokenizer_path, doc_id, text, capacity, with_ids), "pieces"), capacity, step, (doc_id, "start", "ids_crc32"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
