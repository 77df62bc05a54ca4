"""Language identification by a convolutional network over bytes.

A byte embedding feeds filters of several widths; their responses are max
pooled over a window, a softmax over the learned languages follows. The network
is trained in numpy on the driver, on a sample of labelled rows of at most
`train_rows` rows a language and `train_windows` windows a row (documented
bounds); nothing else is bounded: every byte of every text is scored, in windows
of fixed length taken in batches, and a text's languages are the mean of its
windows' log probabilities, weighted by their bytes.

To apply the network, an embedding and a filter are multiplied once for each
value that a pair of bytes can have, so a response is a sum of table rows.

Defined results: `und` with score 0 for a null text and for a text without a
letter; repeated rows are scored one by one; rows whose lang is null teach
nothing; with no labelled row at all every text is `und`; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import crc_mod, release, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
UND = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes in rows of `size`, the last one padded with zeros."""
    n = max(1, -(-len(text) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, size)


class Network:
    """Byte embedding, filters of several widths with max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over windows x with labels y."""
        n, size = x.shape
        e = self.embed[x]
        pooled, at = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            view = np.lib.stride_tricks.as_strided(e, (n, size - w + 1, w * EMBED), (e.strides[0], e.strides[1], e.strides[2]))
            r = view @ f + b
            at.append(r.argmax(1))
            pooled.append(r.max(1))
        pooled = np.concatenate(pooled, 1)
        p = self._softmax(pooled)
        p[np.arange(n), y] -= 1
        p /= n
        d_out, d_out_bias = np.maximum(pooled, 0).T @ p, p.sum(0)
        d_pooled = (p @ self.out.T) * (pooled > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        rows = np.arange(n)[:, None, None]
        for k, w in enumerate(WIDTHS):
            d = d_pooled[:, k * FILTERS : (k + 1) * FILTERS]
            seen = x[rows, at[k][:, :, None] + np.arange(w)]  # only the windows that won take part
            patch = self.embed[seen].reshape(n, FILTERS, w * EMBED)
            d_filters.append(np.einsum("nfe,nf->ef", patch, d, optimize=True))
            d_bias.append(d.sum(0))
            back = d[:, :, None] * self.filters[k].T[None]
            np.add.at(d_embed, seen.reshape(-1), back.reshape(-1, EMBED))
        return [d_embed, *d_filters, *d_bias, d_out, d_out_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 0) -> Network:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        params = self.weights()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(order), batch):
                t += 1
                at = order[k : k + batch]
                for p, a, b, g in zip(params, m, v, self.gradients(x[at], y[at]), strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A trained network with filters as tables over bytes and pairs of bytes."""

    def __init__(self, net: Network):
        self.labels, self.out, self.out_bias = net.labels, net.out, net.out_bias
        self.bias = np.concatenate(net.bias)
        one = [[net.embed @ f[j * EMBED : (j + 1) * EMBED] for j in range(w)] for w, f in zip(WIDTHS, net.filters, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).astype(np.float32)
        #: By width: (offset, table) over pairs, and over single bytes for what is left.
        self.pairs = [[(j, pair(parts[j], parts[j + 1])) for j in range(0, w - 1, 2)] for w, parts in zip(WIDTHS, one, strict=True)]
        self.single = [(w - 1, parts[-1].astype(np.float32)) if w % 2 else None for w, parts in zip(WIDTHS, one, strict=True)]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, labels) of windows (n, size)."""
        n, size = x.shape
        code = np.empty((n, size), np.uint16)
        code[:, :-1] = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        code[:, -1] = x[:, -1].astype(np.uint16) << 8
        pooled = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for k, w in enumerate(WIDTHS):
            length = size - w + 1
            r = None
            for offset, t in self.pairs[k]:
                part = np.take(t, code[:, offset : offset + length], axis=0)
                r = part if r is None else np.add(r, part, out=r)
            if self.single[k]:
                offset, t = self.single[k]
                r += np.take(t, x[:, offset : offset + length], axis=0)
            pooled[:, k * FILTERS : (k + 1) * FILTERS] = r.max(1)
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def score(self, texts: list[bytes | None], block: int = 512) -> np.ndarray:
        """(texts, labels) probabilities; whole texts, `block` windows at once."""
        parts = [windows_of(t or b"") for t in texts]
        sizes = np.array([len(p) for p in parts])
        x = np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.uint8)
        logs = [self.log_probabilities(x[k : k + block]) for k in range(0, len(x), block)]
        if not logs:
            return np.zeros((0, len(self.labels)))
        # A last window with few bytes counts by its bytes.
        weight = np.maximum((x != 0).sum(1), 1)[:, None]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(np.concatenate(logs) * weight, starts) / np.add.reduceat(weight, starts)
        p = np.exp(mean - mean.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = 400, train_windows: int = 6, seed: int = 0) -> Scorer | None:
    """A scorer from rows with text and lang, or None without any such row.

    The sample holds, for each language, the train_rows texts of least hash;
    of a text train_windows windows spread over it are used. Two passes over the
    rows, however many languages there are.
    """
    rows = labelled.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("binary").alias("text"))
    rows = rows.withColumn("__h", F.xxhash64("text"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("__h").alias("d")).collect()  # one row a language
    langs = [r.lang for r in sorted(counted, key=lambda r: (-r.n, r.lang))]
    if not langs:
        return None
    # Hashes under a language's limit hold about four times the rows wanted, copies counted once.
    limits = [(r.lang, (1 << 63) - 1 if r.d <= 4 * train_rows else int(4 * train_rows / r.d * 2.0**64) - (1 << 63)) for r in counted]
    limits = F.broadcast(labelled.sparkSession.createDataFrame(limits, "lang string, limit bigint"))  # as many rows as the network has outputs
    # Only what the sample can use of a text leaves its row.
    step = F.greatest(F.lit(1), F.floor((F.octet_length("text") - WINDOW) / max(1, train_windows - 1))).cast("int")
    cut = F.when(F.octet_length("text") <= WINDOW * train_windows, F.array("text")).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(train_windows - 1)), lambda k: F.substring(F.col("text"), k * step + 1, F.lit(WINDOW)))
    )
    near = rows.join(limits, "lang").where(F.col("__h") <= F.col("limit")).select("lang", "__h", cut.alias("parts"))
    near = near.groupBy("lang", "__h").agg(F.min("parts").alias("parts"))
    first = near.withColumn("__n", F.row_number().over(W.partitionBy("lang").orderBy("__h"))).where(F.col("__n") <= train_rows)
    place = {x: k for k, x in enumerate(langs)}
    found = sorted(first.select("__h", "lang", "parts").collect(), key=lambda r: (place[r.lang], r["__h"]))
    x, y = [], []
    rng = np.random.default_rng(seed)
    for r in found:
        w = np.concatenate([windows_of(bytes(p)) for p in r.parts])
        x.append(w)
        y += [place[r.lang]] * len(w)
        # Short texts must be told apart too: a part of one window, as long as a few words.
        whole = bytes(r.parts[0])
        if len(whole) > 40:
            size = int(rng.integers(12, min(len(whole), 80)))
            at = int(rng.integers(0, len(whole) - size + 1))
            x.append(windows_of(whole[at : at + size]))
            y.append(place[r.lang])
    return Network(langs, seed).fit(np.concatenate(x), np.array(y), seed=seed).tables()


def identify(docs: DataFrame, scorer: Scorer | None, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score (the probability of lang_pred).
    Texts alone go to the Python workers, once; all else stays in the JVM."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scorer and vars(scorer))  # four tables of 65536 rows: 13 MB at any size

    @F.arrow_udf("lang_pred string, score double")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = None
        if shared.value:
            net = Scorer.__new__(Scorer)
            vars(net).update(shared.value)
        for batch in batches:
            labels, scores = [UND] * len(batch), np.zeros(len(batch))
            group, size = [], 0

            def settle():
                for j, row in zip((k for k, _ in group), net.score([x for _, x in group]), strict=True):
                    labels[j], scores[j] = net.labels[int(row.argmax())], float(row.max())
                group.clear()

            # Few texts at once: memory follows the longest text, not the batch.
            for k, value in enumerate(batch if net is not None else ()):
                raw = value.as_py()
                if raw and (ASCII_LETTER(raw) or any(map(str.isalpha, raw.decode(errors="replace")))):
                    group.append((k, raw))
                    size += len(raw)
                    if size > 1 << 20:
                        settle()
                        size = 0
            if group:
                settle()
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        release()

    scored = docs.select(*[F.col(f"`{c}`") for c in keep], found(F.col(f"`{text}`").cast("binary")).alias("__found"))
    return scored.select(*[F.col(f"`{c}`") for c in keep], "__found.lang_pred", "__found.score")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def learned(spark: SparkSession, sf_dir: str) -> Scorer | None:
    return train(table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id"))))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(docs, learned(spark, sf_dir), keep=("doc_id", "held_out"))
