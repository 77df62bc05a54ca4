"""Toxicity by a convolutional text classifier.

A word is hashed three times, whole and by its first 6 and 8 letters, into
three embedding tables: inflected forms share what their stem has taught, and a
word that collides in one table is told apart by the others. Filters of several
widths run over the whole text, are max pooled, and a sigmoid follows. Scoring
covers whole texts, in blocks of words with a running maximum.

Every labelled row takes part, by its whole text. Of four rows, as a hash of the
id deals them, three teach the network and one sets thresholds, however many
there are. Training starts on the driver, in numpy, from up to `train_rows`
teaching rows of each label (of up to `train_bytes` bytes; where it starts, not
what it learns from), since averages of networks that start apart mean nothing.
Then all teaching rows are dealt to learners of about `LEARNER` rows. Each
goes on from that network over its own rows, and the changes are averaged: those
of an embedding by how often a learner changed it, the others by rows. Changes
are summed as whole numbers, so their order does not matter.

A score's threshold is calibrated by language: the rows that set thresholds are
counted by language, label and score (1/`BINS` of a logit), each language gets
the threshold of best F1 over its counts, and scores are stretched so that it
lies at 0.7. The language is guessed from the text's own words, by naive Bayes
over hashed words counted in all teaching rows, for every language that they
name; no column but the text enters a score.

Defined results: null and empty texts are scored as no words at all; repeated
rows are scored one by one; of rows that share an id the least text teaches;
labels and languages that are null teach nothing; where one of
the two labels is missing the score is a constant below the threshold (or above
it, if all labels are 1); an empty table gives an empty result.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, discard, stored, table

BUCKETS = 1 << 17
#: Letters of a word that each table sees, and the width of its vectors.
VIEWS = (1 << 30, 6, 8)
EMBED = 5
WIDE = EMBED * len(VIEWS)
WIDTHS = (1, 2, 3)
FILTERS = 8
THRESHOLD = 0.7
#: Rows of which a learner makes its own changes, and of how many rows one sets thresholds.
LEARNER, ASIDE = 2048, 4
#: Scores to a logit, where thresholds are looked for; steps to 1 in a sum of changes.
BINS, STEPS = 64, 1 << 30
#: Buckets of words by which languages are told apart.
MARKS = 1 << 13
STRIP = ".,;:!?\"'()[]{}|*$%&<>#-_"


class Words:
    """Texts to bucket numbers, remembering those of known words."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, bytes] = {}
        self.most = most

    def _numbers(self, word: str) -> bytes:
        raw = word.strip(STRIP)
        return np.array([crc32(raw[:n].encode(), k * 0x5BD1E995 % (1 << 32)) % BUCKETS for k, n in enumerate(VIEWS)], np.int32).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        """(n, tables) buckets."""
        words = (text or "").lower().split()
        known = self.known
        seen = set(words)
        new = [x for x in seen if x not in known]
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
                new = list(seen)
            known.update((x, self._numbers(x)) for x in new)
        return np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32).reshape(-1, len(VIEWS))


class Languages:
    """Naive Bayes over hashed words: the group by which a text's threshold is chosen."""

    def __init__(self, texts: list[np.ndarray], langs: list[str | None]):
        self.learn(self.counted(texts, langs))

    @staticmethod
    def counted(texts: list[np.ndarray], langs: list[str | None]) -> dict[str, np.ndarray]:
        """By language: in how many texts each mark occurs."""
        counts: dict[str, np.ndarray] = {}
        for words, lang in zip(texts, langs, strict=True):
            if lang is not None:
                counts.setdefault(lang, np.zeros(MARKS, np.int64))[np.unique(words[:, 0] % MARKS)] += 1
        return counts

    def learn(self, found: dict[str, np.ndarray]) -> None:
        self.labels = sorted(found)
        counts = np.array([found[x] for x in self.labels]) + 0.5
        self.weights = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32).T if self.labels else None

    def __call__(self, words: np.ndarray) -> str:
        """The language most of the text's words speak for; "" for no word."""
        if self.weights is None or not len(words):
            return ""
        marks = np.bincount(words[:, 0] % MARKS, minlength=MARKS) if len(words) > MARKS else words[:, 0] % MARKS
        score = marks @ self.weights if len(words) > MARKS else self.weights[marks].sum(0)
        return self.labels[int(score.argmax())]


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (len(VIEWS), BUCKETS, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * WIDE), (w * WIDE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.out_bias = np.full(1, -1, np.float32)

    def _padded(self, words: np.ndarray) -> np.ndarray:
        """Embedded words between zero vectors, so every width fits anywhere."""
        pad = max(WIDTHS) - 1
        e = np.zeros((len(words) + 2 * pad, WIDE), np.float32)
        if len(words):
            for s in range(len(VIEWS)):
                e[pad : pad + len(words), s * EMBED : (s + 1) * EMBED] = self.embed[s][words[:, s]]
        return e

    def _responses(self, e: np.ndarray, k: int) -> np.ndarray:
        w = WIDTHS[k]
        view = np.lib.stride_tricks.as_strided(e, (len(e) - w + 1, w * WIDE), e.strides)
        return view @ self.filters[k]

    def pooled(self, words: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """Maxima of all filters over the whole text."""
        best = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32)
        for at in range(0, max(1, len(words)), block):
            e = self._padded(words[max(0, at - max(WIDTHS) + 1) : at + block])
            for k in range(len(WIDTHS)):
                best[k] = np.maximum(best[k], self._responses(e, k).max(0))
        return (best + np.stack(self.bias)).ravel()

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def fresh_squares() -> np.ndarray:
        return np.full((len(VIEWS), BUCKETS), 1e-4, np.float32)

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out, self.out_bias]

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 4e-3, seed: int = 0, squares: np.ndarray | None = None, steps: np.ndarray | None = None) -> Network:
        """Adam; embeddings learn where a filter's maximum looked, by Adagrad.
        squares (of earlier training) go on; steps counts the changes of each embedding."""
        rng = np.random.default_rng(seed)
        dense = self.dense()
        m, v, t = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], 0
        squares = self.fresh_squares() if squares is None else squares
        pad = max(WIDTHS) - 1
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), batch):
                at = order[start : start + batch]
                grads = [np.zeros_like(p) for p in dense]
                touched: list[tuple[np.ndarray, np.ndarray]] = []
                for k in at:
                    words = texts[k]
                    e = self._padded(words)
                    found = []
                    for j in range(len(WIDTHS)):
                        r = self._responses(e, j)
                        i = r.argmax(0)
                        found.append((i, r[i, np.arange(FILTERS)] + self.bias[j]))
                    pooled = np.concatenate([x[1] for x in found])
                    active = np.maximum(pooled, 0)
                    d = float(self.probability(pooled[None])[0] - y[k]) / len(at)
                    grads[-2] += d * active
                    grads[-1] += d
                    d_pooled = d * self.out * (pooled > 0)
                    for j, w in enumerate(WIDTHS):
                        g = d_pooled[j * FILTERS : (j + 1) * FILTERS]
                        rows = found[j][0][:, None] + np.arange(w)
                        grads[j] += e[rows].reshape(FILTERS, -1).T * g
                        grads[len(WIDTHS) + j] += g
                        back = (self.filters[j].T * g[:, None]).reshape(-1, WIDE)
                        word = rows.ravel() - pad
                        ok = (word >= 0) & (word < len(words))
                        if ok.any():
                            touched.append((words[word[ok]], back[ok]))
                t += 1
                for p, a, b, g in zip(dense, m, v, grads, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
                if touched:
                    words, back = np.concatenate([x[0] for x in touched]), np.concatenate([x[1] for x in touched])
                    for s in range(len(VIEWS)):
                        rows, of = np.unique(words[:, s], return_inverse=True)
                        g = np.zeros((len(rows), EMBED), np.float32)
                        np.add.at(g, of, back[:, s * EMBED : (s + 1) * EMBED])
                        squares[s, rows] += (g * g).mean(1)
                        self.embed[s, rows] -= 0.1 * g / np.sqrt(squares[s, rows])[:, None]
                        if steps is not None:
                            steps[s, rows] += 1
        return self


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of best F1, midway between two neighbouring scores."""
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    hit, all_, real = np.cumsum(y * weight), np.cumsum(weight), float((y * weight).sum())
    f1 = np.where(np.append(p[1:] < p[:-1], True), 2 * hit / np.maximum(all_ + real, 1e-9), -1)
    k = int(np.argmax(f1))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def stretch(p: np.ndarray, t: float) -> np.ndarray:
    """0..1 to 0..1, in order, with t at THRESHOLD."""
    t = min(max(t, 1e-6), 1 - 1e-6)
    return np.where(p < t, THRESHOLD * p / t, THRESHOLD + (1 - THRESHOLD) * (p - t) / (1 - t))


def labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, lang: str) -> DataFrame:
    """id, y, text, lang and aside (whether it sets thresholds) of every labelled row with a text."""
    spoken = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    given = labels.where(F.col(f"`{label}`").isin(0, 1)).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).distinct()
    worded = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("id"), F.struct(F.col(f"`{text}`").alias("text"), spoken.alias("lang")).alias("row"))
    # Of rows that share an id the least text teaches.
    rows = worded.groupBy("id").agg(F.min("row").alias("row")).join(given, "id")
    return rows.select("id", "y", "row.*", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(ASIDE)) == 0).alias("aside"))


CHANGES = T.StructType([T.StructField("lang", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(f"d{k}", T.LongType()) for k in range(EMBED)]])


def _slots(values: np.ndarray) -> np.ndarray:
    """A vector as rows of EMBED."""
    return np.pad(values, (0, -len(values) % EMBED)).reshape(-1, EMBED)


def refine(rows: DataFrame, n: int, net: Network, squares: np.ndarray, rate: float = 1e-3) -> dict[str, np.ndarray]:
    """The network goes on from where it is over all n rows (id, y, text, lang);
    returns their counts for Languages. The driver gets one row for each
    embedding that changed and for each language's marks, of any number of rows."""
    learners = max(1, round(n / LEARNER))
    shared = rows.sparkSession.sparkContext.broadcast((vars(net), squares))  # tables of BUCKETS rows a view: 9 MB at any size

    def learned(number: int, texts: list[np.ndarray], y: list[int], counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        start, before = shared.value
        own, steps = Network.__new__(Network), np.zeros((len(VIEWS), BUCKETS), np.int64)
        vars(own).update({k: x.copy() if isinstance(x, np.ndarray) else [a.copy() for a in x] for k, x in start.items()})
        old = np.concatenate([x.ravel() for x in own.dense()]).astype(np.float64)
        own.fit(texts, np.array(y), epochs=1, rate=rate, seed=number, squares=before.copy(), steps=steps)
        at = np.nonzero(steps.ravel())[0]
        times = steps.ravel()[at]
        moved = (own.embed.reshape(-1, EMBED)[at].astype(np.float64) - start["embed"].reshape(-1, EMBED)[at]) * times[:, None]
        dense = _slots((np.concatenate([x.ravel() for x in own.dense()]) - old) * len(y))
        parts = [(None, at, times, np.rint(moved * STEPS)), (None, len(VIEWS) * BUCKETS + np.arange(len(dense)), np.full(len(dense), len(y)), np.rint(dense * STEPS))]
        for lang, x in sorted(counts.items()):
            marks = _slots(x)
            has = np.nonzero(marks.any(1))[0]
            parts.append((lang, has, np.zeros(len(has)), marks[has]))
        d = np.concatenate([x[3] for x in parts]).astype(np.int64)
        langs = pa.array([x[0] for x in parts for _ in range(len(x[1]))], pa.string())
        return pa.RecordBatch.from_arrays([langs, pa.array(np.concatenate([x[1] for x in parts]).astype(np.int32)), pa.array(np.concatenate([x[2] for x in parts]).astype(np.int64)), *[pa.array(d[:, k]) for k in range(EMBED)]], names=CHANGES.names)

    def run(batches):
        words, number, texts, y, counts = Words(), None, [], [], {}
        for batch in batches:
            for at, label, text, lang in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if at != number:
                    if texts:
                        yield learned(number, texts, y, counts)
                    number, texts, y, counts = at, [], [], {}
                found = words(text)
                texts.append(found)
                y.append(label)
                if lang is not None:
                    counts.setdefault(lang, np.zeros(MARKS, np.int64))[np.unique(found[:, 0] % MARKS)] += 1
        if texts:
            yield learned(number, texts, y, counts)

    dealt = rows.withColumn("learner", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(learners)).cast("int")).repartition(learners, "learner")
    # The order of rows, and with it what a learner learns, follows from the rows alone.
    ordered = dealt.sortWithinPartitions("learner", F.xxhash64("id", F.lit(3)), "id", "y").select("learner", "y", "text", "lang")
    summed = ordered.mapInArrow(run, CHANGES).groupBy("lang", "slot").agg(*[F.sum(c).alias(c) for c in CHANGES.names[2:]])
    got = summed.toArrow()
    slot, times = (got.column(c).to_numpy().astype(np.int64) for c in ("slot", "n"))
    d = np.stack([got.column(f"d{k}").to_numpy() for k in range(EMBED)], 1)
    lang = np.array(got.column("lang").to_pylist(), object)
    of_net = lang == None  # noqa: E711
    mean = d[of_net] / STEPS / np.maximum(times[of_net], 1)[:, None]
    embedded = slot[of_net] < len(VIEWS) * BUCKETS
    net.embed.reshape(-1, EMBED)[slot[of_net][embedded]] += mean[embedded].astype(np.float32)
    dense = np.zeros_like(_slots(np.concatenate([x.ravel() for x in net.dense()])))
    dense[slot[of_net][~embedded] - len(VIEWS) * BUCKETS] = mean[~embedded]
    dense, at = dense.ravel(), 0
    for x in net.dense():
        x += dense[at : at + x.size].reshape(x.shape)
        at += x.size
    counts: dict[str, np.ndarray] = {}
    for name in sorted(set(lang[~of_net])):
        own = lang == name
        marks = _slots(np.zeros(MARKS, np.int64))
        marks[slot[own]] = d[own]
        counts[name] = marks.ravel()[:MARKS]
    shared.destroy()
    return counts


def calibrate(rows: DataFrame, net: Network, guess: Languages) -> dict[str, float]:
    """Thresholds by language ("": of all) from all rows (y, text). The driver
    gets at most 60 * BINS counts of each label and language."""
    shared = rows.sparkSession.sparkContext.broadcast((vars(net), vars(guess)))

    def run(batches):
        words, own, tongue = Words(), Network.__new__(Network), Languages.__new__(Languages)
        vars(own).update(shared.value[0])
        vars(tongue).update(shared.value[1])
        for batch in batches:
            found = [words(x) for x in batch.column(1).to_pylist()]
            if found:
                p = own.probability(np.stack([own.pooled(x) for x in found]).astype(np.float64))
                bins = np.floor(np.log(p / (1 - p)) * BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([tongue(x) for x in found], pa.string()), pa.array(bins), batch.column(0)], names=["lang", "bin", "y"])

    counted = rows.select("y", "text").mapInArrow(run, "lang string, bin int, y int").groupBy("lang", "bin", "y").agg(F.count("*").alias("n")).orderBy("lang", "bin", "y").collect()
    shared.destroy()
    langs, y, n = np.array([r.lang for r in counted], object), np.array([r.y for r in counted]), np.array([r.n for r in counted], np.float64)
    p = 1 / (1 + np.exp(-(np.array([r.bin for r in counted]) + 0.5) / BINS))
    thresholds = {"": best_threshold(p, y, n) if len(y) and y.any() else 0.5}
    for name in sorted(set(langs)):
        own = langs == name
        if name and (y * n)[own].sum() >= 10:  # fewer say too little; the overall threshold stands
            thresholds[name] = best_threshold(p[own], y[own], n[own])
    return thresholds


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lang: str = "lang", train_rows: int = 1500, train_bytes: int = 1 << 16, seed: int = 0) -> dict:
    """A model (arrays and thresholds) from all texts and 0/1 labels by doc_id, and
    from their languages if docs has the column; it is not looked at in scoring.

    train_rows and train_bytes bound what the driver starts from, not what is learned."""
    rows = stored(labelled(docs, labels, text, doc_id, label, lang), "labelled")
    counts = {(r.y, r.aside): r.n for r in rows.groupBy("y", "aside").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in counts}) < 2:
        discard(rows)
        return {"constant": 1.0 if counts and next(iter(counts))[0] else 0.0}
    # Too few to set any aside: the same rows do both.
    split = all((y, False) in counts for y in (0, 1))
    teach = rows.where("NOT aside") if split else rows
    n = sum(x for (_, aside), x in counts.items() if not (split and aside))
    # Ids alone are drawn; only the texts of these are then looked up.
    short = teach.where(F.octet_length("text") <= train_bytes).select("id", "y")
    first = [short.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(train_rows) for y in (0, 1)]
    picked = stored(first[0].unionByName(first[1]), "drawn")
    start = teach.join(F.broadcast(picked), ["id", "y"]).orderBy("id", "y").select("y", "text").collect()
    words = Words()
    squares = Network.fresh_squares()
    net = Network(seed).fit([words(r.text) for r in start], np.array([r.y for r in start]), seed=seed, squares=squares)
    guess = Languages([], [])
    guess.learn(refine(teach, n, net, squares))
    thresholds = calibrate(rows.where("aside") if split else rows, net, guess)
    for made in (picked, rows):
        discard(made)
    return {"net": vars(net), "thresholds": thresholds, "languages": vars(guess)}


def classify(docs: DataFrame, model: dict, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of BUCKETS rows a view: 8 MB at any size, and 32 KB a language
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        m = shared.value
        words, net = Words(), Network.__new__(Network)
        vars(net).update(m.get("net", {}))
        guess = Languages.__new__(Languages)
        vars(guess).update(m.get("languages", {}))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            score = np.full(len(texts), m.get("constant", 0.0))
            if "net" in m:
                pooled, at = [], []
                for x in texts:
                    found = words(x)
                    pooled.append(net.pooled(found))
                    at.append(m["thresholds"].get(guess(found), m["thresholds"][""]))
                if texts:
                    p = net.probability(np.stack(pooled).astype(np.float64))
                    score = np.array([stretch(a, t) for a, t in zip(p, at, strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 3) == 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return classify(docs, train(docs.where(~F.col("held_out")), labels), keep=("doc_id", "held_out"))
