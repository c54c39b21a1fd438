"""Operator 4, language identification by sparse multinomial logistic regression.

A text's features are its character 1- to 3-grams, hashed into ``DIM`` buckets: share of the
text's grams (term frequency) times inverse document frequency. Document frequencies count every
learning document; each partition adds up its own, and the sums have at most ``DIM`` rows.

The weights are fitted by follow-the-regularised-leader with per-coordinate steps and an elastic
net (``L1`` keeps them sparse). The learning rows are a bounded sample, at most ``FIT_ROWS`` for
each language chosen by a hash of id and text; ``WORKERS`` tasks each train on their part and
their weights are averaged, so no task or driver sees the whole sample. A temperature, fitted on
another ``CALIBRATE_ROWS`` of each language, turns the scores into probabilities.

Only texts and non-null languages of learning rows are learned from; a prediction sees the text
alone. Labels (languages) are few and gathered on the driver. Defined cases: null texts and texts
without a letter give ``und`` with score 0, as does every text if there is nothing to learn from;
ties go to the first label in order; a text of any length counts whole; rows that repeat an id
are predicted each for itself; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.common import cut, whole
from veritab.llm.shingles import U, mix

DIM = 1 << 15
ORDERS = (1, 2, 3)
BLOCK = 1 << 18
FIT_ROWS = 2000
CALIBRATE_ROWS = 400
WORKERS = 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
SCALE = 20.0
UNKNOWN = "und"


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, in blocks; one blank stands before and after the text."""
    text = f" {text.lower()} "
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at:at + BLOCK + max(ORDERS) - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        for n in ORDERS:
            code = np.full(max(0, min(BLOCK, len(c) - n + 1)), n, np.uint64)
            for k in range(n):
                code = code * U(0x10FFFF + 2) + c[k:k + len(code)]
            yield (mix(code) >> U(64 - 15)).astype(np.int64)


def counts(text: str) -> np.ndarray:
    out = np.zeros(DIM, np.int64)
    for g in grams(text):
        out += np.bincount(g, minlength=DIM)
    return out


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.table = np.ascontiguousarray((self.weights * self.idf[:, None]).T)

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for g in grams(text):
            total += [row[g].sum() for row in self.table]
            n += len(g)
        return (SCALE * total / max(1, n) + self.bias) / self.temperature


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(whole(id_.cast("string"))), F.lit(3)) == 1


def _frequencies(learn: DataFrame) -> np.ndarray:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM, np.int64)
        for b in batches:
            for t in b["text"].to_pylist():
                df += counts(t) > 0
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(df[hit], pa.int64())], ["bucket", "n"])

    out = np.zeros(DIM)
    for r in learn.select("text").mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _sample(learn: DataFrame) -> DataFrame:
    """``(nth, text, lang, use)``: at most ``FIT_ROWS`` rows of each language to fit and ``CALIBRATE_ROWS`` to calibrate.

    A language's rows are ordered by a hash of id and text; the first ones are taken, of few rows the same
    shares. The hash that bounds them is found on hashes alone, so only the chosen texts are moved; rows that share
    it are counted off, so no set of ids or copies makes the sample longer.
    """
    most = FIT_ROWS + CALIBRATE_ROWS
    hashed = learn.withColumn("hash", F.xxhash64("id", "text"))
    by_hash = Window.partitionBy("lang").orderBy("hash")
    ranked = hashed.select("lang", "hash").withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= most)
    bounds = ranked.groupBy("lang").agg(F.max("hash").alias("last"))  # one row a language
    few = hashed.join(F.broadcast(bounds), "lang").filter("hash <= last")
    few = few.withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= most)
    n = F.count("*").over(Window.partitionBy("lang"))
    return few.withColumn("use", F.when(F.col("nth") * most <= n * FIT_ROWS, "fit").otherwise("calibrate")).select("nth", "text", "lang", "use")


def _train(labels: list[str], idf: np.ndarray):
    place = {k: i for i, k in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for t, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                n = counts(t)
                at = np.flatnonzero(n)
                rows.append((at, SCALE * n[at] / n.sum() * idf[at], place[lang]))
        if not rows:
            return
        dims = DIM + 1  # the last one is the bias
        z, g2 = np.zeros((dims, len(labels))), np.zeros((dims, len(labels)))

        def weights(at) -> np.ndarray:
            w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)
            return np.where(np.abs(z[at]) <= L1, 0.0, w)

        order = np.random.default_rng(4)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                at, x, y = rows[i]
                at, x = np.append(at, DIM), np.append(x, 1.0)
                w = weights(at)
                error = softmax(x @ w)
                error[y] -= 1.0
                g = x[:, None] * error
                step = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
                z[at] += g - step * w
                g2[at] += g * g
        w = weights(slice(None))
        at, label = np.nonzero(w)
        at, label = np.append(at, -1), np.append(label, 0)  # row -1 counts the workers
        value = np.append(w[at[:-1], label[:-1]], 1.0)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(label, pa.int64()), pa.array(value, pa.float64())], ["bucket", "label", "w"])

    return run


def _temperature(model: Model, sample: DataFrame) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    place = {k: i for i, k in enumerate(model.labels)}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.scores(t).tolist() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.list_(pa.float64())), pa.array([place[x] for x in b["lang"].to_pylist()], pa.int64())], ["s", "y"])

    rows = sample.select("text", "lang").mapInArrow(scored, "s array<double>, y long").collect()  # CALIBRATE_ROWS a language
    if not rows:
        return 1.0
    s, y = np.array([r["s"] for r in rows]), np.array([r["y"] for r in rows])
    loss = lambda t: -np.log(softmax(s / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, ratio = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from the rows of ``docs`` that are not held out; null without any."""
    has_letter = F.col(text_col).rlike(r"\p{L}")
    learn = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & has_letter)
    learn = learn.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    per_label = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    labels = sorted(per_label)
    if not labels:
        return None
    idf = np.log((1 + sum(per_label.values())) / (1 + _frequencies(learn))) + 1
    sample = cut(_sample(learn))
    # dealt by place, so copies of a text do not meet in one task
    dealt = sample.filter("use = 'fit'").repartitionById(WORKERS, F.pmod("nth", F.lit(WORKERS)).cast("int")).sortWithinPartitions("lang", "nth")
    parts = dealt.select("text", "lang").mapInArrow(_train(labels, idf), "bucket long, label long, w double")
    weights, bias, workers = np.zeros((DIM, len(labels))), np.zeros(len(labels)), 1.0
    for r in cut(parts.groupBy("bucket", "label").agg(F.sum("w").alias("w"))).collect():  # at most DIM times labels
        if r["bucket"] < 0:
            workers = r["w"]
        elif r["bucket"] == DIM:
            bias[r["label"]] = r["w"]
        else:
            weights[r["bucket"], r["label"]] = r["w"]
    model = Model(labels, idf, weights / workers, bias / workers)
    model.temperature = _temperature(model, sample.filter("use = 'calibrate'").orderBy("lang", "nth"))
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of each row."""
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    if model is None:
        return rows.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = rows.withColumn("letters", F.col("text").rlike(r"\p{L}"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            langs, scores = [], []
            for t, letters in zip(b["text"].to_pylist(), b["letters"].to_pylist(), strict=True):
                p = softmax(m.scores(t)) if letters else None
                langs.append(UNKNOWN if p is None else m.labels[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return rows.mapInArrow(named, T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
