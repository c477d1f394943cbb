"""Quality classifier by hierarchical empirical Bayes.

A document's evidence comes from two logistic models over its hashed words and a few figures of style: one for
quality, one for toxicity. They are fitted on a hashed sample of at most `train_rows` labelled rows (a documented bound);
everything else covers all rows. The evidence of all documents is summed by host (the source) and by path (source and
language), and each level's rate of good documents is shrunk towards the level above: paths to their host, hosts to
the global rate, with a strength that the method of moments takes from how much the rates of a level vary. A document's
posterior adds its own evidence to the log-odds of its path.

Defined results: null texts are empty and have only the evidence of an empty text; a null source or language is a host or
path of its own; labels without a document, with nulls, and repeated labels of a document are ignored but for the first;
without labels of both kinds a model's evidence is 0; repeated rows are documents of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, materialised, words_of

STYLE = ("capitals", "digits", "marks", "odd_marks", "bars", "word_length", "different_words", "different_lines", "log_words", "top_word", "stops", "repeats")
ODD_MARKS = "#$%&*!|<>{}[]=~^@\\_"


def _classes() -> np.ndarray:
    """The class of each byte: 0 other letter, 1 capital, 2 digit, 3 blank, 4 mark, 5 odd mark, 6 bar, 7 stop, 8 inside a character."""
    of = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        of[b] = 1 if c.isupper() else 2 if c.isdigit() else 3 if b <= 32 else 6 if c == "|" else 7 if c in ".," else 5 if c in ODD_MARKS else 0 if c.isalpha() else 4
    of[128:192] = 8
    return of


CLASSES = _classes()


def style(text: str, words: list[str], counts: Counter) -> list[float]:
    """Figures of a text that don't depend on what its words mean."""
    letters, capitals, digits, blanks, marks, odd, bars, stops, inside = np.bincount(CLASSES[np.frombuffer(text.encode(), np.uint8)], minlength=9)[:9].tolist()
    letters += capitals
    n, m = max(1, letters + digits + blanks + marks + odd + bars + stops), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    return [
        capitals / max(1, letters),
        digits / n,
        marks / n,
        odd / n,
        bars / m,
        letters / m / 10,
        math.log(len(counts) + 1) / math.log(m + 2),
        len(set(lines)) / max(1, len(lines)),
        math.log(m + 1) / 10,
        max(counts.values(), default=0) / m,
        stops / m,
        sum(map(eq, words, words[1:])) / m,
    ]


def features(text: str, buckets: int) -> tuple[np.ndarray, list[float]]:
    """The buckets of a text's different words (lower case, outer marks cut off), and its style."""
    words = words_of(text)
    counts = Counter(words)
    kept = {w.strip(".,;:!?\"'()").translate(TO_LOWER) for w in counts}
    hashed = np.fromiter((zlib.crc32(w.encode()) % buckets for w in kept), np.int64, len(kept))
    return hashed, style(text, words, counts)


class Logistic:
    """Logistic regression on sets of buckets and dense figures, by full-batch Adagrad with a penalty on weights."""

    def __init__(self, buckets: int):
        self.words, self.bias = np.zeros(buckets, np.float32), 0.0
        self.dense, self.mean, self.scale = np.zeros(len(STYLE)), np.zeros(len(STYLE)), np.ones(len(STYLE))

    @classmethod
    def of(cls, state: dict) -> Logistic:
        model = cls(0)
        vars(model).update(state)
        return model

    def fit(self, flat: np.ndarray, row: np.ndarray, dense: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.5, penalty: float = 1e-5) -> Logistic:
        """flat, row: the buckets of all rows' words and the row of each; dense and y: style and class of each row."""
        if len(set(y.tolist())) < 2:
            return self
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        x = np.clip((dense - self.mean) / self.scale, -5, 5)
        used = np.flatnonzero(self._telling(np.bincount(flat, y[row], len(self.words)), np.bincount(flat, minlength=len(self.words)), y))
        number = np.full(len(self.words), -1, np.int32)
        number[used] = np.arange(len(used))
        some = number[flat] >= 0
        flat, row = number[flat[some]], row[some]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # both classes alike
        w, d, b = np.zeros(len(used)), np.zeros(x.shape[1]), 0.0
        gw, gd, gb = np.full(len(used), 1e-8), np.full(x.shape[1], 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(row, w[flat], len(y)) + x @ d + b
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
            dw, dd, db = np.bincount(flat, e[row], len(used)) + penalty * w, x.T @ e + penalty * d, e.sum()
            gw, gd, gb = gw + dw * dw, gd + dd * dd, gb + db * db
            w, d, b = w - rate * dw / np.sqrt(gw), d - rate * dd / np.sqrt(gd), b - rate * db / math.sqrt(gb)
        self.words[used], self.dense, self.bias = w, d, b
        return self

    @staticmethod
    def _telling(ones: np.ndarray, all_: np.ndarray, y: np.ndarray, least: float = 24.0) -> np.ndarray:
        """Which words occur in one class so much more often that chance is no likely cause: the G statistic is `least` or more."""
        share = y.mean()
        part = lambda a, e: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(e, 1e-9)), 0.0)
        return (all_ >= 5) & (2 * (part(ones, all_ * share) + part(all_ - ones, all_ * (1 - share))) >= least)

    def evidence(self, words: np.ndarray, dense: list[float]) -> float:
        """Log-likelihood ratio of the class: the model was fitted with both classes weighing alike."""
        x = np.clip((np.array(dense) - self.mean) / self.scale, -5, 5)
        return float(np.clip(self.words[words].sum() + x @ self.dense + self.bias, -30, 30))


def fitted(docs: DataFrame, labels: DataFrame, *, train_rows: int, buckets: int, seed: int) -> tuple[Logistic, Logistic, float, float]:
    """(quality model, toxicity model, share of good rows, share of toxic rows), from a bounded sample of labelled rows."""
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("l")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(train_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "l.quality", "l.toxic")  # at most train_rows ids

    def run(batches):
        for batch in batches:
            got = [features(x or "", buckets) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.int32) for w, _ in got], pa.list_(pa.int32())), pa.array([d for _, d in got], pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["words", "dense", "quality", "toxic"])

    sample = rows.mapInArrow(run, "words array<int>, dense array<double>, quality int, toxic int").toArrow()  # some hundred numbers a row
    if not sample.num_rows:
        return Logistic(buckets), Logistic(buckets), 0.5, 0.0
    words, dense = (sample.column(c).combine_chunks() for c in ("words", "dense"))
    flat, dense = words.flatten().to_numpy(), dense.flatten().to_numpy().reshape(sample.num_rows, -1)
    row = np.repeat(np.arange(sample.num_rows, dtype=np.int32), np.diff(words.offsets.to_numpy()))
    good, toxic = (sample.column(c).to_numpy().astype(float) for c in ("quality", "toxic"))
    return Logistic(buckets).fit(flat, row, dense, good), Logistic(buckets).fit(flat, row, dense, toxic), float(good.mean()), float(toxic.mean())


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def shrunk(level: DataFrame, rate: str, above: Column, name: str) -> DataFrame:
    """level (columns n, rate) with the rates shrunk towards those above, as if `strength` more documents had the rate above."""
    spread = level.agg(F.sum(F.col("n") * (F.col(rate) - above) ** 2).alias("between"), F.sum(above * (1 - above)).alias("within"), F.sum("n").alias("all"), F.sum(above * (1 - above) * F.col("n")).alias("most")).first()
    if not spread["all"]:
        return level.withColumn(name, above)
    # moments: expected between = sum of above (1 - above) (1 + (n - 1) rho), rho = 1 / (strength + 1)
    rho = (spread["between"] - spread["within"]) / max(1e-9, spread["most"] - spread["within"])
    rho = min(0.5, max(1e-4, rho))
    strength = 1 / rho - 1
    return level.withColumn(name, (F.col("n") * F.col(rate) + strength * above) / (F.col("n") + strength))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", carry: tuple[str, ...] = (), train_rows: int = 12_000, buckets: int = 1 << 20, least: float = 0.5, toxic_least: float = 0.25, seed: int = 42) -> DataFrame:
    """Of every row: doc_id, evidence, toxic_evidence (log-likelihood ratios), host_rate, path_rate (shrunk shares of good
    documents), quality (posterior), toxicity (posterior), keep (quality at `least` or more, toxicity beneath `toxic_least`).
    Columns named in `carry` come along."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.struct(*[F.col(c).alias(f"carried_{c}") for c in carry] or [F.lit(0).alias("none")]).alias("carried"))
    good_model, toxic_model, good_rate, toxic_rate = fitted(texts, labels, train_rows=train_rows, buckets=buckets, seed=seed)
    models = docs.sparkSession.sparkContext.broadcast([vars(m) for m in (good_model, toxic_model)])  # a fixed number of buckets

    def run(batches):
        good, toxic = (Logistic.of(x) for x in models.value)
        for batch in batches:
            got = [(good.evidence(w, d), toxic.evidence(w, d)) for w, d in (features(x or "", buckets) for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array([g for g, _ in got], pa.float64()), pa.array([t for _, t in got], pa.float64())], names=["doc_id", "host", "path", "carried", "evidence", "toxic_evidence"])

    good_rate = min(1 - 1e-3, max(1e-3, good_rate))
    toxic_rate = min(1 - 1e-3, max(1e-3, toxic_rate))
    scored = texts.mapInArrow(run, f"doc_id long, host string, path string, carried {texts.schema['carried'].dataType.simpleString()}, evidence double, toxic_evidence double")
    scored = materialised(scored.withColumn("p", sigmoid(F.col("evidence") + math.log(good_rate / (1 - good_rate)))))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    paths = materialised(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("rate"))
    everywhere = paths.agg(F.sum("s") / F.sum("n")).first()[0] or 0.5
    hosts = materialised(shrunk(hosts, "rate", F.lit(everywhere), "host_rate"))
    near = paths.join(hosts.select(F.col("host").alias("h"), "host_rate"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    near = shrunk(near.withColumn("rate", F.col("s") / F.col("n")), "rate", F.col("host_rate"), "path_rate")
    near = materialised(near.select(F.col("host").alias("h"), F.col("path").alias("p_"), "host_rate", "path_rate"))
    joined = scored.join(near, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p_")))
    safe = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("path_rate")))
    joined = joined.withColumn("quality", sigmoid(F.col("evidence") + logit(safe))).withColumn("toxicity", sigmoid(F.col("toxic_evidence") + math.log(toxic_rate / (1 - toxic_rate))))
    return joined.select("doc_id", "evidence", "toxic_evidence", "host_rate", "path_rate", "quality", "toxicity", ((F.col("quality") >= least) & (F.col("toxicity") < toxic_least)).alias("keep"), *[F.col(f"carried.carried_{c}").alias(c) for c in carry])
