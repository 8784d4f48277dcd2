"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

A word is modelled letter by letter: its padded five-letter runs, so insults are known by their
stems too. Each class (labelled toxic, labelled ordinary) has letter counts n_c of its own at the
highest order and backs off to counts that both share,

    P_c(x|h) = max(n_c(h,x) - D, 0) / n_c(h) + D * types_c(h) / n_c(h) * P(x|h')

where P, for the shorter histories h' down to single letters, is the Kneser-Ney continuation
probability over both classes together: in how many different settings a run occurs, not how often.
A run that no labelled text holds is scored by the two backoff weights of its history,
``D * types_c(h) / n_c(h)``; only a history that is new too says nothing. A document's value is
the difference of its two log-likelihoods per word; a logistic curve over value and length,
fitted on a fold of its own, turns it into a score.

Counting is a Spark aggregation over all labelled training texts: words, then runs, then the
backoff levels by joins. What tasks get are all runs and histories, twelve bytes each. Only
labels and packed texts meet in the label join; scoring reads each text once and shuffles nothing.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from crawlspark.llm.scratch import Scratch

ORDER = 5
DISCOUNT = 0.75
FOLDS = 5
HELD_OUT = 0
CALIBRATION = 1
#: Runs whose two probabilities differ by less than one of these (log) say nothing, as chance differences of ordinary words can outweigh
#: a few insults. The calibration fold chooses: the one of the least log loss there, and with 0 all runs speak.
EVIDENCE = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)
#: Steps of the value axis in the calibration histogram, and its ends.
_BINS, _SPAN = 2000, 1.0
_WORD = re.compile(r"[^\W_]+")
_SEED = 42  # of the session's xxhash64


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo five; a null doc_id is in fold 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(2))


@dataclass
class Model:
    """Log-likelihood differences of letter runs and of histories, in the order of their hashes, and the curve."""

    key: np.ndarray
    delta: np.ndarray
    slope: float = 1.0
    by_length: float = 0.0
    shift: float = -2.0

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differences, 0 for those that are not there, and which are."""
        if not len(self.key):
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        there = self.key[at] == keys
        return np.where(there, self.delta[at], np.float32(0)), there

    def above(self, least: float) -> "Model":
        """The model without what says less; it stays there, so as not to count as unseen."""
        return replace(self, delta=np.where(np.abs(self.delta) >= least, self.delta, np.float32(0)))

    def score(self, value: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = (self.slope + self.by_length * np.log1p(words)) * value + self.shift
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Scorer(dict):
    """Difference of the two log-likelihoods of a word, remembered; emptied at 200,000 words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def learn(self, words: list[str]) -> None:
        if len(self) >= 200_000:
            self.clear()
        words = [w for w in dict.fromkeys(words) if w not in self]
        if not words:
            return
        runs, starts = [], []
        for word in words:
            padded = "^" * (ORDER - 1) + word + "$"
            starts.append(len(runs))
            runs += [padded[k : k + ORDER] for k in range(len(word) + 1)]
        delta, there = self.model.found(_hashes(runs))
        new = np.flatnonzero(~there)
        delta[new] = self.model.found(_hashes([runs[k][:-1] for k in new]))[0]
        self.update(zip(words, np.add.reduceat(delta.astype(float), starts).tolist(), strict=True))

    def value(self, text: str | None) -> tuple[float, int]:
        """Difference per word, and the number of words."""
        words = words_of(text)
        if not words:
            return 0.0, 0
        self.learn(words)
        return sum(map(self.__getitem__, words)) / len(words), len(words)


def _hashes(runs: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(r.encode("utf-8", "replace"), _SEED) for r in runs), np.uint64, len(runs))


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the text, compressed for the way through the label join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t.as_py() or b"") for t in batch.column(1)], pa.binary())], names=["doc_id", "packed"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, packed binary")


def _labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """(packed, toxic) of labelled documents. A document labelled twice counts as toxic if any label says so."""
    truth = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("toxic"))
    chosen = docs.where(F.col("doc_id").isNotNull() & keep).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # always the shuffled join: a small label table must not make a plan that larger ones don't have
    truth = truth.where(keep).withColumnRenamed("doc_id", "_id").hint("merge")
    return _packed(chosen).join(truth, F.col("doc_id") == F.col("_id")).select("packed", "toxic")


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, n0, n1): how often ordinary and toxic texts hold a word; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held = zstandard.ZstdDecompressor(), (Counter(), Counter())
        for batch in batches:
            for packed, toxic in zip(batch.column(0), batch.column(1), strict=True):
                held[toxic.as_py()].update(words_of(unpack.decompress(packed.as_py()).decode("utf-8", "replace")))
            if len(held[0]) + len(held[1]) > 200_000:
                yield from counted(held)
                held = (Counter(), Counter())
        yield from counted(held)

    def counted(held: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for k, counts in enumerate(held):
            n = pa.array(list(counts.values()), pa.int64())
            zeros = pa.array(np.zeros(len(counts), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), n if k == 0 else zeros, n if k else zeros], names=["word", "n0", "n1"])

    return labelled.mapInArrow(run, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def letter_runs(words: DataFrame) -> DataFrame:
    """(run, n0, n1): counts of the words' padded letter runs."""
    padded = F.concat(F.lit("^" * (ORDER - 1)), "word", F.lit("$"))
    starts = F.sequence(F.lit(1), F.char_length("word") + 1)
    runs = F.transform(starts, lambda i: F.substring(padded, i, F.lit(ORDER)))
    return words.select(F.explode(runs).alias("run"), "n0", "n1").groupBy("run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def differences(runs: DataFrame) -> DataFrame:
    """(run, n, delta): log P_toxic - log P_ordinary of the last letter of each run."""
    levels = [runs.select("run")]
    for length in range(ORDER - 1, 0, -1):  # continuation counts: different runs one letter longer that end so
        ending = F.substring("run", 2, length)
        above = levels[-1]
        levels.append(above.groupBy(ending.alias("run")).agg(F.count("*").alias("k")))
    shared = levels[-1].select("run", (F.col("k") / F.sum("k").over(Window.partitionBy())).alias("p"))
    for length in range(2, ORDER):
        history = Window.partitionBy(F.substring("run", 1, length - 1))
        level = levels[ORDER - length].withColumns({"s": F.sum("k").over(history), "t": F.count("*").over(history)})
        level = level.select(F.col("run").alias("full"), F.substring("run", 2, length - 1).alias("run"), "k", "s", "t").join(shared, "run")
        p = F.greatest(F.col("k") - DISCOUNT, F.lit(0.0)) / F.col("s") + DISCOUNT * F.col("t") / F.col("s") * F.col("p")
        shared = level.select(F.col("full").alias("run"), p.alias("p"))
    history = Window.partitionBy(F.substring("run", 1, ORDER - 1))
    top = runs.withColumns({f"s{c}": F.sum(f"n{c}").over(history) for c in (0, 1)} | {f"t{c}": F.count(F.when(F.col(f"n{c}") > 0, 1)).over(history) for c in (0, 1)})
    top = top.withColumnRenamed("run", "full").withColumn("run", F.substring("full", 2, ORDER - 1)).join(shared, "run")

    def p_of(c: int) -> Column:
        own = F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"s{c}") + DISCOUNT * F.col(f"t{c}") / F.col(f"s{c}") * F.col("p")
        return F.when(F.col(f"s{c}") > 0, own).otherwise(F.col("p"))

    return top.select(F.col("full").alias("run"), (F.col("n0") + F.col("n1")).alias("n"), F.log(p_of(1) / p_of(0)).alias("delta"))


def unseen(runs: DataFrame) -> DataFrame:
    """(run, delta): the difference of any other run, by its history (the run without its last letter): that of the backoff weights."""
    of = {f"s{c}": F.sum(f"n{c}") for c in (0, 1)} | {f"t{c}": F.count(F.when(F.col(f"n{c}") > 0, 1)) for c in (0, 1)}
    histories = runs.groupBy(F.substring("run", 1, ORDER - 1).alias("run")).agg(*(v.alias(k) for k, v in of.items()))
    weight = [F.when(F.col(f"s{c}") > 0, DISCOUNT * F.col(f"t{c}") / F.col(f"s{c}")).otherwise(F.lit(1.0)) for c in (0, 1)]
    return histories.select("run", F.log(weight[1] / weight[0]).alias("delta"))


def model_of(runs: DataFrame) -> Model:
    """All runs and histories, without a curve."""
    told = differences(runs).select("run", "delta").unionAll(unseen(runs))
    table = told.select(F.xxhash64("run").alias("h"), F.col("delta").cast("float").alias("delta")).toArrow()
    key, delta = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(key)
    return Model(key[order], delta[order])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Model of all labelled texts outside the held-out fold; one fold of them only calibrates the curve."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    counting = ~fold(F.col("doc_id")).isin(HELD_OUT, CALIBRATION)
    runs = scratch.table("runs", letter_runs(word_counts(_labelled(docs, labels, label, counting))))
    model = model_of(runs)
    scratch.drop("runs")
    least, (model.slope, model.by_length, model.shift) = _calibrate(model, docs, labels, label)
    return model.above(least)


def _calibrate(model: Model, docs: DataFrame, labels: DataFrame, label: str) -> tuple[float, tuple[float, float, float]]:
    """Least evidence, and the logistic curve over the calibration fold, fitted to a histogram of fixed size for each."""
    part = _labelled(docs, labels, label, fold(F.col("doc_id")) == CALIBRATION)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers, unpack = [Scorer(sent.value.above(least)) for least in EVIDENCE], zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [unpack.decompress(p.as_py()).decode("utf-8", "replace") for p in batch.column(0)]
            for k, scorer in enumerate(scorers):
                value, words = np.array([scorer.value(t) for t in texts], float).reshape(-1, 2).T
                at = np.round((np.clip(value, -_SPAN, _SPAN) + _SPAN) / (2 * _SPAN) * _BINS).astype(np.int32)
                length = (2 * np.log1p(words)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(length), batch.column(1)], names=["k", "at", "length", "toxic"])

    keys = ["k", "at", "length", "toxic"]
    bins = part.mapInArrow(run, "k int, at int, length int, toxic int").groupBy(*keys).agg(F.count("*").alias("n")).toArrow()
    which, at, length, toxic, n = (bins.column(k).to_numpy().astype(float) for k in range(5))
    if len(set(toxic)) < 2:
        return 0.0, (Model.slope, Model.by_length, Model.shift)
    fits = [_curve(*(x[which == k] for x in (at, length, toxic, n))) for k in range(len(EVIDENCE))]
    best = min(range(len(EVIDENCE)), key=lambda k: fits[k][0])
    return EVIDENCE[best], fits[best][1]


def _curve(at: np.ndarray, length: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, tuple[float, float, float]]:
    """Log loss and parameters of the fitted curve."""
    value = at / _BINS * 2 * _SPAN - _SPAN
    x = np.stack([value, value * length / 2, np.ones_like(value)], 1)
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x /= scale
    beta = np.zeros(3)
    for _ in range(100):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (p - toxic)) + 1e-4 * beta
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        step = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    loss = n * np.logaddexp(0, np.where(toxic > 0, -1, 1) * (x @ beta))
    return float(loss.sum()), tuple(float(b) for b in beta / scale)


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """The documents with a score in [0, 1]; label, language, source and doc_id play no part.

    Defined results: a null or empty text, or one without letters and digits, has value 0 and gets
    the score of a text that says nothing. All other columns stay; a column of the new one's name
    is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            value, words = np.array([scorer.value(t) for t in texts], float).reshape(-1, 2).T
            yield pd.Series(scorer.model.score(value, words))

    return docs.withColumn(column, judged(F.col("text").cast("string")))
