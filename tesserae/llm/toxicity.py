"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of word pairs. Counts are Kneser-Ney's: after how many different words has the pair, or the word, been seen
in the class? So copies and near copies of a text weigh nothing. In a
class a word follows another with its discounted share of the pairs of that history; what the discounts free goes to the same
share over both classes, and what this frees to the class's word model. That
is discounted in turn, and what that frees goes to the word's count over both classes, the backoff that they share.
Discounts are in proportion to the classes' sizes, for each history and for the words, so an expression too
rare to tell the classes apart has the shared probability in either, and its logarithms differ by a constant only.

A document is judged by the difference of its log-likelihoods in the two models, divided by the number of words that it is taken
over: over all its words, over its most telling ones, and over its most telling one. A logistic fit on labelled
rows that the models have not seen puts these, and the length, on a scale from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.blocks import mix, pieces, utf8, word_hashes
from tesserae.llm.blocks import words as split_words
from tesserae.llm.shared import documents, durable, fresh, text_batches, whole

#: Labelled rows that the models and the logistic fit may learn from, at most; those with the smallest hash are taken.
MODEL_ROWS, FIT_ROWS = 12_000, 6_000
#: Discounts of the rarer class's counts of words and of pairs; the other's are larger by the ratio of their sizes.
DISCOUNT, PAIR_DISCOUNT = 1.5, 3.0
#: Discount of pairs of both classes together.
SHARED_DISCOUNT = 0.75
TOP = 3

# Bytes as words see them: A-Z lower case, other ASCII signs as spaces.
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[48:58], _CLEAN[97:123], _CLEAN[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, hash of the word before it (0 at the start of a text), words before each text."""
    clean = _CLEAN[data]
    starts, ends, before = split_words(clean, offsets)
    word = word_hashes(clean, starts, ends)
    return word, _before(word, before), before


def _before(value: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The value of the word before each word, 0 at the start of a text."""
    out = np.zeros_like(value)
    out[1:] = value[:-1]
    out[before[:-1][np.diff(before) > 0]] = 0
    return out


def _pair(prior: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(prior * np.uint64(0x9E3779B97F4A7C15) + word)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's different word pairs with the words before them."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = utf8(batch.column(0))
        for i, j in pieces(offsets):
            word, prior, before = _hashed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc = np.repeat(np.arange(j - i), np.diff(before)).astype(np.uint64)
            context = _before(prior, before)
            _, at = np.unique(_pair(_pair(doc, context), _pair(prior, word)), return_index=True)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[at].view(np.int64)) for x in (context, prior, word)), pa.array(toxic[i:j][doc[at].astype(np.int64)].astype(np.int32))],
                names=["context", "prior", "word", "toxic"],
            )


class Models:
    """The log ratio of the classes' probabilities of words, as sorted arrays. Only words, histories and pairs that exceed a
    discount are kept, so 1/discount of the learning rows' words bounds them; all others have one ratio.

    word: of a word by itself. after: what backing off from a history adds. pair: of the pairs kept."""

    def __init__(self, words: np.ndarray, word_ratio: np.ndarray, other_ratio: float, after: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]):
        self.words, self.word_ratio, self.other_ratio, self.after, self.pairs = words, word_ratio, other_ratio, after, pairs

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, at

    def ratios(self, word: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Log of toxic to ordinary probability of each word after the word before it."""
        out = np.full(len(word), self.other_ratio)
        known, at = self._find(self.words, word)
        out[known] = self.word_ratio[at[known]]
        known, at = self._find(self.after[0], prior)
        out[known] += self.after[1][at[known]]
        known, at = self._find(self.pairs[0], _pair(prior, word))
        out[known] = self.pairs[1][at[known]]
        return out

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        word, prior, before = _hashed(data, offsets)
        ratio = self.ratios(word, prior)
        n = np.diff(before)
        out = np.zeros((len(n), 4))
        total = np.concatenate([[0], np.cumsum(ratio)])
        out[:, 0] = (total[before[1:]] - total[before[:-1]]) / np.maximum(n, 1)
        doc = np.repeat(np.arange(len(n)), n)
        filled = np.flatnonzero(n > 0)
        for k in range(TOP if len(filled) else 0):  # the most telling word, then the next
            best = np.maximum.reduceat(ratio, before[filled])
            if k == 0:
                out[filled, 1] = np.maximum(best, 0)
            out[filled, 2] += np.maximum(best, 0) / TOP
            order = np.flatnonzero(ratio == np.repeat(best, n[filled]))
            _, first = np.unique(doc[order], return_index=True)
            ratio[order[first]] = -np.inf
        out[:, 3] = np.log1p(n)
        return out


def train_models(counted: DataFrame, discount: float = DISCOUNT, pair_discount: float = PAIR_DISCOUNT) -> Models:
    """counted: context, prior, word, toxic of each learning text's pairs (their number is bounded, so is what comes here)."""
    contexts = counted.groupBy("context", "prior", "word").agg(F.max(1 - F.col("toxic")).alias("c0"), F.max("toxic").alias("c1"))
    pairs = durable(contexts.groupBy("prior", "word").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1")), "toxicity-pairs")
    seen = [(F.col(c) > 0).cast("long") for c in ("n0", "n1")]
    words = durable(pairs.groupBy("word").agg(F.sum(seen[0]).alias("n0"), F.sum(seen[1]).alias("n1"), F.count(F.lit(1)).alias("both")), "toxicity-words")
    total = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "both"))).first()
    n = np.maximum([total["n0"], total["n1"]], 1).astype(float)
    d = discount * n / n.min()
    kept = words.where((F.col("n0") > float(d[0])) | (F.col("n1") > float(d[1])))
    # a pair exceeds a discount if the rarer class would be expected to have it more than ``pair_discount`` times
    sums = pairs.groupBy("prior").agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1")).where(f"least(h0, h1) > {pair_discount}")
    times = F.col("least_h") / F.lit(float(pair_discount))
    over = pairs.join(sums.withColumn("least_h", F.least("h0", "h1")), "prior").where((F.col("n0") * times > F.col("h0")) | (F.col("n1") * times > F.col("h1")))
    over = over.join(words.select("word", "both", F.col("n0").alias("w0"), F.col("n1").alias("w1")), "word").toPandas()
    kept = kept.toPandas()

    def word_probability(counts: np.ndarray, both: np.ndarray) -> np.ndarray:
        return np.maximum(counts - d, 0) / n + rest * (both / max(total["both"], 1))[:, None]

    rest = np.maximum(1 - (np.maximum(kept[["n0", "n1"]].to_numpy(float) - d, 0) / n).sum(axis=0), 1e-9)  # what each class leaves to the shared counts
    p = word_probability(kept[["n0", "n1"]].to_numpy(float), kept["both"].to_numpy(float))
    word = kept["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    h = over[["h0", "h1"]].to_numpy(float)
    n2 = over[["n0", "n1"]].to_numpy(float)
    off = pair_discount / h.min(axis=1, initial=np.inf)
    # of the classes, and of both together, from which each pair gives a part of one
    excess = np.maximum(np.c_[n2 / h - off[:, None], (n2.sum(axis=1) - SHARED_DISCOUNT) / h.sum(axis=1)], 0)
    prior = over["prior"].to_numpy(np.int64).view(np.uint64)
    histories, which = np.unique(prior, return_inverse=True)
    left = np.maximum(1 - np.stack([np.bincount(which, excess[:, c], len(histories)) for c in range(3)], 1), 1e-9)  # what each history leaves to the next level
    shared = excess[:, 2:] + left[which, 2:] * word_probability(over[["w0", "w1"]].to_numpy(float), over["both"].to_numpy(float))
    q = excess[:, :2] + left[which, :2] * shared
    pair = _pair(prior, over["word"].to_numpy(np.int64).view(np.uint64))
    by = np.argsort(pair)
    return Models(word[order], np.log(p[:, 1] / p[:, 0])[order], float(np.log(rest[1] / rest[0])), (histories, np.log(left[:, 1] / left[:, 0])), (pair[by], np.log(q[:, 1] / q[:, 0])[by]))


def fit_scale(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps; the first row of the result is subtracted, the second divides."""
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(4), np.ones(4))
    a = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty * np.eye(5), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.array([[*mean, 0], [*spread, 1], w])


def _probability(scale: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = ((x - scale[0, :4]) / scale[1, :4]) @ scale[2, :4] + scale[2, 4]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features_of(models, column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    return np.concatenate([np.zeros((0, 4)), *(models.features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in pieces(offsets))])


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def toxicity_scorer(docs: DataFrame, labels: DataFrame, model_rows: int = MODEL_ROWS, fit_rows: int = FIT_ROWS):
    """A function of a text column that gives the score. Learns from labelled rows with fold 1 to 4 alone: the models
    from 1 to 3, the scale from 4. A doc_id with several labels counts as toxic if one says so; labels without
    a document, documents without a label and null labels are left out. With one class only every score is
    the share of toxic rows."""
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(fold() != 0)
    taken = [
        known.where(part).withColumn("fit", F.lit(fit)).orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").limit(rows)
        for part, fit, rows in ((fold() != 4, 0, model_rows), (fold() == 4, 1, fit_rows))
    ]
    # at most model_rows + fit_rows rows of two numbers
    sample = durable(docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id").select("text", "toxic", "fit"), "toxicity-sample")
    counted = sample.where("fit = 0").select("text", "toxic").mapInArrow(_count_words, "context long, prior long, word long, toxic int")
    models = spark.sparkContext.broadcast(train_models(counted))

    def measured(batches):
        for b in batches:
            x = _features_of(models.value, b.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(4)), b.column(1)], names=["x0", "x1", "x2", "x3", "toxic"])

    seen = sample.where("fit = 1").select("text", "toxic").mapInArrow(measured, "x0 double, x1 double, x2 double, x3 double, toxic int").toPandas()
    scale = fit_scale(seen[["x0", "x1", "x2", "x3"]].to_numpy(float), seen["toxic"].to_numpy(float))

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(_probability(scale, _features_of(models.value, text)))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted.

    The score depends on the text alone; null and empty texts have the score of a text without words. Repeated
    rows have equal scores. A null doc_id is not held out. An empty table gives no rows.
    """
    score = toxicity_scorer(docs, labels, **options)
    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), score(whole("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    name = fresh(docs, "score")
    return docs.withColumn(name, toxicity_scorer(docs, labels, **options)(whole("text"))).where(F.col(name) < threshold).select(*docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
