import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tesserae.llm.toxicity import DISCOUNT, PAIR_DISCOUNT, SHARED_DISCOUNT, _count_words, fit_scale, toxicity_scores, train_models, without_toxic


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ten", "ra", "su", "vel"]) for _ in range(r.randrange(1, 4)))
    docs, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(r.randrange(20, 120))]
        toxic = int(r.random() < 0.15)
        for _ in range(toxic * r.randrange(2, 5)):
            words.insert(r.randrange(len(words)), r.choice(["grubworm", "nitwit", "scoundrel"]))
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, toxic))
    truth = dict(labels)
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), truth


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    rows = [r for r in toxicity_scores(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_scores_do_not_see_held_out_labels(corpus, spark):
    docs, labels, _ = corpus
    from tesserae.llm.toxicity import fold

    turned = labels.withColumn("toxic", (fold() == 0).cast("int") * (1 - labels.toxic) + (fold() != 0).cast("int") * labels.toxic)
    a = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, turned).collect()}
    assert a == b


def test_edges(edge, nothing, corpus):
    _, labels, _ = corpus
    rows = toxicity_scores(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity_scores(nothing, labels).count() == 0
    assert without_toxic(edge, labels).columns == edge.columns
    no_labels = labels.limit(0)
    assert toxicity_scores(edge, no_labels).count() == edge.count()


def brute_ratios(texts):
    """The docstring's models, word by word: the log ratio of a word after another."""
    pairs, words = [defaultdict(set), defaultdict(set)], [defaultdict(set), defaultdict(set)]
    for text, toxic in texts:
        row = [None, None, *text.lower().split()]
        for u, v, w in zip(row, row[1:], row[2:]):
            pairs[toxic][v, w].add(u if v is not None else None)
            words[toxic][w].add(v)
    every = {w: words[0][w] | words[1][w] for w in {*words[0], *words[1]}}
    n = [max(sum(map(len, words[c].values())), 1) for c in (0, 1)]
    d = [DISCOUNT * n[c] / min(n) for c in (0, 1)]
    total = sum(map(len, every.values()))
    excess = lambda c, w: max(len(words[c][w]) - d[c], 0) / n[c]
    rest = [1 - sum(excess(c, w) for w in every) for c in (0, 1)]
    word = lambda c, w: excess(c, w) + rest[c] * len(every.get(w, ())) / total
    count = [defaultdict(dict), defaultdict(dict)]
    for c in (0, 1):
        for (v, w), us in pairs[c].items():
            count[c][v][w] = len(us)

    def ratio(v, w):
        h = [sum(count[c][v].values()) if v in count[c] else 0 for c in (0, 1)]
        single = math.log(word(1, w) / word(0, w)) if w in every else math.log(rest[1] / rest[0])
        if min(h) <= PAIR_DISCOUNT:
            return single
        of = lambda c, x: count[c][v].get(x, 0)
        over = lambda c, x: max(of(c, x) / h[c] - PAIR_DISCOUNT / min(h), 0)
        kept = {x for c in (0, 1) for x in count[c][v] if over(0, x) or over(1, x)}
        both = lambda x: max(of(0, x) + of(1, x) - SHARED_DISCOUNT, 0) / sum(h)
        left = [1 - sum(over(c, x) for x in kept) for c in (0, 1)]
        if w not in kept:
            return single + math.log(left[1] / left[0]) if kept else single
        below = 1 - sum(both(x) for x in kept)
        p = [over(c, w) + left[c] * (both(w) + below * word(c, w)) for c in (0, 1)]
        return math.log(p[1] / p[0])

    return ratio


def test_ratios_as_written_down(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    texts = []
    for i in range(160):
        toxic = int(i % 3 == 0)
        row = [r.choice(words) for _ in range(30)]
        for k in range(0, 28, 7):
            row[k : k + 2] = ["you", "grub" if toxic else "are"] if r.random() < 0.6 else ["you", r.choice(words)]
        texts.append((" ".join(row), toxic))
    docs = spark.createDataFrame(texts, "text string, toxic int").repartition(3)
    models = train_models(docs.mapInArrow(_count_words, "context long, prior long, word long, toxic int"))
    assert len(models.pairs[0])
    want = brute_ratios(texts)
    for text in ["you grub you are w1 grub you", "w3 w4 unseen you unseen w5 are are", texts[0][0], texts[1][0]]:
        data = np.frombuffer(text.encode(), np.uint8)
        from tesserae.llm.toxicity import _hashed

        word, prior, _ = _hashed(data, np.array([0, len(data)]))
        row = [None, *text.split()]
        assert models.ratios(word, prior) == pytest.approx([want(v, w) for v, w in zip(row, row[1:])])


def test_copies_and_near_copies_weigh_nothing(spark):
    """A text's copies with another first word add nothing to the counts of its pairs but at their edge."""
    text = "one two three four five six you grub seven eight nine ten"
    rows = [(text, 1), ("a clean text about you and me and nobody else here", 0)]
    count = lambda more: train_models(spark.createDataFrame(rows + more, "text string, toxic int").mapInArrow(_count_words, "context long, prior long, word long, toxic int"))
    one, many = count([]), count([(text, 1)] * 5)
    assert one.word_ratio.tolist() == many.word_ratio.tolist() and one.other_ratio == many.other_ratio


def test_the_scale_is_a_logistic_fit():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 4))
    y = (x[:, 0] + 0.5 * r.normal(size=400) > 0).astype(float)
    mean, spread, w = fit_scale(x, y)
    a = np.c_[(x - mean[:4]) / spread[:4], np.ones(400)]
    p = 1 / (1 + np.exp(-(a @ w)))
    assert np.abs(a.T @ (p - y) + 0.01 * w).max() < 1e-6  # the penalised likelihood's slope is 0
