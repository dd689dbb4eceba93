import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import tesserae.llm.katz as katz
from tesserae.llm.katz import K, discounts, katz_scores

SCHEMA = "doc_id long, text string, score string"


def texts():
    out = [f"the cat w{i % 7} the dog w{i % 11} a b{i} The end" for i in range(60)]
    return [*out, None, "", "  ", "the the the the " * 30, "unseen words only", "the cat", "the cat"]


def brute(rows):
    """The same model, written down directly."""
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None]

    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    train = [tokens(t) for (_, t), h in zip(rows, held) if not h]
    word = Counter(w for t in train for w in t)
    total = sum(word.values())
    pair = Counter((v, w) for t in train for v, w in zip(["<s>", *t], t))
    dw = discounts([sum(n == r for n in word.values()) for r in range(1, K + 2)]) if word else None
    dp = discounts([sum(n == r for n in pair.values()) for r in range(1, K + 2)])
    d = lambda x, n: x[n - 1] if n <= K else 1.0
    p = {w: d(dw, n) * n / total for w, n in word.items()}
    unknown = 1 - sum(p.values())
    count, after = Counter(), defaultdict(list)
    for (v, w), n in pair.items():
        count[v] += n
        after[v].append(w)
    alpha, scale = {}, {}
    for v in after:
        beta = sum((1 - d(dp, pair[v, w])) * pair[v, w] for w in after[v]) / count[v]
        scale[v] = 1.0
        if beta == 0:  # nothing discounted: one more token makes room
            scale[v], beta = count[v] / (count[v] + 1), 1 / (count[v] + 1)
        alpha[v] = beta / (1 - sum(p[w] for w in after[v]))
        whole = sum(scale[v] * d(dp, pair[v, w]) * pair[v, w] / count[v] for w in after[v]) + alpha[v] * (sum(p[w] for w in p if w not in after[v]) + unknown)
        assert whole == pytest.approx(1)
    out = []
    for (i, t), h in zip(rows, held):
        base = score = known_n = 0
        for v, w in zip(["<s>", *tokens(t)], tokens(t)):
            c = word.get(w, 0)
            known_n += c > 0
            base += math.log10((c + 0.1) / (total + 0.1 * (len(word) + 1)))
            if (v, w) in pair:
                score += math.log10(scale[v] * d(dp, pair[v, w]) * pair[v, w] / count[v])
            else:
                score += math.log10(alpha.get(v, 1.0) * p.get(w, unknown))
        out.append((i, h, len(tokens(t)), known_n, total, base, score))
    return out


@pytest.mark.parametrize("size", [6 << 20, 200])
def test_same_as_written_down(spark, size):
    """In one block for each task and in many."""
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, katz_scores(docs, block_bytes=size).collect()))
    for g, w in zip(got, brute(rows), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


def test_empty_table_and_null_ids(spark):
    assert katz_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    got = katz_scores(spark.createDataFrame([(None, "a b", ""), (None, "a b", ""), (1, None, "")], SCHEMA)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 3, 3] and len({r["score"] for r in got if r["n_tokens"] == 3}) == 1
    assert all(math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize("buckets", [1, 7])
def test_pairs_after_rare_words_of_a_large_table(spark, buckets):
    """Histories far below 1/10,000 of the tokens, and more pairs than a stored row holds."""
    rows = list(enumerate(" ".join(f"w{(i * 37 + k * k) % 9000} x{(i + k) % 50} of the" for k in range(60)) + f" rare{i % 300} pair{i % 300}" for i in range(900)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    for g, w in zip(sorted(map(tuple, katz_scores(docs, buckets=buckets).collect())), brute(rows), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


def test_histories_that_are_never_discounted(spark):
    """All pairs of some histories come more than K times, so one more token makes room; texts that do not train back off from them."""
    rows = [(i, "a b a b c d") for i in range(40)] + [(i, f"a x{i} b c zz") for i in range(40, 80)]
    docs = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA).repartition(5)
    for g, w in zip(sorted(map(tuple, katz_scores(docs, buckets=3).collect())), brute(rows), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


def test_other_partitions_are_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1}", "") for i in range(50)], SCHEMA).repartition(2)
    send = katz._send_texts
    monkeypatch.setattr(katz, "_send_texts", lambda batches, size: send((b.slice(1) for b in batches), size))
    with pytest.raises(Exception, match="other partitions"):
        katz_scores(docs).collect()


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (katz._keys(katz._steps(keys)) == keys).all()
    cuts = katz._cuts(keys, 7)
    assert all((b << 64) // 7 <= int(k) < ((b + 1) << 64) // 7 + 1 for b in range(7) for k in keys[cuts[b] : cuts[b + 1]])
