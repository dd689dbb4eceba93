"""Language-model scoring by Katz backoff.

Tokens are lower-cased words and one end per text. The model is a bigram model: a pair seen r times has the
Good-Turing discounted relative frequency d(r) r / c(history) for r up to K and the plain one beyond; a pair
not seen has alpha(history) p(word). Words are discounted the same way and what that frees is the
probability of an unknown word. alpha is what the history's pairs leave, divided by the probability
of all words not seen after it, so every distribution adds up to one exactly. Every word is a history, and so is the start of
a text; a history that training has not seen leaves the word its own probability.

Work is cut into blocks of texts and buckets of keys. A block sends its different words and pairs once, as sorted 64-bit keys
with their training counts, one row per bucket; a bucket adds them up, stores the table of counts and answers each block with
the totals of its keys in the same order. So a word or pair costs a bucket one entry per block, however frequent
it is, and no key travels twice. With the totals a block knows the discounted probabilities of all its tokens. What a
history's pairs leave is summed from blocks too: of all blocks that have a pair one owns it and counts it in. Histories'
weights are stored and answered like counts, to the blocks that back off from them. Only the counts of counts reach the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.blocks import LOWER, mix, pieces, word_hashes, words
from tesserae.llm.packing import pack, text_blocks, unpack
from tesserae.llm.shared import documents, durable, text_batches, whole

#: Counts up to K are discounted.
K = 5
#: Bytes and texts of a block. Bytes of text for which there is a bucket at least.
PACK_BYTES, PACK_TEXTS, SHARE_BYTES = 3 << 20, 60_000, 16 << 20
START, END = np.uint64(1), np.uint64(2)  # as hashes of words
#: Orders of n-grams, and the buckets of histories.
WORDS, PAIRS = 0, 1


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, of the token before it, and the number of tokens before each text."""
    found = []
    for i, j in pieces(offsets):
        low = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, before = words(low, offsets[i : j + 1] - offsets[i])
        found.append((word_hashes(low, starts, ends), np.diff(before)))
    hashes = np.concatenate([np.zeros(0, np.uint64), *(f[0] for f in found)])
    before = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)]))])
    n = len(offsets) - 1
    at = before + np.arange(n + 1)
    out = np.empty(len(hashes) + n, np.uint64)
    last = np.zeros(len(out), bool)
    last[at[1:] - 1] = True
    out[last] = END
    out[~last] = np.maximum(hashes, 3)
    prior = np.empty_like(out)
    prior[1:] = out[:-1]
    prior[at[:-1]] = START
    return out, prior, at


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Number, doc_id, held_out, and the tokens of up to ``size`` bytes of texts at a time (columns doc_id, held, text)."""
    from pyspark import TaskContext

    for k, (rows, data, offsets) in enumerate(text_blocks(batches, "text", size, PACK_TEXTS)):
        yield TaskContext.get().partitionId() << 24 | k, rows["doc_id"].combine_chunks(), rows["held"].to_numpy().astype(bool), _tokens(data, offsets)


_ROWS = "bucket int, kind int, block long, n array<long>, data binary"
_TYPES = {"bucket": pa.int32(), "kind": pa.int32(), "block": pa.int64(), "n": pa.list_(pa.int64()), "data": pa.binary()}
#: Kinds of rows: what a block sends, a stored table, sums, an answer to a block, a block's texts.
SENT, TABLE, SUMS, ANSWER, TEXTS = range(5)


def _rows(found: list[tuple]) -> pa.Table:
    """Rows of bucket, kind, block, n, data."""
    return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(_TYPES.values())], names=list(_TYPES))


def _planes(x: np.ndarray) -> np.ndarray:
    """Whole numbers byte by byte: all lowest bytes, then the next ones. High bytes are mostly 0 and take no room once compressed."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as planes of their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_numbers(planes), dtype=np.uint64)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's sorted keys begin: buckets are ranges of keys."""
    edges = [np.uint64(-(-(b << 64) // buckets)) for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def _pair_keys(words_: np.ndarray, which: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each token's pair with the token before it, and that history's place among the words."""
    history = np.empty_like(which)
    history[1:] = which[:-1]
    history[at[:-1]] = start
    spread = mix(words_ * np.uint64(0x9E3779B97F4A7C15))
    return mix(spread[history] * np.uint64(0xA5A3564EDCE5B0B3) + spread[which]), history


def _different(token: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The different words and the start, sorted; each token's place among these; the start's."""
    words_, which = np.unique(np.concatenate([token, [START]]), return_inverse=True)
    return words_, which[:-1], int(which[-1])


def _count(batches, buckets: int, size: int) -> Iterator[pa.RecordBatch]:
    """Each block's different words and pairs with their training counts; those of held-out texts alone have 0."""
    for block, _, held, (token, _, at) in _blocks(batches, size):
        train = np.repeat(~held, np.diff(at))
        words_, which, start = _different(token)
        pairs, pair = np.unique(_pair_keys(words_, which, at, start)[0], return_inverse=True)
        spread, order = _spread(words_)
        found = []
        for kind, keys, n in ((WORDS, spread, np.bincount(which, train, len(words_))[order]), (PAIRS, pairs, np.bincount(pair, train, len(pairs)))):
            cuts = _cuts(keys, buckets)
            for b in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[b], cuts[b + 1])
                found.append((kind * buckets + int(b), SENT, block, None, pack([_steps(keys[own]), _planes(n[own])])))
        yield from _rows(found).to_batches()


def _spread(words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as keys that fill all buckets evenly, sorted, and the words' order there. START and END keep keys of their own."""
    keys = mix(words_ + np.uint64(0x5851F42D4C957F2D))
    order = np.argsort(keys)
    return keys[order], order


def _sent(table: pa.Table, kinds: list) -> tuple[list[int], list[list[np.ndarray]]]:
    """Blocks in order and their arrays."""
    rows = sorted(zip(table["block"].to_pylist(), table["data"]), key=lambda r: r[0])
    return [b for b, _ in rows], [unpack(x.as_buffer(), kinds) for _, x in rows]


def _total(table: pa.Table, buckets: int) -> pa.Table:
    """One bucket: its stored table of counts, how many keys are seen how often, and each block's answer: its keys' totals, and whether
    it is the first block that has the key in training."""
    bucket = table["bucket"][0].as_py()
    blocks, sent = _sent(table, [np.uint8, np.uint8])
    keys = [_keys(x[0]) for x in sent]
    n = np.concatenate([_numbers(x[1]) for x in sent]).astype(np.int64)
    names, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, n, len(names)).astype(np.int64)
    seen = np.flatnonzero(n)
    owns = np.zeros(len(n), bool)
    owns[seen[np.unique(at[seen], return_index=True)[1]]] = True
    known = total > 0
    ends = np.cumsum([0, *map(len, keys)])
    out = [(bucket, ANSWER, block, None, pack([_planes(total[at[i:j]]), np.packbits(owns[i:j]), np.bitwise_xor.reduce(k)[None]])) for block, k, i, j in zip(blocks, keys, ends, ends[1:])]
    of = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()
    return _rows([*out, (bucket, TABLE, None, None, pack([_steps(names[known]), _planes(total[known])])), (bucket // buckets, SUMS, None, [int(total.sum()), *of, int(known.sum())], None)])


def discounts(of: np.ndarray) -> np.ndarray:
    """Katz's d(1) to d(K) from the numbers of types seen 1 to K + 1 times. Where these are too few or too uneven for
    a factor between 0 and 1, it is 1 - 1/(2r)."""
    out = 1 - 0.5 / np.arange(1, K + 1)
    if of[0] > 0:
        common = (K + 1) * of[K] / of[0]
        for r in range(1, K + 1):
            if of[r - 1] > 0 and common < 1:
                d = ((r + 1) * of[r] / (r * of[r - 1]) - common) / (1 - common)
                if 0 < d < 1:
                    out[r - 1] = d
    return out


class Weights:
    """What all buckets need: totals and discounts."""

    def __init__(self, word_sums: np.ndarray, pair_sums: np.ndarray):
        self.tokens, self.types = int(word_sums[0]), int(word_sums[K + 2])
        self.d_word = discounts(word_sums[1 : K + 2].astype(float))
        left = float((word_sums[1 : K + 1] * np.arange(1, K + 1) * (1 - self.d_word)).sum()) / max(self.tokens, 1)
        # nothing is discounted: one more token makes room for an unknown word
        self.scale = 1.0 if left > 0 else self.tokens / (self.tokens + 1)
        self.unknown = left if left > 0 else 1 / (self.tokens + 1)
        self.d_pair = discounts(pair_sums.astype(float))

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        d = np.concatenate([[0], self.d_word, [1]])[np.minimum(count, K + 1)]
        return np.where(count > 0, self.scale * d * count / max(self.tokens, 1), self.unknown)

    def left_and_seen(self, n: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the discount of each pair frees, and the probability of its word if the pair is seen."""
        d = np.concatenate([[1], self.d_pair, [1]])[np.minimum(n, K + 1)]
        return (1 - d) * n, np.where(n > 0, word, 0.0)

    def alpha(self, count: np.ndarray, left: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weight of histories and the factor of their pairs."""
        some = left > 0  # if not, as for words
        beta = np.where(some, left / count, 1 / (count + 1))
        return beta / np.maximum(1 - seen, self.unknown), np.where(some, 1.0, count / (count + 1))

    def discounted(self, n: np.ndarray) -> np.ndarray:
        """Counts of pairs after their discount."""
        return np.concatenate([[0], self.d_pair, [1]])[np.minimum(n, K + 1)] * n


def _send_texts(batches, size: int) -> Iterator[pa.RecordBatch]:
    """Each block's rows and tokens, as places among its words."""
    for block, ids, held, (token, _, at) in _blocks(batches, size):
        words_, which, _ = _different(token)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        data = [ids.cast(pa.int64()).fill_null(0).to_numpy(), valid.astype(np.uint8), held.astype(np.uint8), np.diff(at).astype(np.int64), _steps(words_), which.astype(np.uint16), (which >> 16).astype(np.uint16)]
        yield from _rows([(0, TEXTS, block, None, pack(data))]).to_batches()


_TEXTS = [np.int64, np.uint8, np.uint8, np.int64, np.uint8, np.uint16, np.uint16]
#: What a block knows of its texts before the weights of histories: rows, known tokens, base scores, scores without weights; then
#: entries of a text and a history (its place among those asked for) with how often its weight and its scale count.
_PARTIAL = [np.int64, np.uint8, np.uint8, np.int64, np.int64, np.float64, np.float64, np.int64, np.int64, np.int64, np.int64]


def _answered(table: pa.Table, first: int, buckets: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals and ownership of a block's sorted keys from the answers of buckets ``first`` and on."""
    found = {b: unpack(x.as_buffer(), [np.uint8, np.uint8, np.uint64]) for b, x in zip(table["bucket"].to_pylist(), table["data"])}
    total, owns, cuts = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), _cuts(keys, buckets)
    for b in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[b], cuts[b + 1])
        planes, bits, check = found.get(first + int(b), (np.zeros(0, np.uint8), None, np.zeros(1, np.uint64)))
        if len(planes) != 8 * (cuts[b + 1] - cuts[b]) or check[0] != np.bitwise_xor.reduce(keys[own]):
            raise RuntimeError("the documents came in other partitions when they were read again: write them to a table first")
        total[own] = _numbers(planes)
        owns[own] = np.unpackbits(bits, count=cuts[b + 1] - cuts[b])
    return total, owns


def _measure(texts: pa.Table, answers: pa.Table, weights: Weights, buckets: int) -> pa.Table:
    """One block with its answers: what it adds to its histories' sums, and its texts' scores but for the weights."""
    if not len(texts):
        return _rows([])
    block = texts["block"][0].as_py()
    ids, valid, held, tokens, steps, low, high = unpack(texts["data"][0].as_buffer(), _TEXTS)
    words_, which = _keys(steps), low.astype(np.int64) | high.astype(np.int64) << 16
    start, end = np.searchsorted(words_, [START, END])
    at = np.concatenate([[0], np.cumsum(tokens)])
    spread, order = _spread(words_)
    count = np.zeros(len(words_), np.int64)
    count[order] = _answered(answers, WORDS * buckets, buckets, spread)[0]
    key, history = _pair_keys(words_, which, at, int(start))
    pairs, first, pair = np.unique(key, return_index=True, return_inverse=True)
    n, owns = _answered(answers, PAIRS * buckets, buckets, pairs)
    of = count.copy()
    of[start] = count[end]  # the start comes as often as the end
    # by pair
    before, word = history[first], weights.word_probability(count[which[first]])
    left, seen = weights.left_and_seen(n, word)
    add = lambda x, some: np.bincount(before[some], x[some], len(words_))
    mine, discounted = owns & (n > 0), add(left, n > 0) > 0
    own_left, own_seen = add(left, mine), add(seen, mine)
    score = np.log10(np.where(n > 0, weights.discounted(n) / np.maximum(of[before], 1), word))
    # a weight counts for pairs that are not seen; a scale may count where no pair here shows that the history is discounted
    weigh, scale = (n == 0) & (of[before] > 0), (n > 0) & ~discounted[before]
    text = np.repeat(np.arange(len(ids)), tokens)
    sums = [np.bincount(text, x, len(ids)) for x in ((count[which] > 0).astype(float), np.log10((count[which] + 0.1) / (weights.tokens + 0.1 * (weights.types + 1))), score[pair])]
    open_ = np.flatnonzero((weigh | scale)[pair])
    entries, back = np.unique(text[open_] * len(words_) + history[open_], return_inverse=True)
    times = [np.bincount(back, x[pair[open_]], len(entries)).astype(np.int64) for x in (weigh, scale)]
    asked, place = np.unique(entries % len(words_), return_inverse=True)
    # histories are keyed like words, so a history is in one bucket whichever block it comes from
    told = np.union1d(np.flatnonzero(np.bincount(before[mine], minlength=len(words_))), asked)
    keys, by = _spread(words_[told])
    told = told[by]
    wanted = np.isin(told, asked)
    found, cuts = [], _cuts(keys, buckets)
    for b in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[b], cuts[b + 1])
        found.append((int(b), SENT, block, None, pack([_steps(keys[own]), _planes(of[told[own]]), own_left[told[own]], own_seen[told[own]], np.packbits(wanted[own])])))
    # asked histories in the order in which they are answered
    rank = np.zeros(len(words_), np.int64)
    rank[told[wanted]] = np.arange(wanted.sum())
    partial = [ids, valid, held, tokens, sums[0].astype(np.int64), sums[1], sums[2], entries // len(words_), rank[asked[place]], *times]
    return _rows([*found, (-1 - block % (4 * buckets), TEXTS, block, None, pack(partial))])


def _weigh(table: pa.Table, weights: Weights) -> pa.Table:
    """One bucket of histories: their stored weights, and each block's answer. Rows of texts stay as they are."""
    bucket = table["bucket"][0].as_py()
    if bucket < 0:
        return table
    blocks, sent = _sent(table, [np.uint8, np.uint8, np.float64, np.float64, np.uint8])
    keys = [_keys(x[0]) for x in sent]
    names, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    of = np.concatenate([_numbers(x[1]) for x in sent]).astype(np.int64)[first]
    # sums in the order of blocks, so that they are the same each time
    left, seen = (np.bincount(at, np.concatenate([x[c] for x in sent]), len(names)) for c in (2, 3))
    alpha, scale = weights.alpha(of, left, seen)
    out, ends = [(bucket, TABLE, None, None, pack([_steps(names), _planes(of), alpha, scale]))], np.cumsum([0, *map(len, keys)])
    for block, x, i, j in zip(blocks, sent, ends, ends[1:]):
        wanted = at[i:j][np.unpackbits(x[4], count=j - i).astype(bool)]
        if len(wanted):
            out.append((bucket, ANSWER, block, None, pack([alpha[wanted], scale[wanted]])))
    return _rows(out)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """One block's rows with their scores."""
    names, kinds = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    if not len(texts):
        return pa.table([pa.array([], t) for t in kinds], names=names)
    ids, valid, held, tokens, known, base, score, text, place, weighed, scaled = unpack(texts["t_data"][0].as_buffer(), _PARTIAL)
    rows = [unpack(x.as_buffer(), [np.float64, np.float64]) for _, x in sorted(zip(answers["a_bucket"].to_pylist(), answers["a_data"]), key=lambda r: r[0])] if len(answers) else []
    if rows:
        alpha, scale = (np.log10(np.concatenate([r[c] for r in rows])) for c in (0, 1))
        score = score + np.bincount(text, weighed * alpha[place] + scaled * scale[place], len(ids))
    return pa.table([pa.array(ids, mask=valid == 0), pa.array(held.astype(bool)), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)], names=names)


def katz_scores(docs: DataFrame, buckets: int | None = None, block_bytes: int = PACK_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Null and empty texts have one token, the end. Rows count as often as they come, repeated or not; a null doc_id
    trains. Without training tokens everything is unknown: base_score and score stay finite. An empty
    table gives no rows. Texts of any length are scored whole. The documents are read twice and must come in the same
    partitions both times, as tables do; that is checked, and anything else is an error.
    """
    spark = docs.sparkSession
    text_batches(spark, 64)  # a bucket's rows have up to some hundred kilobytes
    texts = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held"), whole("text").alias("text"))
    if not buckets:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARE_BYTES)
    sent = texts.mapInArrow(lambda b: _count(b, buckets, block_bytes), _ROWS)
    counts = durable(sent.groupBy("bucket").applyInArrow(lambda t: _total(t, buckets), _ROWS), "katz-counts")
    sums = {r["bucket"]: np.array(r["n"], np.int64) for r in counts.where(F.col("kind") == SUMS).groupBy("bucket").agg(F.array(*(F.sum(F.col("n")[i]) for i in range(K + 3))).alias("n")).collect()}  # a row for words and one for pairs
    none = np.zeros(K + 3, np.int64)
    weights = spark.sparkContext.broadcast(Weights(sums.get(WORDS, none), sums.get(PAIRS, none)[1 : K + 2]))
    answers = counts.where(F.col("kind") == ANSWER).groupBy("block")
    blocks = texts.mapInArrow(lambda b: _send_texts(b, block_bytes), _ROWS).groupBy("block")
    measured = blocks.cogroup(answers).applyInArrow(lambda t, a: _measure(t, a, weights.value, buckets), _ROWS)
    stored = durable(measured.groupBy("bucket").applyInArrow(lambda t: _weigh(t, weights.value), _ROWS), "katz-weights")
    # one table from two sides: renamed, so that their columns are told apart
    partial, answers = (stored.where(F.col("kind") == kind).toDF(*(f"{side}{c}" for c in stored.columns)) for side, kind in (("t_", TEXTS), ("a_", ANSWER)))
    rows = partial.groupBy("t_block").cogroup(answers.groupBy("a_block")).applyInArrow(_score, _SCORES)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(weights.value.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_katz(spark, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))
