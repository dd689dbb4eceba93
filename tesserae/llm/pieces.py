"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE model's text becomes symbols, one per character; an agenda holds the candidate merges of neighbours and
takes the best-scored, leftmost one first. With dropout each candidate is skipped if a keyed hash of (seed,
doc_id, the word and its place in the document, its two symbols' places, its piece) falls below the rate, so a seed and a document give one
segmentation wherever and however often it is computed, and other seeds give others. Decoding joins the
pieces; unknown characters travel as bytes, so every segmentation decodes to the text itself.

Words are worked on together: merges never cross the start of a word, so one numpy round takes the agenda's
top of each word of a block. Words of over LONG symbols use a heap of their own. Equal words are cut once without
dropout, and the merges taken then are kept. Where none of these is skipped that cut stands, since a skipped candidate that
would not have been taken changes nothing; all other words are cut anew.
"""

from __future__ import annotations

import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.blocks import mix, pieces, powers, utf8
from tesserae.llm.shared import documents, text_batches, whole

#: A BPE model of the sentencepiece library; every function here takes another one as ``model``.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 11
LONG = 200
#: Words whose pieces without dropout a task keeps.
CACHED = 1 << 17
_MARK = 0x2581  # stands for a space inside pieces
_OTHER = 0x110000  # stands for that mark itself where a text has it
_NEVER = np.int64(2**62)
_WORD = 2**64 - 1


def _limit(dropout: float) -> np.uint64:
    return np.uint64(min(max(dropout, 0.0), 1.0) * (2**64 - 2048))


def read_model(path: str = MODEL) -> tuple[list[str], list[float], list[bool], list[bool]]:
    """Pieces, scores, which are bytes, and which are neither text nor bytes."""
    import sentencepiece

    if not os.path.isfile(path):
        raise FileNotFoundError(f"no SentencePiece model at {path}: pass the path of one that the driver can read as model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(m.vocab_size())
    return [m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], [m.is_byte(i) for i in n], [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in n]


def _named(key: int, where: int, mid: int, piece: int) -> int:
    """A candidate's number under a word's key; where and mid count from the word's start."""
    return (key + where * 0xD6E8FEB86659FD93 + (mid - where) * 0xA5A3564EDCE5B0B3 + piece) & _WORD


def _mix(x: int) -> int:
    """blocks.mix of one number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WORD
    return x ^ (x >> 31)


class Pool:
    """An array that grows."""

    def __init__(self, kind):
        self.values, self.size = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> int:
        """Where the values begin."""
        begin, end = self.size, self.size + len(values)
        if end > len(self.values):
            grown = np.zeros(max(end, 2 * len(self.values)), self.values.dtype)
            grown[:begin] = self.values[:begin]
            self.values = grown
        self.values[begin:end] = values
        self.size = end
        return begin


class Merger:
    """The model's tables for numpy."""

    def __init__(self, model: tuple[list[str], list[float], list[bool], list[bool]]):
        names, scores, is_byte, is_special = model
        self.cached_for, self.known = None, []
        self.pool, self.met_pool = Pool(np.int32), Pool(np.uint64)
        self.met: list | None = None
        self.size = len(names)
        text = {p: i for i, p in enumerate(names) if not is_byte[i] and not is_special[i]}
        if any("▁" in p.lstrip("▁") for p in text):
            raise ValueError("a piece crosses the start of a word")
        symbols = dict(text)
        for p in text:
            for c in p:  # characters that only occur inside pieces
                symbols.setdefault(c, len(names) + len(symbols) - len(text))
        self.of_char = np.full(_OTHER + 1, -1, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        order = sorted(text.values(), key=lambda i: (-scores[i], i))
        self.rank = np.zeros(self.size, np.int64)
        same = {s: k for k, s in enumerate(sorted({scores[i] for i in order}, reverse=True))}
        for i in order:  # equal scores have equal rank: then the leftmost goes first
            self.rank[i] = same[scores[i]]
        pairs = {}
        for p, i in text.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i  # 40 bits, and 20 for the piece
        self._hash(pairs)
        self.pairs = pairs
        self.byte = np.full(256, -1, np.int32)
        for i, p in enumerate(names):
            if is_byte[i]:
                self.byte[int(p[1:-1], 16)] = i
        raw = [bytes([int(p[1:-1], 16)]) if is_byte[i] else b"" if is_special[i] else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)

    def _hash(self, pairs: dict[int, int]) -> None:
        """Two tables; each pair stands at its place in one of them (cuckoo hashing)."""
        self.bits = max(18, len(pairs).bit_length() + 1)
        keys = np.array(list(pairs) or [0], np.uint64)
        places = [p.tolist() for p in self._places(keys)]
        tables: list[dict[int, int]] = [{}, {}]
        for first in range(len(pairs)):
            k, side = first, 0
            for _ in range(500):
                at = places[side][k]
                out = tables[side].get(at)
                tables[side][at] = k
                if out is None:
                    break
                k, side = out, 1 - side
            else:
                raise ValueError("no place for a pair")
        packed = keys << np.uint64(20) | np.array(list(pairs.values()) or [0], np.uint64)
        self.tables = np.full((2, 1 << self.bits), np.iinfo(np.uint64).max, np.uint64)
        for side in (0, 1):
            at, k = np.array(list(tables[side]), np.int64), np.array(list(tables[side].values()), np.int64)
            self.tables[side][at] = packed[k]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> shift, (keys * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or -1. An unknown symbol (-1) makes a key that no table has."""
        keys = (left << 20 | right).view(np.uint64)
        a, b = self._places(keys)
        found = self.tables[0][a]
        hit = found >> np.uint64(20) == keys
        rest = np.flatnonzero(~hit)
        other = self.tables[1][b[rest]]
        there = other >> np.uint64(20) == keys[rest]
        rest = rest[there]
        found[rest], hit[rest] = other[there], True
        return np.where(hit, (found & np.uint64(0xFFFFF)).view(np.int64), -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, and the n + 1 places where each text's pieces start."""
        code, at = self._characters(data, offsets)
        head = np.zeros(len(code) + 1, bool)
        head[at] = True
        mark = code == _MARK
        head[1:-1] |= mark[1:] & ~mark[:-1]
        starts = np.flatnonzero(head[:-1])
        lengths = np.diff(np.concatenate([starts, [len(code)]]))
        first = np.searchsorted(starts, at)  # words before each text
        up, down = powers(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code + 1).view(np.uint64) * up[: len(code)], out=total[1:])
        word = mix((total[starts + lengths] - total[starts]) * down[starts] + lengths.view(np.uint64))
        keys, one, which = np.unique(word, return_index=True, return_inverse=True)
        if self.cached_for != (seed, dropout):
            self.cached_for, self.known = (seed, dropout), []
            self.pool.size = self.met_pool.size = 0
        # where the words' pieces without dropout are, and the merges taken: from the tables of earlier blocks or made now
        at_pool = np.zeros((4, len(keys)), np.int64)
        new = np.arange(len(keys))
        for known, places in self.known:
            spot = np.minimum(np.searchsorted(known, keys[new]), len(known) - 1)
            old = known[spot] == keys[new]
            at_pool[:, new[old]] = places[:, spot[old]]
            new = new[~old]
        made, made_at, found, found_at = self._plain(code, starts[one[new]], lengths[one[new]], dropout > 0)
        sizes = self.pool.size, self.met_pool.size
        at_pool[:, new] = made_at[:-1] + self.pool.add(made), np.diff(made_at), found_at[:-1] + self.met_pool.add(found), np.diff(found_at)
        froms, counts = at_pool[0][which], at_pool[1][which]
        cut = np.zeros(0, np.int32)
        if dropout > 0:
            # seed, document and the word's place in it are the key
            place = (np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))).view(np.uint64)
            own = mix(np.repeat(mix(ids.view(np.uint64) + np.uint64(1)), np.diff(first)) + place)
            own = mix(word + own * np.uint64(0xA5A3564EDCE5B0B3)) ^ mix(np.array([seed & _WORD], np.uint64))
            again = np.flatnonzero(self._skips(self.met_pool.values, at_pool[2][which], at_pool[3][which], own, dropout))
            cut, cut_at = self._segment(code, starts[again], lengths[again], own[again], dropout)
            begin = self.pool.add(cut)
            froms[again], counts[again] = cut_at[:-1] + begin, np.diff(cut_at)
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = self.pool.values[np.arange(ends[-1]) + np.repeat(froms - ends[:-1], counts)]
        if sum(len(t[0]) for t in self.known) < CACHED:
            sizes = sizes[0] + len(made), sizes[1] + len(found)
            self._keep(keys[new], at_pool[:, new])
        self.pool.size, self.met_pool.size = sizes
        return out, ends[first]

    @staticmethod
    def _skips(met: np.ndarray, begin: np.ndarray, n: np.ndarray, keys: np.ndarray, dropout: float) -> np.ndarray:
        """Whether any merge of each word (n of them from ``begin`` on in ``met``) is skipped under the word's key."""
        out, limit = np.zeros(len(n), bool), _limit(dropout)
        left = np.arange(len(n))  # words with more than k merges and none skipped so far
        for k in range(int(n.max(initial=0))):
            left = left[n[left] > k]
            hit = mix(met[begin[left] + k] + keys[left]) < limit
            out[left[hit]] = True
            left = left[~hit]
        return out

    def _keep(self, keys: np.ndarray, places: np.ndarray) -> None:
        """A table of words: sorted keys and their places in the pools. Tables of about equal size merge, so there are few."""
        while len(self.known) and len(keys) and 2 * len(keys) > len(self.known[-1][0]):
            other, at = self.known.pop()
            order = np.argsort(np.concatenate([keys, other]), kind="stable")
            keys, places = np.concatenate([keys, other])[order], np.concatenate([places, at], axis=1)[:, order]
        if len(keys):
            self.known.append((keys, places))

    def _plain(self, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray, merges: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words' pieces without dropout and where they start; if wanted, the merges taken (as they are added to a
        word's key) and where each word's start."""
        self.met = [] if merges else None
        made, made_at = self._segment(code, starts, lengths, np.zeros(len(starts), np.uint64), 0.0)
        met, self.met = self.met or [], None
        place = np.concatenate([np.zeros(0, np.int64), *(m[0] for m in met)])
        found = np.concatenate([np.zeros(0, np.uint64), *(m[1] for m in met)])
        order = np.argsort(place, kind="stable")
        before = np.concatenate([[0], np.cumsum(lengths)])
        return made, made_at, found[order], np.searchsorted(place[order], before)

    def _segment(self, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of some words of ``code`` and the n + 1 places where each word's start."""
        before = np.cumsum(lengths) - lengths
        code = code[np.arange(lengths.sum()) + np.repeat(starts - before, lengths)]
        sym = self.of_char[code].astype(np.int64)
        key = np.repeat(keys, lengths) + (np.arange(len(code)) - np.repeat(before, lengths)).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        limit = _limit(dropout)

        def name(where, mid, piece):
            """A candidate's number within its word, added to the word's key."""
            return key[where] + (mid - where).view(np.uint64) * np.uint64(0xA5A3564EDCE5B0B3) + piece.view(np.uint64)

        def taken(where, mid, piece):
            if self.met is not None:
                self.met.append((where, name(where, mid, piece)))

        def candidates(left, right, where, mid):
            """The agenda's order of each pair (rank, then place) and its piece; dropped pairs are never taken."""
            piece = self.merged(left, right)
            good = np.flatnonzero(piece >= 0)
            if dropout > 0:
                good = good[mix(name(where[good], mid[good], piece[good])) >= limit]
            order = np.full(len(piece), _NEVER)
            order[good] = self.rank[piece[good]] << 32 | where[good]
            return order, piece

        done = np.full(len(code), -2, np.int64)
        long = lengths > LONG
        for s, n in zip(before[long], lengths[long]):
            self._agenda(sym, int(s), int(n), int(key[s]), dropout, candidates, done)
        self._rounds(sym, before[~long], lengths[~long], candidates, taken, done)
        place = np.flatnonzero(done > -2)
        found = done[place]
        unknown = (found < 0) | (found >= self.size)
        counts = np.ones(len(place), np.int64)
        spelled = [("▁" if c == _OTHER else chr(c)).encode() for c in code[place[unknown]].tolist()]
        counts[unknown] = [len(x) for x in spelled]
        out = np.repeat(found, counts)
        out[np.repeat(unknown, counts)] = self.byte[np.frombuffer(b"".join(spelled), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return out.astype(np.int32), ends[np.searchsorted(place, np.concatenate([before, [len(code)]]))]

    @staticmethod
    def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points with a mark before each text that has any and for each space; where each text starts."""
        plain = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        filled = np.diff(before) > 0
        at = before + np.concatenate([[0], np.cumsum(filled)])
        code = np.full(len(plain) + int(filled.sum()), _MARK, np.int64)
        text = np.ones(len(code), bool)
        text[at[:-1][filled]] = False
        code[text] = np.where(plain == _MARK, _OTHER, np.where(plain == 32, _MARK, plain))
        return code, at

    def _rounds(self, sym, starts, lengths, candidates, taken, done) -> None:
        """Merge the top of every word's agenda, round by round, until no word has any.

        Symbols stand where their first characters do; after and prior link those that are left.
        """
        n = len(sym)
        after, prior = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = starts + lengths - 1
        after[ends], prior[starts] = -1, -1
        order, piece = np.full(n, _NEVER), np.full(n, -1, np.int64)
        place = np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        done[place] = sym[place]
        inner = place[after[place] >= 0]
        order[inner], piece[inner] = candidates(sym[inner], sym[inner + 1], inner, inner + 1)
        while len(starts):
            own = order[place]
            before = np.cumsum(lengths) - lengths
            while True:
                top = np.minimum.reduceat(own, before)
                live = top < _NEVER
                if 2 * live.sum() < len(live):
                    break
                word = np.flatnonzero(live)
                i = top[word] & 0xFFFFFFFF
                j = after[i]
                k, h = after[j], prior[i]
                taken(i, j, piece[i])
                done[i] = piece[i]
                done[j] = -2
                after[i] = k
                prior[k[k >= 0]] = i[k >= 0]
                shift = (before - starts)[word]
                own[i + shift] = _NEVER
                own[j + shift] = _NEVER
                one, two = h >= 0, k >= 0
                a, b = np.concatenate([h[one], i[two]]), np.concatenate([i[one], k[two]])
                new, piece[a] = candidates(done[a], done[b], a, b)
                own[a + np.concatenate([shift[one], shift[two]])] = new
            order[place] = own
            keep = np.repeat(live, lengths)
            place, starts, lengths = place[keep], starts[live], lengths[live]

    def _agenda(self, sym, start: int, n: int, key: int, dropout: float, candidates, done) -> None:
        """One word by a heap, in plain numbers."""
        place = np.arange(start, start + n)
        now, size, after, prior = sym[place].tolist(), [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        order, piece = candidates(sym[place[:-1]], sym[place[1:]], place[:-1], place[1:])
        heap = [(o & 0xFFFFFFFF00000000 | i, i, i + 1, p, 2) for i, (o, p) in enumerate(zip(order.tolist(), piece.tolist())) if o < _NEVER]
        heapq.heapify(heap)
        rank, limit = self.rank, int(_limit(dropout))
        while heap:
            _, i, j, p, both = heapq.heappop(heap)
            if not size[i] or not size[j] or size[i] + size[j] != both:
                continue  # one of its symbols has been merged since
            if self.met is not None:
                self.met.append((np.array([start + i]), np.array([_named(key, i, j, p)], np.uint64)))
            now[i], size[i], size[j], after[i] = p, both, 0, after[j]
            if after[i] < n:
                prior[after[i]] = i
            for a, b in ((prior[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    q = self.pairs.get(now[a] << 20 | now[b], -1)
                    if q >= 0 and (not limit or _mix(_named(key, a, b, q)) >= limit):
                        heapq.heappush(heap, (int(rank[q]) << 32 | a, a, b, q, size[a] + size[b]))
        for i in range(n):
            if size[i]:
                done[start + i] = now[i]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts. The mark before each text is left out."""
        first, size = self.raw_at[ids], self.raw_at[ids + 1] - self.raw_at[ids]
        heads = at[:-1][np.diff(at) > 0]
        marked = size[heads] > 0
        marked[marked] = self.raw[first[heads[marked]]] == 32
        first[heads[marked]] += 1
        size[heads[marked]] -= 1
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        return data, ends[at]


@lru_cache(2)
def _merger(model) -> Merger:
    return Merger(model)


def _frozen(path: str) -> tuple:
    return tuple(map(tuple, read_model(path)))


def encoder(spark: SparkSession, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT):
    """A function of (text column, id column) that gives the pieces' ids. The vocabulary, of a fixed size, is
    read here and broadcast; executors need no model file."""
    shared = spark.sparkContext.broadcast(_frozen(model))

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encode(text: pa.Array, doc_id: pa.Array) -> pa.Array:
        m = _merger(shared.value)
        data, offsets = utf8(text)
        ids = doc_id.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        out, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for i, j in pieces(offsets, 1 << 19):
            found, at = m.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j], seed, dropout)
            out.append(found)
            counts.append(np.diff(at))
        at = np.cumsum(np.concatenate(counts))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(out)))

    return encode


def decoder(spark: SparkSession, model: str = MODEL):
    """A function of an ids column that gives the texts."""
    shared = spark.sparkContext.broadcast(_frozen(model))

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        at = ids.offsets.to_numpy().astype(np.int64)
        values = ids.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
        at = at - at[0]
        parts, sizes = [], [np.zeros(1, np.int64)]
        for i, j in pieces(at, 1 << 18):
            data, ends = _merger(shared.value).decode(values[at[i] : at[j]], at[i : j + 1] - at[i])
            parts.append(data.tobytes())
            sizes.append(np.diff(ends))
        ends = np.cumsum(np.concatenate(sizes))
        return pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends), pa.py_buffer(b"".join(parts))).cast(pa.string())

    return decode


def encode_documents(docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT, epochs: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, ids, lossless (whether the ids decode to the text).

    A null or empty text has no pieces. The segmentation depends on seed, doc_id (null: as -1) and text alone, so
    repeated rows have equal ids; with ``epochs`` the rows of one doc_id are its epochs (one more column, from 0, longer
    texts first; of a null doc_id, rows of one text), each of which has merges skipped of its own. Texts of any length are
    encoded whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows, key = docs.select("doc_id", whole("text").alias("text")), F.col("doc_id")
    if epochs:
        same = W.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
        rows = rows.withColumn("epoch", F.row_number().over(same.orderBy(F.length("text").desc(), F.xxhash64("text"))) - 1)
        key = F.when(F.col("epoch") == 0, key).otherwise(F.xxhash64("doc_id", "epoch"))
    ids: Column = encoder(spark, model, seed, dropout)(F.col("text"), key)
    rows = rows.withColumn("ids", ids)
    back = decoder(spark, model)("ids")
    more = ["epoch"] if epochs else []
    return rows.select("doc_id", *more, F.octet_length("text").cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_tokens"), "ids", (back == F.col("text")).alias("lossless"))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
