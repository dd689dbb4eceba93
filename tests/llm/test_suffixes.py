import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm.blocks import _BYTE_VALUE, mix, powers
from tesserae.llm.packing import unpack
from tesserae.llm.suffixes import _RUNS, GRAM, LENGTH, OPEN, SKETCH, Family, _send, remove_repeats, repeated, runs


def brute(rows):
    """Byte by byte, in the order of doc_id (null last)."""
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").encode()) for r in rows), key=lambda r: r[:2])
    seen, out, i = set(), [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][:2] == rows[i][:2]:
            j += 1
        fresh = set()
        for none, d, t in rows[i:j]:
            gone = bytearray(len(t))
            for p in range(len(t) - LENGTH + 1):
                s = t[p : p + LENGTH]
                if s in seen:
                    gone[p : p + LENGTH] = b"\1" * LENGTH
                fresh.add(s)
            runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
            out.append((None if none else d, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
        seen |= fresh
        i = j
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_edges(edge, nothing):
    got = remove_repeats(edge)
    assert rows_of(got) == brute(edge.collect())
    assert remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [1 << 17, 20, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed, hot):
    """With no gram taken apart, the frequent ones, or all."""
    r = random.Random(seed)
    passages = ["".join(r.choice("abcd é") for _ in range(r.randrange(30, 300))) for _ in range(12)]
    texts = ["".join(r.choice(passages)[r.randrange(20) :] + "".join(r.choice("abcdef ") for _ in range(r.randrange(60))) for _ in range(r.randrange(6))) for _ in range(80)]
    texts += ["ab" * 400, "ab" * 300, "z" * 49, "z" * 50, "z" * 51, "z" * 500]
    docs = spark.createDataFrame([(i * 3 % 101, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert rows_of(remove_repeats(docs, buckets=7, hot=hot)) == brute(docs.collect())


def test_levels_stay_logarithmic():
    family = Family(batch=4)
    for i in range(64):
        family.add(np.sort(np.array([f"{i:04d}{k}" for k in range(4)], "S5")))
    assert len(family.levels) <= 8 and sum(map(len, family.levels)) == 256
    assert family.scan(np.array([b"00100", b"99999"], "S5")).tolist() == [True, False]


def test_small_batches_find_the_same():
    text = np.frombuffer(("abcdefghij" * 12 + "0123456789" * 12).encode(), np.uint8)
    size = np.full(4, 60 - LENGTH + 1)
    ids = np.array([4, 2, 9, 2])
    flags = repeated(text, size, ids, batch=5)
    assert flags.tolist() == repeated(text, size, ids, batch=10_000).tolist() and flags.any()


def test_stretches_that_agree_in_32_bits_stay(spark):
    """Different stretches under one gram, of which 32 bits of the hash are equal."""
    r = np.random.default_rng(5)
    n = 200_000
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    # the gram of the smallest hash among many stands for the strings that it is in
    some = letters[r.integers(0, 26, 20_000)]
    up, down = powers(len(some) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[some] * up[: len(some)], dtype=np.uint64)])
    best = int(np.argmin(mix((total[GRAM:] - total[:-GRAM]) * down[: len(some) - GRAM + 1])))
    texts = letters[r.integers(0, 26, (n, LENGTH))]
    texts[:, :GRAM] = some[best : best + GRAM]
    found = runs(texts.ravel(), np.arange(n + 1) * LENGTH)
    key = np.stack([found[0], found[3] & np.uint64(0xFFFFFFFF)])
    order = np.lexsort(key)
    same = np.flatnonzero((key[:, order[1:]] == key[:, order[:-1]]).all(axis=0))
    assert len(same)
    pair = [texts[found[1][order[same[0] + k]] // LENGTH].tobytes().decode() for k in (0, 1)]
    assert pair[0] != pair[1]
    docs = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert [x["n_removed"] for x in remove_repeats(docs).collect()] == [0, 0]


def test_a_block_sends_one_of_equal_stretches():
    """Five hundred copies of a passage, each between other words, cost about as much as one."""
    passage = "a passage that many documents share, word for word, and that is longer than fifty bytes by far; "
    table = lambda n: pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([passage * 3] * n)], names=["id", "hash", "text"])

    class Task:
        partitionId = staticmethod(lambda: 0)

    def entries(n):
        rows = [r for r in _send([table(n)], 4, np.zeros(1 << SKETCH, bool))]
        return sum(len(unpack(r["data"][0].as_buffer(), _RUNS)[0]) for r in rows if r["kind"][0].as_py() == OPEN)

    with pytest.MonkeyPatch.context() as m:
        m.setattr("pyspark.TaskContext.get", lambda: Task)
        assert entries(500) == entries(1)


def test_hot_strings_are_dealt_one_by_one():
    data = np.frombuffer(b"abcdefghij" * 30, np.uint8)
    offsets = np.array([0, 300])
    plain, single = runs(data, offsets), runs(data, offsets, np.ones(1 << SKETCH, bool))
    assert plain[2].sum() == len(single[2]) == 251 and (single[2] == 1).all() and len(set(single[0].tolist())) == 10


def shuffled(spark):
    """Bytes that the session's stages have written for shuffles so far."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    none = gateway.jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_and_lone_grams_are_not_shuffled(spark):
    """Many blocks of one task. Half of the texts are new, each other one has 2,000 bytes of one that lies some blocks before."""
    r = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    new = [letters[x].tobytes().decode() for x in r.integers(0, 26, (1000, 36_000))]
    rows = [(2 * i, t) for i, t in enumerate(new)] + [(2 * i + 1, f"<{i}>{new[i][1000:3000]}<{i}>") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = shuffled(spark)
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in remove_repeats(docs, with_text=False).collect()}
    assert got == {d: (2000, 1) if d % 2 else (0, 0) for d, _ in rows}
    assert shuffled(spark) - before < 0.7 * sum(len(t) for _, t in rows)


def test_runs_end_with_their_texts(spark):
    """Texts of one block that go as a whole have a run each."""
    docs = spark.createDataFrame([(i, "a text that is there again and again, and long enough for it to go") for i in range(4)], "doc_id long, text string").coalesce(1)
    assert sorted((x["doc_id"], x["n_spans"], x["n_removed"] == x["n_bytes"]) for x in remove_repeats(docs).collect()) == [(0, 0, False), (1, 1, True), (2, 1, True), (3, 1, True)]


def test_copies_send_little(spark):
    """Whole texts that come three times, in blocks of their own, and the same with equal doc_ids, which take nothing from each other."""
    r = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    new = [letters[x].tobytes().decode() for x in r.integers(0, 26, (150, 36_000))]
    rows = [(i + 1000 * k, t) for k in (2, 0, 1) for i, t in enumerate(new)] + [(0, new[0]), (None, new[1]), (7000, new[2][:999]), (7000, new[2][:999])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = shuffled(spark)
    got = sorted((x["doc_id"] is None, x["doc_id"], x["n_removed"], x["n_spans"]) for x in remove_repeats(docs, with_text=False).collect())
    assert got == sorted((d is None, d, *((0, 0) if d is not None and d < 1000 else (len(t), 1))) for d, t in rows)
    assert shuffled(spark) - before < 0.3 * sum(len(t) for _, t in rows)
