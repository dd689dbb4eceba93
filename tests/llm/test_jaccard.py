import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import tesserae.llm.jaccard as jaccard
from tesserae.llm.jaccard import near_components, near_dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r["text"]) for r in rows]
    ids = [2**63 - 1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 2**63 - 1), ids[i])
    return sorted(((r["doc_id"], len(sets[i]), None if least[find(i)] == 2**63 - 1 else least[find(i)]) for i, r in enumerate(rows)), key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_edges(edge, nothing):
    assert rows_of(near_components(edge)) == brute(edge.collect())
    assert near_components(nothing).count() == 0 and near_dedup(nothing).count() == 0
    kept = near_dedup(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(10) == 1 and ids.count(1) == 1 and 2 not in ids and {5, 6, 7, 8} <= set(ids)


@pytest.mark.parametrize("longest", [24, 3])
@pytest.mark.parametrize("chunk", [2048, 2])
@pytest.mark.parametrize("light", [None, 40])
def test_same_as_brute_force(spark, monkeypatch, light, longest, chunk):
    """Chains and crowds of near copies, with long lists and either boundary."""
    r = random.Random(5)
    monkeypatch.setattr(jaccard, "LIST", longest)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "ROUNDS", 0 if chunk == 2 else 2)
    if light is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, counts: min(light, 40))
    texts = []
    for _ in range(6):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(6, 150))]
        for _ in range(r.randrange(3, 14)):
            words = list(base)
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = f"v{r.randrange(3000)}"
            texts.append(" ".join(words))
            if r.random() < 0.3:
                base = words
    texts += [f"common passage here that all of them share {i} {i + 1} {i + 2}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert rows_of(near_components(docs, 5)) == brute(docs.collect())


def test_a_crowd_of_near_copies(spark):
    """2,000 copies with a word or two of their own, others with a passage of theirs, and a row per set and round."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(2000):
        words = list(base)
        for k in r.sample(range(120), r.randrange(1, 3)):
            words[k] = f"own{i}x{k}"
        texts.append(" ".join(words))
    texts += [" ".join([*base[20:60], *(f"other{i}y{k}" for k in range(80))]) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in near_components(docs).collect()}
    assert all(got[i] == 0 for i in range(2000)) and all(got[i] == i for i in range(2000, 2300))


def form_letters(n, own):
    """Texts of 100 words, all but the middle ``own`` of them shared."""
    base = [f"w{k}" for k in range(100)]
    return [" ".join([*base[: 50 - own // 2], *(f"own{i}x{k}" for k in range(own)), *base[50 + own - own // 2 :]]) for i in range(n)]


def test_form_letters_that_hardly_link_give_few_rows(spark, monkeypatch):
    """300 sets of mutual similarity just under the threshold, and some just above: blocks give links only."""
    texts = form_letters(300, 11) + form_letters(320, 9)[300:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    given = []
    kept = jaccard.durable
    monkeypatch.setattr(jaccard, "durable", lambda df, name: given.append((name, out := kept(df, name))) or out)
    want = brute(docs.collect())
    assert rows_of(near_components(docs)) == want and len({c for _, _, c in want}) > 250
    more = [df.count() for name, df in given if name == "jaccard-more"]
    assert more[-1] < 50 and sum(more) < 3 * 3 * 320


def test_a_block_links_components_once(spark):
    sets = [np.unique(np.concatenate([np.arange(90), np.arange(1000 * i, 1000 * i + 10)])).astype(np.uint64) for i in range(1, 60)]
    n, bits = len(sets[0]), jaccard.np.packbits(np.zeros(1024, bool)).tobytes()
    rows = {"x": range(59), "n": [n] * 59, "place": [0] * 59, "role": [3] * 59, "component": range(59), "rest": [int(i < 30) for i in range(59)]}
    table = jaccard.pa.table({**{c: jaccard.pa.array(list(v)) for c, v in rows.items()}, "bits": jaccard.pa.array([bits] * 59, jaccard.pa.binary()), "shingles": jaccard.pa.array([s.tobytes() for s in sets], jaccard.pa.binary())})
    assert jaccard._busy(table.drop_columns(["shingles"])).equals(table.drop_columns(["bits", "shingles"]))
    links = jaccard._across(table)
    assert len(links) == 58  # as many as a tree over all 59 sets


def test_one_round_makes_few_rows_per_set(spark):
    lists = spark.range(40_000).selectExpr("cast(id % 50 as int) AS bucket", "id % 50 AS list", "id div 50 AS x", "100 AS n", "0 AS place", "1 AS role")
    assert jaccard._stars(lists.withColumn("component", F.col("x")), 0).count() < 3 * 800


def test_counts_of_shared_values_that_begin_alike():
    r = np.random.default_rng(1)
    runs = [[np.unique(r.integers(0, 40, r.integers(0, 30)).astype(np.uint64)) for _ in range(50)] for _ in range(2)]
    (a, b), at = [np.concatenate(x) for x in runs], [np.concatenate([[0], np.cumsum([len(v) for v in x])]) for x in runs]
    assert jaccard.shared_counts(a, at[0], b, at[1]).tolist() == [len(np.intersect1d(x, y)) for x, y in zip(*runs)]


def test_sets_that_share_many_lists_are_compared_in_one():
    """Three near sets in five lists, the last two of which do not compare one of the pairs: before, all came whole in every list."""
    names, n = [11, 22, 33], 40
    place = {k: {x: k for x in names} for k in range(5)}
    place[1][33] = 39  # 33 shares too little after that place
    entry = {(k, x): {"bucket": 3, "list": k, "i": 0, "j": 0, "x": x, "n": n, "place": place[k][x], "role": 3, "component": x, "rest": r, "bits": bytes(128)} for k in range(5) for x in names for r in (0, 1)}
    seen = {x: sorted(({"place": place[k][x], "at": 3 << 33 | k, "role": 3} for k in range(5)), key=lambda s: (s["place"], s["at"])) for x in names}
    schema = jaccard.pa.schema([(c, t) for c, t in zip(jaccard._ENTRY.replace(" int", "").replace(" long", "").split(", "), [jaccard.pa.int32(), jaccard.pa.int64(), *[jaccard.pa.int32()] * 2, jaccard.pa.int64(), *[jaccard.pa.int32()] * 3, jaccard.pa.int64(), jaccard.pa.int32()])])
    seen_type = jaccard.pa.list_(jaccard.pa.struct([("place", jaccard.pa.int32()), ("at", jaccard.pa.int64()), ("role", jaccard.pa.int32())]))
    schema = schema.append(jaccard.pa.field("bits", jaccard.pa.binary())).append(jaccard.pa.field("seen", seen_type))

    def kept(of, lists):
        rows = [entry[k, x] | {"rest": r, "seen": of[x]} for k in lists for x in names for r in (0, 1)]
        return jaccard._owned(jaccard.pa.Table.from_pylist(rows, schema=schema))

    assert [sorted(set(kept(seen, [k])["x"].to_pylist())) for k in range(5)] == [names, [], [], [], []]
    # a list before that does not compare a pair does not take it away
    later = {x: s[1:] for x, s in seen.items()}
    assert [sorted(set(kept(later, [k])["x"].to_pylist())) for k in range(1, 5)] == [[11, 22], names, [], []]


def test_texts_are_not_shuffled_to_find_the_sets_that_are_compared(spark, monkeypatch):
    """Before, all texts went through a join by their hashes."""
    made = []
    kept = jaccard.bucketed
    monkeypatch.setattr(jaccard, "bucketed", lambda df, key, name: made.append((df._jdf.queryExecution().executedPlan().toString(), df.count(), df.first())) or kept(df, key, name))
    texts = form_letters(40, 4) + [" ".join(f"alone{i}x{k}" for k in range(200)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert rows_of(near_components(docs)) == brute(docs.collect())
    [(plan, sets, one)] = made
    assert "Join" not in plan and 40 <= sets < 60
    assert len(one["few"]) == 32 and len(one["bits"]) == 128


def test_a_digest_holds_its_keys_and_few_others():
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    mine, others, width = keys[:10_000], keys[10_000:], 1 << 12
    digest = np.zeros((jaccard.PARTS, width // 8), np.uint8)
    for part in range(jaccard.PARTS):
        own = mine[mine % jaccard.PARTS == part]
        table = jaccard.pa.table({"part": jaccard.pa.array([part] * len(own), jaccard.pa.int32()), "key": own})
        digest[part] = np.frombuffer(jaccard._digest(table, width)["bits"][0].as_py(), np.uint8)
    assert jaccard._held(mine, digest).all() and jaccard._held(others, digest).mean() < 0.01
    assert not jaccard._held(mine, np.zeros_like(digest)).any()


def test_entries_name_their_set_once_in_a_bucket():
    """Nine bytes an entry and sixteen a set; before, thirteen an entry, of which hardly any was the same as its neighbours."""
    texts = [" ".join(f"w{i}x{k}" for k in range(20 + 40 * i)) for i in range(30)]
    batch = jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(texts)], names=["text"])
    rank = np.zeros(1 << 18, np.uint8)
    got = [r for b in jaccard._send(iter([batch]), 4, 30, rank) for r in b.to_pylist()]
    parts = [jaccard.unpack(r["data"], jaccard._LISTED) for r in got]
    key, name = [np.concatenate([p[c] for p in parts]) for c in (0, 3)]
    assert sorted(r["bucket"] for r in got) == [0, 1, 2, 3] and len(set(name.tolist())) == 30
    assert sum(len(r["data"]) for r in got) <= 9 * len(key) + 16 * len(name) + 48 * len(got)
    for p in parts:
        many, n = (jaccard.from_bytes(p[c], np.uint32) for c in (5, 4))
        assert many.sum() == len(p[0]) == len(p[2]) and len(n) == len(p[3]) and (many > 0).all()
        assert len(set(p[3].tolist())) == len(n) and set(n.tolist()) <= {16 + 40 * i for i in range(30)}
        assert (jaccard.from_bytes(p[1], np.uint32) < np.repeat(n, many)).all()
