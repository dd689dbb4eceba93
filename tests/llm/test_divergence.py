import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserae.llm import divergence as D


def brute(rows, least=3):
    """Rows of (lang, source, text), by the contract's words and Python's whole numbers."""
    rows = [[x or "" for x in r] for r in rows]
    found = [(lang, source, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in found}:
        df, by = Counter(), defaultdict(Counter)
        for _, source, words in (r for r in found if r[0] == lang):
            df.update(set(words))
            by[source].update(words)
        kept = [t for t in df if df[t] >= least]
        total = Counter({t: sum(c[t] for c in by.values()) for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q, p = share(total), {s: share(c) for s, c in by.items()}
        for s in by:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in by if o != s)
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if by[s][t] and p[s][t] > q[t])[:200]
            out += [(lang, s, part, i.decode(), -v, r + 1) for part, of in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(of)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("cells,together", [(D.CELLS, D.STRIPES), (40, 7)])
def test_edge_rows(spark, edge, cells, together):
    want = brute([(r.lang, r.source, r.text) for r in edge.collect()])
    assert rows_of(D.divergences(edge, cells=cells, together=together)) == want and len(want) > 10


def test_many_sources_spilled_and_hot(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(400)]
    rows = [("en" if i % 3 else "fr", f"s{i % 7 if i % 2 else 0}", " ".join(words[int(400 * rng.random() ** 3)] for _ in range(60)) + "." * (i % 4)) for i in range(300)]
    rows += [("xx", "only", "rare terms"), ("yy", "a", None), ("yy", "b", ""), (None, None, "A B a b A_B")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert rows_of(D.divergences(df, cells=200, together=50)) == brute(rows)


def test_nothing(spark, nothing):
    assert D.divergences(nothing).collect() == []


def test_shares_are_exact_beyond_floats():
    counts, totals = np.array([0, 7, 10**15 - 1, 123456789012345]), np.array([1, 3, 10**15, 987654321098765])
    assert D.shares(counts, totals).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts.tolist(), totals.tolist())]


def test_pieces_of_a_long_text_keep_its_terms(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 50)
    text = " ".join(f"Ab{'c' * (i % 70)}9é" for i in range(100))
    assert [t for some in D.terms(text) for t in some] == [w.lower().encode() for w in re.findall(r"[^\W\d_]+", text)]


def test_stripes_merge_across_batches():
    rows = [("en", t, 1, [s], [n]) for t in ("a", "b", "c") for s, n in (("x", 1), ("y", 2), ("x", 4))] + [("fr", "c", 5, ["x"], [1])]
    batch = D.pa.RecordBatch.from_arrays([D.pa.array(c, f.type) for c, f in zip(zip(*rows), D._SHAPE)], schema=D._SHAPE)
    for together in (1, 2, 4, 100):
        out = D.pa.Table.from_batches(D._merge((batch.slice(i, 2) for i in range(0, 10, 2)), 3, together)).to_pylist()
        got = [(r["lang"], r["term"], r["df"], dict(zip(r["sources"], r["counts"]))) for r in out]
        assert got == [("en", t, 3, {"x": 5, "y": 2}) for t in "abc"] + [("fr", "c", 5, {"x": 1})]
