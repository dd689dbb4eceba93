"""Source divergence audit: how far the words of a source are from those of its language and of each other source.

In-mapper stripes: a task folds whole documents into hash stripes, of a term its document frequency and its count by source, and
spills them once they hold CELLS counts. Spark deals the spilled stripes by (language, term), sorted, and they merge
as they stream by. Merged stripes meet the totals of their language's sources in groups of STRIPES terms; there they give
the sums of all pairs of sources and each source's RANKS strongest terms. Only these are summed and ranked at last.

Null text, lang and source count as ''. Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case, so empty and
blank texts have none. All numbers are whole. Rows that repeat a document count again, each with its terms. A source
without terms has rows of its own as any other. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.shared import documents, durable, text_batches, whole

#: A task spills its stripes at this many counts. Terms of a language that are worked on together, at most about. Bytes of a text read at a time.
CELLS, STRIPES, PIECE = 300_000, 4096, 1 << 20
#: Documents that a kept term is in, at least; ranks of terms that are reported.
LEAST, RANKS = 3, 200
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_SHAPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def terms(text: str):
    """Lists of a text's terms, in UTF-8, about PIECE bytes of text at a time."""
    data = text.encode().translate(_TERMS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _spilled(seen: dict, counts: dict):
    """Stripes of what a task has folded: seen has documents by language and term, counts occurrences by language, source and term."""
    for lang, df in seen.items():
        terms = list(df)
        place = dict(zip(terms, range(len(terms))))
        own = [(source, c) for (of, source), c in counts.items() if of == lang]
        row = np.fromiter((place[t] for _, c in own for t in c), np.int64)
        n = np.fromiter((x for _, c in own for x in c.values()), np.int64)
        source = np.repeat(np.arange(len(own)), [len(c) for _, c in own])
        order = np.argsort(row, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(terms)))])
        names, docs = pa.array([s for s, _ in own], pa.string()), np.fromiter(df.values(), np.int64)
        for i in range(0, len(terms), 10_000):
            j = min(i + 10_000, len(terms))
            some, ends = order[at[i] : at[j]], (at[i : j + 1] - at[i]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, x) for x in (names.take(pa.array(source[some])), pa.array(n[some]))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (j - i)), pa.array(terms[i:j], pa.binary()).cast(pa.string()), pa.array(docs[i:j]), *lists], schema=_SHAPE)


def _fold(batches, cells: int):
    seen: dict[str, Counter] = {}
    counts: dict[tuple[str, str], Counter] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            count, found = counts.setdefault((lang, source), Counter()), set()
            before = len(count)
            for some in terms(text):
                count.update(some)
                found.update(some)
            seen.setdefault(lang, Counter()).update(found)
            held += len(count) - before
            if held >= cells:
                yield from _spilled(seen, counts)
                seen, counts, held = {}, {}, 0
    yield from _spilled(seen, counts)


def _starts(table: pa.Table) -> np.ndarray:
    """Which of sorted stripes are the first of their (lang, term)."""
    out = np.ones(len(table), bool)
    if len(table) > 1:
        lang, term = (table[c].combine_chunks() for c in ("lang", "term"))
        out[1:] = pc.or_(*(pc.not_equal(c[1:], c[:-1]) for c in (lang, term))).to_numpy(zero_copy_only=False)
    return out


def _merged(table: pa.Table, least: int) -> pa.Table:
    """One stripe for each (lang, term) of sorted stripes; those in fewer documents than ``least`` go."""
    first = _starts(table)
    heads = np.flatnonzero(first)
    df = np.add.reduceat(table["df"].to_numpy(), heads)
    lists = table["sources"].combine_chunks()
    owner = np.repeat(np.cumsum(first) - 1, np.diff(lists.offsets.to_numpy()))
    names = lists.flatten().dictionary_encode()
    cell = owner * max(len(names.dictionary), 1) + names.indices.to_numpy()
    cells, place = np.unique(cell, return_inverse=True)
    n = np.zeros(len(cells), np.int64)
    np.add.at(n, place, table["counts"].combine_chunks().flatten().to_numpy())
    owner, source = np.divmod(cells, max(len(names.dictionary), 1))
    kept = df >= least
    inside = kept[owner]
    at = np.concatenate([[0], np.cumsum(np.bincount(owner[inside], minlength=len(heads))[kept])]).astype(np.int32)
    columns = [table["lang"].take(heads[kept]).combine_chunks(), table["term"].take(heads[kept]).combine_chunks(), pa.array(df[kept])]
    return pa.table([*columns, pa.ListArray.from_arrays(at, names.dictionary.take(pa.array(source[inside]))), pa.ListArray.from_arrays(at, pa.array(n[inside]))], schema=_SHAPE)


def _merge(batches, least: int, together: int = 20_000):
    """Stripes sorted by (lang, term) merge as they come, ``together`` at a time; what has the last term waits for the next."""
    waiting: list[pa.RecordBatch] = []

    def ready(end: bool):
        table = pa.Table.from_batches(waiting, _SHAPE)
        cut = len(table) if end else int(np.flatnonzero(_starts(table))[-1])
        # of the last term one stripe waits, however many there were
        return _merged(table.slice(0, cut), least).to_batches() if cut else [], [] if end else _merged(table.slice(cut), 0).to_batches()

    for batch in batches:
        if len(batch):
            waiting.append(batch.cast(_SHAPE))
        if sum(map(len, waiting)) >= together:
            done, waiting = ready(False)
            yield from done
    if waiting:
        yield from ready(True)[0]


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / total), exact in 64 bits: three decimal places of the quotient at a time."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, totals.shape), np.int64)
    whole_part, rest = np.divmod(rest, totals)
    out += whole_part
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digits
    return out + 1


_FOUND = "lang string, source string, part string, item string, value long"


def _diverge(key, totals: pa.Table, stripes: pa.Table) -> pa.Table:
    """Of some terms of a language: for each two of its sources the sum of divergences, of each source its RANKS strongest terms."""
    if not len(totals) or not len(stripes):
        return pa.table([pa.array([], pa.string())] * 4 + [pa.array([], pa.int64())], names=["lang", "source", "part", "item", "value"])
    lang, sources = totals["lang"][0].as_py(), totals["source"].to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    k, kinds = len(sources), totals["v"][0].as_py()
    n = np.array(totals["n"].to_pylist(), np.int64)
    words = np.array(stripes["term"].to_pylist(), object)
    lists = stripes["sources"].combine_chunks()
    count = np.zeros((len(words), k), np.int64)
    column = np.array([place[s] for s in lists.flatten().to_pylist()], np.int64)
    count[np.repeat(np.arange(len(words)), np.diff(lists.offsets.to_numpy())), column] = stripes["counts"].combine_chunks().flatten().to_numpy()
    p = shares(count, n[None] + kinds)
    q = shares(count.sum(axis=1), np.int64(n.sum()) + kinds)
    found: list[tuple] = []
    for a in range(k):
        f = (p[:, [a]] - p) ** 2 // p
        found += [(lang, sources[a], "pair", sources[b], x) for b, x in enumerate(f.sum(axis=0).tolist()) if b != a]
        own = np.flatnonzero((count[:, a] > 0) & (p[:, a] > q))
        value = (p[own, a] - q[own]) ** 2 // q[own]
        if len(own) > RANKS:
            least = np.partition(value, len(value) - RANKS)[len(value) - RANKS]
            own, value = own[value >= least], value[value >= least]
        best = sorted(zip((-value).tolist(), words[own].tolist()), key=lambda x: (x[0], x[1].encode()))[:RANKS]
        found += [(lang, sources[a], "term", t, -v) for v, t in best]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*found), [pa.string()] * 4 + [pa.int64()])] if found else [pa.array([], pa.string())] * 4 + [pa.array([], pa.int64())], names=["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, least: int = LEAST, cells: int = CELLS, together: int = STRIPES) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; see the module. A language whose terms are all rare has pairs of value 0."""
    text_batches(docs.sparkSession)
    read = docs.select(whole("lang").alias("lang"), whole("source").alias("source"), whole("text").alias("text"))
    stripes = read.mapInArrow(lambda b: _fold(b, cells), _STRIPE).repartition("lang", "term").sortWithinPartitions("lang", "term")
    stripes = durable(stripes.mapInArrow(lambda b: _merge(b, least), _STRIPE), "divergence-stripes")
    groups = durable(read.select("lang", "source").distinct(), "divergence-groups")
    tokens = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    kinds = stripes.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = durable(groups.join(tokens, ["lang", "source"], "left").join(kinds, "lang", "left").fillna(0), "divergence-totals")
    # a language's totals go to each group of its terms; no side is broadcast, and no group has more than about STRIPES terms
    parts = F.ceil(F.col("v") / together).cast("int")
    dealt = totals.where("v > 0").withColumn("g", F.explode(F.sequence(F.lit(0), parts - 1)))
    own = stripes.join(kinds, "lang").withColumn("g", F.pmod(F.xxhash64("term"), parts).cast("int"))
    found = dealt.groupBy("lang", "g").cogroup(own.groupBy("lang", "g")).applyInArrow(_diverge, _FOUND)
    others = groups.select("lang", F.col("source").alias("item"))
    # every pair of sources is reported, also in a language without terms
    nothing = groups.join(others, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = durable(found.unionByName(nothing), "divergence-found").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= RANKS))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(documents(spark, sf_dir))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
places AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::hugeint AS n FROM places GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*)::hugeint AS n FROM places JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::hugeint AS total FROM groups g LEFT JOIN counted c USING (lang, source) GROUP BY ALL),
langs AS (SELECT lang, sum(n)::hugeint AS total, count(*)::hugeint AS v FROM kept GROUP BY lang),
full_table AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.total + l.v) AS p,
   1 + (1000000000::hugeint * (k.n + 1)) // (l.total + l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM full_table a JOIN full_table b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::bigint AS value
   FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint FROM full_table WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM found) WHERE part = 'pair' OR rank <= 200
"""
