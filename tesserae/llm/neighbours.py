"""Embedding near-dedup by NN-descent: a graph of each vector's nearest ones, refined through neighbours of neighbours.

Equal unit vectors of a label are one node. Random hyperplanes cut each label into cells, cells are cut into chunks by
hash, and the best of a chunk begin a node's list. A round brings together all that list a node or that it lists (of the latter
a bounded choice by hash); of these the pairs with a new entry are compared, and each node's best enter its list. Rounds
end when few lists change. Lists full of near vectors are saturated: they get twice the length and more rounds, up to WIDEST.

Entries near the threshold are compared in double precision; those at LINK or more are links. Nodes that stay saturated have more
links than their list holds; those among them are counted exactly, whatever their number: two of one component within half the
angle of the threshold of its mean are linked for certain, only nodes beyond are compared with all others, in blocks, of which
nothing but counts comes back. An audit counts the links of AUDIT nodes against all rows; below RECALL the search goes on with more cells
and longer lists.

A vector that is null, zero or holds null or non-finite components, or whose label is null, links with nothing; so do vectors of different
length. Rows that repeat a row are vectors like others: they link. A null vec_id counts as larger than any other; alone, its component is
null. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.shared import durable
from tesserae.operators.graph import components

LINK = 0.93
#: Candidates are compared by 8-bit vectors; what is this near to LINK is compared again.
MARGIN = 0.02
#: Length of a list, and how far saturated ones grow; cells of about CELL nodes in TABLES tables; rounds, and the
#: share of new entries that ends them, if no list that is not saturated has gained a near vector.
K, WIDEST, CELL, TABLES, ROUNDS, CHANGED = 10, 20, 512, 5, 8, 0.01
#: Best candidates of a node from one meeting. Nodes of the audit, the recall to reach, attempts. Nodes of a block of exact comparisons.
BEST, AUDIT, RECALL, ATTEMPTS, CHUNK = 8, 512, 0.98, 3, 1024
_LAST = np.iinfo(np.int64).max
_EDGE = "node long, nbr long, sim float"


def _units(batches):
    """id, part (label and length; null if the vector links with nothing), digest, unit vector, and the same in 8 bits."""
    for batch in batches:
        part, digest, unit, code = [], [], [], []
        for label, vector in zip(batch.column("label").to_pylist(), batch.column("embedding")):
            x = None if label is None or not vector.is_valid or not len(vector) or vector.values.null_count else np.array(vector.values.to_numpy(), float)
            if x is None or not np.isfinite(x).all() or not x.any():
                part, digest, unit, code = [*part, None], [*digest, None], [*unit, None], [*code, None]
                continue
            x = x / np.abs(x).max()
            x = x / np.sqrt((x * x).sum()) + 0.0
            part.append(f"{label}|{len(x)}")
            digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            unit.append(x.tobytes())
            code.append(np.rint(x * (127 / np.abs(x).max())).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(part, pa.string()), *(pa.array(c, pa.binary()) for c in (digest, unit, code))], names=["id", "part", "digest", "unit", "code"])


def _codes(column) -> np.ndarray:
    """8-bit vectors of one length as unit vectors."""
    out = np.stack([np.frombuffer(c, np.int8) for c in column]).astype(np.float32)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _cells(batches, tables: int, first: int, size: int):
    """Each node's cell in some tables: the signs of as many seeded projections as the label's nodes (n) ask for."""
    planes: dict = {}
    for batch in batches:
        ns, codes = batch.column("n").to_numpy(), batch.column("code").to_pylist()
        nodes, turns, cells = [], [], []
        for node, n, code in zip(batch.column("node").to_pylist(), ns.tolist(), codes):
            x = np.frombuffer(code, np.int8).astype(np.float32)
            bits = max(0, math.ceil(math.log2(n / size))) if n > 2 * size else 0
            for t in range(first, first + tables):
                if (t, len(x), bits) not in planes:
                    planes[t, len(x), bits] = np.random.default_rng([t, len(x)]).standard_normal((len(x), bits)).astype(np.float32), 1 << np.arange(bits, dtype=np.int64)
                plane, weights = planes[t, len(x), bits]
                nodes.append(node)
                turns.append(t)
                cells.append(int(((x @ plane > 0) * weights).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(turns, pa.int32()), pa.array(cells, pa.int64())], names=["node", "turn", "cell"])


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> dict:
    return {"node": pa.array(a, pa.int64()), "nbr": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float32())}


def _within(table: pa.Table, k: int) -> pa.Table:
    """A chunk of a cell: each node's k best."""
    node, x = table["node"].to_numpy(), _codes(table["code"].to_pylist())
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    best = np.argsort(-sim, axis=1, kind="stable")[:, : min(k, len(node) - 1)]
    return pa.table(_edges(np.repeat(node, best.shape[1]), node[best.ravel()], np.take_along_axis(sim, best, axis=1).ravel()))


def _met(batches, best: int):
    """Those around a node (list of member, fresh, worst, code): pairs with a new entry that would better a list."""
    for batch in batches:
        found = []
        for around in batch.column("around").to_pylist():
            seen = {}
            for m in around:
                seen[m["member"]] = m if m["member"] not in seen or m["fresh"] else seen[m["member"]]
            if len(seen) < 2 or not any(m["fresh"] for m in seen.values()):
                continue
            members = list(seen.values())
            x = _codes([m["code"] for m in members])
            fresh, worst = np.array([m["fresh"] for m in members]), np.array([m["worst"] for m in members], np.float32)
            sim = x @ x.T
            sim[~(fresh[:, None] | fresh[None])] = -2
            np.fill_diagonal(sim, -2)
            sim[sim <= worst[:, None]] = -2
            if sim.shape[1] > best:
                sim[sim < -np.partition(-sim, best - 1, axis=1)[:, best - 1 : best]] = -2
            i, j = np.nonzero(sim > -2)
            ids = np.array([m["member"] for m in members], np.int64)
            found.append((ids[i], ids[j], sim[i, j]))
        if found:
            yield pa.RecordBatch.from_pydict(_edges(*(np.concatenate(c) for c in zip(*found))))


def _lists(candidates: DataFrame, name: str) -> DataFrame:
    """The k best of each node (columns node, nbr, sim, fresh, k); worst: what a further one has to better."""
    one = candidates.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("k").alias("k"))
    ranked = one.withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("sim"), "nbr"))).where("_r <= k").drop("_r")
    own = W.partitionBy("node")
    return durable(ranked.withColumn("worst", F.when(F.count(F.lit(1)).over(own) >= F.col("k"), F.min("sim").over(own)).otherwise(F.lit(-1.5).cast("float"))), name)


def _round(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One meeting at each node, of the nodes that it lists and a choice of those that list it."""
    back = graph.select(F.col("nbr").alias("center"), F.col("node").alias("member"), "fresh")
    chosen = back.withColumn("_r", F.row_number().over(W.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("member", "center")))).where(F.col("_r") <= k).drop("_r")
    around = graph.select(F.col("node").alias("center"), F.col("nbr").alias("member"), "fresh").unionByName(chosen)
    lists = graph.groupBy("node").agg(F.max("worst").alias("worst"), F.max("k").alias("k"))
    state = nodes.select("node", "code").join(lists, "node", "left").select(F.col("node").alias("member"), "code", F.coalesce("worst", F.lit(-1.5).cast("float")).alias("worst"))
    met = around.join(state, "member").groupBy("center").agg(F.collect_list(F.struct("member", "fresh", "worst", "code")).alias("around"))
    found = met.mapInArrow(lambda b: _met(b, BEST), _EDGE)
    new = found.join(lists.select("node", "k"), "node", "left").select("node", "nbr", "sim", F.lit(True).alias("fresh"), F.coalesce("k", F.lit(k)).alias("k"))
    return _lists(graph.select("node", "nbr", "sim", F.lit(False).alias("fresh"), "k").unionByName(new), "nn-lists")


def _descend(graph: DataFrame, nodes: DataFrame, k: int, n: int, rounds: int) -> DataFrame:
    for _ in range(rounds):
        graph = _round(graph, nodes, k)
        gains = F.count_if((F.col("sim") >= LINK - MARGIN) & (F.col("worst") < LINK - MARGIN))
        new = graph.where("fresh").agg(F.count(F.lit(1)).alias("n"), gains.alias("near")).first()
        if new["n"] <= CHANGED * n * k and not new["near"]:
            break
    return graph


def graph_of(nodes: DataFrame, n: int, k: int = K, tables: int = TABLES, first: int = 0, cell: int = CELL, widest: int = WIDEST) -> DataFrame:
    """Lists of nearest nodes: node, nbr, sim, fresh, k, worst."""
    sizes = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    placed = durable(nodes.join(sizes, "part").select("node", "n", "code").mapInArrow(lambda b: _cells(b, tables, first, cell), "node long, turn int, cell long").join(nodes.select("node", "part", "code"), "node"), "nn-cells")
    key = ["part", "turn", "cell"]
    # a cell with very many nodes is cut by hash; the rounds bring its chunks together
    chunks = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (2 * cell)).cast("int").alias("chunks"))
    dealt = placed.join(chunks, key).withColumn("chunk", F.pmod(F.xxhash64("node", "turn"), "chunks"))
    begun = dealt.groupBy(*key, "chunk").applyInArrow(lambda t: _within(t.select(["node", "code"]), k), _EDGE)
    graph = _descend(_lists(begun.select("*", F.lit(True).alias("fresh"), F.lit(k).alias("k")), "nn-begun"), nodes, k, n, ROUNDS)
    width = k
    while width < widest:
        full = (F.col("worst") >= LINK - MARGIN) & (F.col("k") == width)
        if graph.where(full).isEmpty():
            break
        width *= 2
        wider = graph.withColumns({"fresh": full, "k": F.when(full, width).otherwise(F.col("k")), "worst": F.when(full, F.lit(-1.5).cast("float")).otherwise(F.col("worst"))})
        graph = _descend(durable(wider, "nn-wider"), nodes, k, n, 2)
    return graph


def _exact(batches):
    for batch in batches:
        if len(batch):
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            keep = [bool((np.frombuffer(x, float) * np.frombuffer(y, float)).sum() >= LINK) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))


def _sums(batches):
    """A batch's sum of vectors by component."""
    for batch in batches:
        total: dict = {}
        for c, u in zip(batch.column("component").to_pylist(), batch.column("unit").to_pylist()):
            total[c] = total[c] + np.frombuffer(u, float) if c in total else np.frombuffer(u, float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["component", "unit"])


def _total(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(u, float) for u in table["unit"].to_pylist())
    return pa.table({"component": table["component"].slice(0, 1), "mean": pa.array([total.tobytes()], pa.binary())})


def _angled(batches):
    """node, component, copies, unit, core: whether it is within half the threshold's angle of its component's mean."""
    for batch in batches:
        core = []
        for u, m in zip(batch.column("unit").to_pylist(), batch.column("mean").to_pylist()):
            u, m = np.frombuffer(u, float), np.frombuffer(m, float)
            length = np.sqrt((m * m).sum())
            core.append(bool(length > 0 and np.arccos(np.clip((u * m).sum() / length, -1, 1)) <= math.acos(LINK) / 2 - 1e-7))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "component", "copies", "unit")), pa.array(core, pa.bool_())], names=["node", "component", "copies", "unit", "core"])


def _block(table: pa.Table) -> pa.Table:
    """Nodes beyond a component's core (outer) against some others: how many rows each is linked with."""
    node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
    outer, core = table["outer"].to_numpy(zero_copy_only=False), table["core"].to_numpy(zero_copy_only=False)
    x = np.stack([np.frombuffer(u, float) for u in table["unit"].to_pylist()])
    link = (x[outer] @ x[~outer].T >= LINK) & (node[outer][:, None] != node[~outer][None])
    there = node[~outer][core[~outer]]
    n = np.concatenate([link @ copies[~outer], (link.T @ copies[outer])[core[~outer]]])
    return pa.table({"node": pa.array(np.concatenate([node[outer], there]), pa.int64()), "n": pa.array(n, pa.int64())})


def _counted(full: DataFrame) -> DataFrame:
    """Links among saturated nodes (node, component, copies, unit) of one component, by rows: node, n."""
    # each task's sums by component; a component then has a row for each task
    partial = full.select("component", "unit").mapInArrow(_sums, "component long, unit binary")
    mean = partial.groupBy("component").applyInArrow(_total, "component long, mean binary")
    angled = durable(full.join(mean, "component").mapInArrow(_angled, "node long, component long, copies long, unit binary, core boolean"), "nn-angled")
    cores = angled.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("weight"), F.ceil(F.sum((~F.col("core")).cast("int")) / CHUNK).cast("int").alias("outers"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("alls"))
    inside = angled.where("core").join(cores, "component").select("node", (F.col("weight") - F.col("copies")).alias("n"))
    placed = angled.join(cores.where("outers > 0"), "component")
    own, every = F.pmod(F.xxhash64("node"), "outers").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "alls").cast("int")
    as_any = F.transform(F.sequence(F.lit(0), F.col("outers") - 1), lambda i: F.struct(i.alias("i"), every.alias("j"), F.lit(False).alias("outer")))
    as_outer = F.transform(F.sequence(F.lit(0), F.col("alls") - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("outer")))
    wide = placed.select("component", "node", "copies", "unit", "core", F.explode(F.when(F.col("core"), as_any).otherwise(F.concat(as_any, as_outer))).alias("at"))
    blocks = wide.select("component", "at.i", "at.j", "at.outer", "node", "copies", "unit", "core").groupBy("component", "i", "j").applyInArrow(_block, "node long, n long")
    return inside.unionByName(blocks).groupBy("node").agg(F.sum("n").alias("n"))


def _audit(batches, sample: dict):
    """How many rows the sample's nodes are linked with among these nodes."""
    for batch in batches:
        part, copies, node = (batch.column(c).to_pylist() for c in ("part", "copies", "node"))
        units = batch.column("unit").to_pylist()
        names, found = [], []
        for p in set(part) & set(sample):
            own = [i for i, x in enumerate(part) if x == p]
            ids, vectors = sample[p]
            link = vectors @ np.stack([np.frombuffer(units[i], float) for i in own]).T >= LINK
            link &= ids[:, None] != np.array([node[i] for i in own])[None]
            names.append(ids)
            found.append(link @ np.array([copies[i] for i in own], np.int64))
        if names:
            yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate(names), pa.int64()), "there": pa.array(np.concatenate(found), pa.int64())})


def recall(nodes: DataFrame, counts: DataFrame, audit: int = AUDIT) -> float:
    """The share of the links of ``audit`` nodes, chosen by hash, that counts (node, n: rows linked besides copies) has, by brute force over all rows."""
    rows = nodes.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(audit).select("node", "part", "unit").collect()
    sample = {p: (np.array([r["node"] for r in rows if r["part"] == p]), np.stack([np.frombuffer(r["unit"], float) for r in rows if r["part"] == p])) for p in {r["part"] for r in rows}}
    sent = nodes.sparkSession.sparkContext.broadcast(sample)
    there = nodes.select("node", "part", "copies", "unit").mapInArrow(lambda b: _audit(b, sent.value), "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    totals = there.join(counts, "node", "left").agg(F.sum("there").alias("there"), F.sum(F.least("there", F.coalesce("n", F.lit(0)))).alias("n")).first()
    sent.unpersist()
    return 1.0 if not totals["there"] else totals["n"] / totals["there"]


def links_of(graph: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a graph's near entries: node, n (rows linked, besides copies), and node, component."""
    near = graph.where(F.col("sim") >= LINK - MARGIN).select(F.least("node", "nbr").alias("x"), F.greatest("node", "nbr").alias("y")).distinct()
    units = lambda c, of: nodes.select(F.col("node").alias(c), F.col("unit").alias(of))
    links = durable(near.join(units("x", "a"), "x").join(units("y", "b"), "y").select("x", "y", "a", "b").mapInArrow(_exact, "x long, y long"), "nn-links")
    found = components(links.toDF("a", "b"))
    full = graph.groupBy("node").agg(F.max("worst").alias("worst")).where(F.col("worst") >= LINK - MARGIN).join(found, "node").join(nodes.select("node", "copies", "unit"), "node")
    full = durable(full.select("node", "component", "copies", "unit"), "nn-full")
    both = links.select(F.col("x").alias("node"), F.col("y").alias("other")).unionByName(links.select(F.col("y").alias("node"), F.col("x").alias("other")))
    marks = full.select(F.col("node").alias("other"), F.lit(True).alias("full_other"))
    own = both.join(marks, "other", "left").join(full.select("node", F.lit(True).alias("full_node")), "node", "left").where("full_other IS NULL OR full_node IS NULL")
    listed = own.join(nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("n"))
    return durable(listed.unionByName(_counted(full)).groupBy("node").agg(F.sum("n").alias("n")), "nn-counts"), found


def near_vectors(embeddings: DataFrame, k: int = K, cell: int = CELL, tables: int = TABLES, widest: int = WIDEST) -> DataFrame:
    """Per row (vec_id, embedding, label): vec_id, n_links, component_id, kept, and recall, the share of links that the audit found."""
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_LAST)).alias("id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    read = durable(rows.mapInArrow(_units, "id long, part string, digest binary, unit binary, code binary"), "nn-rows")
    grouped = read.where("part IS NOT NULL").groupBy("part", "digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"), F.first("code").alias("code"))
    nodes = durable(grouped.withColumn("node", F.monotonically_increasing_id()), "nn-nodes")
    n, graph, found, reached = nodes.count(), None, None, 0.0
    for attempt in range(ATTEMPTS):
        width = k << attempt
        more = graph_of(nodes, n, width, tables, attempt * tables, cell, max(widest, width))
        if graph is not None:
            more = _lists(more.drop("worst").unionByName(graph.drop("worst")), "nn-both")
        graph = more
        counts, found = links_of(graph, nodes)
        reached = recall(nodes, counts)
        if reached >= RECALL:
            break
    named = nodes.select("node", "part", "digest", "least", "copies").join(found, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # a component's nodes are told by (part, digest), so that the rows of a very common vector need no more than their node's row
    per_node = named.join(smallest, "component").select("part", "digest", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = read.select("id", "part", "digest").join(per_node, ["part", "digest"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.nullif("id", F.lit(_LAST)).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.nullif("component_id", F.lit(_LAST)).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"), F.lit(reached).alias("recall"))


def op11_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
