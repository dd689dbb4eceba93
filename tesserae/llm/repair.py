"""Conversation structure repair: the cheapest edits that bring a conversation's roles into order, least first where several cost the same.

The roles that stay have to read ``(s?(ua)+)?``. A node is a place between rows and a state of that pattern: nothing yet, after the system
row, after a user, after an assistant. Arcs keep a row, give it the role that the state asks for, delete it, or insert
an empty row. A cost DP from the end finds what each node still costs; the arcs that keep to it are optimal. Nodes of optimal arcs are
ranked by the edits that follow them, one edit at first, then 2, 4, 8 and so on by the rank of the node that a doubled pointer
leads to. Each node takes its least arc by letter and by the rank of where it leads, and pointers that double read off the path.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length lies in several tasks. One that lies inside a task
is repaired there. Others go on as blocks of up to BLOCK rows: a block's DP is a 4 x 4 matrix of costs, matrices of a conversation
are chained from its end, blocks then find their paths from each state, and the states are chained from the
beginning. Equal rows of several blocks are found by a join of digests. The hash of a repaired conversation streams over its blocks.

A null role or text is one space; null turns come first, and a null conv_id is a conversation of its own. Rows of one turn come by role, then
by the MD5 of their text. Roles are told by their first letter, an empty one by none; those but s, u and a are kept by no state. Rows that
repeat a row are duplicates of it. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import durable, text_batches

#: Rows and characters of text of a block; rows and characters of conversations that are repaired together.
BLOCK, BLOCK_CHARS, ROWS, CHARS = 1024, 4 << 20, 1 << 14, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. Which state follows an insertion or a new role, and which a kept s, u, a or other role.
_NEXT = np.array([2, 2, 3, 2])
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_STOP = [0, 1 << 40, 1 << 40, 0]
_FAR = 1 << 40
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_ROLE = {2: "user", 3: "assistant"}


def initial(role: str) -> int:
    return "sua".find(role[:1]) % 4 if role else 3


def fault(text: str) -> int:
    """Blank, truncated, or 0."""
    stripped = text.strip(SPACE)
    return BLANK if not stripped else 0 if stripped[-1] in ".!?" else TRUNCATED


def to_go(code: np.ndarray, n: np.ndarray, end: np.ndarray, last: np.ndarray) -> np.ndarray:
    """What each node still costs: rows of conversations (initial + 4 fault, padded to the longest; n: their rows), what the states cost
    after a conversation's rows, and whether rows can be inserted there too."""
    many, longest = code.shape
    out = np.full((many, longest + 1, 4), _FAR, np.int64)
    for i in range(longest, -1, -1):
        at = end
        if i < longest:
            who, what, below = code[:, i] & 3, code[:, i] >> 2, out[:, i + 1]
            must = ((what == BLANK) | (what == DUPLICATE))[:, None]
            cut = (CUT * (what == TRUNCATED))[:, None]
            kept = _KEPT[:, who].T
            keep = np.where(must | (kept < 0), _FAR, np.take_along_axis(below, np.maximum(kept, 0), axis=1) + cut + KEEP)
            rerole = np.where(must, _FAR, below[:, _NEXT] + cut + REROLE)
            at = np.where((n == i)[:, None], end, np.minimum(np.minimum(keep, rerole), below + DELETE))
        for _ in range(3):
            at = np.where(((n > i) | (last & (n == i)))[:, None], np.minimum(at, at[:, _NEXT] + INSERT), at)
        out[:, i] = np.minimum(at, _FAR)
    return out


def least_paths(code: np.ndarray, n: np.ndarray, end: np.ndarray, last: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs from the states of the first node, and for each start state the letters (by the order of D, I, K, R; 0: none) and
    nodes (4 place + state) of the least path."""
    many, longest = code.shape
    cost = to_go(code, n, end, last)
    place, state = np.arange(longest + 1)[None, :, None], np.arange(4)[None, None]
    pad = np.concatenate([code, np.zeros((many, 1), code.dtype)], axis=1)
    who, what = (pad & 3)[:, :, None], (pad >> 2)[:, :, None]
    inside = place < n[:, None, None]
    free = inside & (what != BLANK) & (what != DUPLICATE)
    cut = CUT * (what == TRUNCATED)
    kept = _KEPT[state, who]
    onward = np.minimum(place + 1, longest) * 4
    stays = inside | (last[:, None, None] & (place == n[:, None, None]))
    flat, shape = cost.reshape(many, -1), cost.shape
    arcs = []
    for letter, allowed, head, price in ((1, inside, onward + state, DELETE), (2, stays, place * 4 + _NEXT[state], INSERT), (3, free & (kept >= 0), onward + np.maximum(kept, 0), KEEP + cut), (4, free, onward + _NEXT[state], REROLE + cut)):
        head = np.broadcast_to(head, shape).reshape(many, -1)
        best = np.broadcast_to(allowed, shape).reshape(many, -1) & (flat < _FAR) & (np.take_along_axis(flat, head, axis=1) + np.broadcast_to(price, shape).reshape(many, -1) == flat)
        arcs.append((letter, best, head))
    # where a conversation ends no arc is optimal, and the pointer stays
    rank, pointer = np.zeros(flat.shape, np.int64), np.broadcast_to(np.arange(flat.shape[1]), flat.shape)
    for letter, best, head in reversed(arcs):
        rank, pointer = np.where(best, letter, rank), np.where(best, head, pointer)
    levels = int(3 * (longest + 1)).bit_length()
    for _ in range(levels):
        _, names = np.unique(rank * (int(rank.max()) + 1) + np.take_along_axis(rank, pointer, axis=1), return_inverse=True)
        rank, pointer = names.reshape(flat.shape), np.take_along_axis(pointer, pointer, axis=1)
    order = int(rank.max()) + 1
    key, letters, jump = np.full(flat.shape, 5 * order), np.zeros(flat.shape, np.int64), np.broadcast_to(np.arange(flat.shape[1]), flat.shape)
    for letter, best, head in arcs:
        own = letter * order + np.take_along_axis(rank, head, axis=1)
        better = best & (own < key)
        key, letters, jump = np.where(better, own, key), np.where(better, letter, letters), np.where(better, head, jump)
    path = np.broadcast_to(starts, (many, len(starts)))[:, :, None]
    for _ in range(levels):
        path = np.concatenate([path, np.take_along_axis(jump, path.reshape(many, -1), axis=1).reshape(path.shape)], axis=2)
        jump = np.take_along_axis(jump, jump, axis=1)
    return cost[:, 0], np.take_along_axis(letters, path.reshape(many, -1), axis=1).reshape(path.shape), path


def padded(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(c) for c in codes], np.int64)
    out = np.zeros((len(codes), max(int(n.max(initial=0)), 1)), np.int64)
    for row, c in zip(out, codes):
        row[: len(c)] = c
    return out, n


def alike(lengths: list[int], most: int = ROWS) -> list[list[int]]:
    """Conversations by length, together while the longest is at most twice the shortest and they have few rows."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if out and lengths[i] <= 2 * lengths[out[-1][0]] + 2 and (len(out[-1]) + 1) * lengths[i] <= most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def edited(letters: np.ndarray, path: np.ndarray, roles: list[str], texts: list[str]):
    """The rows that stay, as ``role:text``."""
    for letter, at, to in zip(letters.tolist(), path.tolist(), [*path.tolist()[1:], 0]):
        if letter == 2:
            yield f"{_ROLE[to & 3]}:"
        elif letter > 2:
            yield f"{roles[at >> 2] if letter == 3 else _ROLE[to & 3]}:{texts[at >> 2]}"


_COLUMNS = {
    "name": pa.string(), "done": pa.bool_(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string(),
    "part": pa.int64(), "seq": pa.int64(), "codes": pa.binary(), "keys": pa.list_(pa.binary()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
    "least": pa.int64(), "most": pa.int64(), "turns": pa.int64(), "first": pa.int64(),
}
_SHAPE = pa.schema(list(_COLUMNS.items()))
_KINDS = {pa.string(): "string", pa.bool_(): "boolean", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.string()): "array<string>"}
_SCHEMA = ", ".join(f"{c} {_KINDS[t]}" for c, t in _COLUMNS.items())
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def illegal(initials: np.ndarray) -> int:
    """Neighbours that are not su, ua or au."""
    pair = 4 * initials[:-1] + initials[1:]
    return int((~np.isin(pair, [4 * 0 + 1, 4 * 1 + 2, 4 * 2 + 1])).sum())


class _Rows:
    """Rows of one conversation, or of a block of it."""

    def __init__(self, name: str):
        self.name, self.roles, self.texts, self.turns, self.codes, self.chars = name, [], [], [], [], 0
        self.seen: set = set()

    def add(self, turn, role: str, text: str) -> None:
        what = fault(text)
        if what != BLANK:
            if (role, text) in self.seen:
                what = DUPLICATE
            self.seen.add((role, text))
        for of, x in ((self.roles, role), (self.texts, text), (self.turns, turn), (self.codes, initial(role) + 4 * what)):
            of.append(x)
        self.chars += len(text)

    def facts(self) -> dict:
        turns = [t for t in self.turns if t is not None]
        codes = np.array(self.codes, np.int64)
        tally = {c: int((codes >> 2 == k).sum()) for c, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        return tally | {"illegal": illegal(codes & 3), "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": len(set(turns))}

    def block(self, part: int, seq: int) -> dict:
        keys = [None if c >> 2 == BLANK else hashlib.md5(f"{role}\0{text}".encode()).digest() for role, text, c in zip(self.roles, self.texts, self.codes)]
        return self.facts() | {"name": self.name, "done": False, "part": part, "seq": seq, "codes": bytes(self.codes), "keys": keys, "roles": self.roles, "texts": self.texts}


def gaps(least, most, turns: int) -> int:
    return 0 if least is None else most - least + 1 - turns


def _repaired(some: list[_Rows]):
    """Whole conversations."""
    out = []
    for chosen in alike([len(c.codes) for c in some]):
        code, n = padded([np.array(some[i].codes, np.int64) for i in chosen])
        cost, letters, path = least_paths(code, n, np.tile(_STOP, (len(chosen), 1)), np.ones(len(chosen), bool), np.zeros(1, np.int64))
        for row, i in enumerate(chosen):
            own, facts = some[i], some[i].facts()
            text = "\n".join(edited(letters[row, 0], path[row, 0], own.roles, own.texts))
            audit = _LETTERS[letters[row, 0]].tobytes().rstrip(b"\0").decode()
            facts |= {"gaps": gaps(facts["least"], facts["most"], facts["turns"]), "cost": int(cost[row, 0])}
            out.append(facts | {"name": own.name, "done": True, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()})
    return _batch(out)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _COLUMNS.items()], schema=_SHAPE)


def _scan(batches, block: int, chars: int):
    """Sorted rows: conversations inside the task, repaired; the task's first and last and those of several blocks, as blocks."""
    part, now, seq, ready, first = TaskContext.get().partitionId(), None, 0, [], True
    for batch in batches:
        for name, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("name", "turn", "role", "text"))):
            if now is not None and (name != now.name or len(now.codes) >= block or now.chars >= chars):
                if name != now.name and not first and seq == 0:
                    ready.append(now)
                else:
                    yield _batch([now.block(part, seq)])
                first, seq = first and name == now.name, seq + 1 if name == now.name else 0
                now = None
                if sum(len(c.codes) for c in ready) >= ROWS or sum(c.chars for c in ready) >= CHARS:
                    yield _repaired(ready)
                    ready = []
            now = now or _Rows(name)
            now.add(turn, role, text)
    if now is not None:
        yield _batch([now.block(part, seq)])
    if ready:
        yield _repaired(ready)


_KNOWN = "name string, part long, seq long, codes binary, matrix array<long>, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long"
_ENDS = "name string, part long, seq long, `end` array<long>, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _matrices(batches):
    """Blocks (with the places of rows that an earlier block has) and what it costs to lead each state through them to each."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            codes = np.frombuffer(r["codes"], np.uint8).astype(np.int64)
            repeated = np.array(r["repeats"] or [], np.int64)
            r["duplicate"] += int((codes[repeated] >> 2 != DUPLICATE).sum())
            r["truncated"] -= int((codes[repeated] >> 2 == TRUNCATED).sum())
            codes[repeated] = codes[repeated] & 3 | 4 * DUPLICATE
            unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
            code, n = padded([codes] * 4)
            r["codes"], r["matrix"] = codes.astype(np.uint8).tobytes(), to_go(code, n, unit, np.zeros(4, bool))[:, 0].T.ravel().tolist()
        names = [c.split()[0] for c in _KNOWN.split(", ")]
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in rows], schema=_arrow(_KNOWN))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0].strip("`"), kinds[c.split()[1]]) for c in schema.split(", ")])


def _ends(table: pa.Table) -> pa.Table:
    """A conversation's blocks (a row each): what its states cost after each block, and the conversation's counts."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    cost = np.array(_STOP, np.int64)
    for _ in range(3):
        cost = np.minimum(cost, cost[_NEXT] + INSERT)
    turns, before = 0, None
    for r in rows:
        turns += r["turns"] - (r["least"] is not None and r["least"] == before)
        before = r["most"] if r["most"] is not None else before
    known = [r for r in rows if r["least"] is not None]
    whole = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    whole["illegal"] += sum(illegal(np.array([a["codes"][-1] & 3, b["codes"][0] & 3])) for a, b in zip(rows, rows[1:]))
    whole["gaps"] = gaps(known[0]["least"], known[-1]["most"], turns) if known else 0
    out = []
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        out.append({"name": r["name"], "part": r["part"], "seq": r["seq"], "end": _STOP if i == len(rows) - 1 else cost.tolist(), "last": i == len(rows) - 1})
        cost = np.minimum((np.array(r["matrix"]).reshape(4, 4) + cost[None]).min(axis=1), _FAR)
    return pa.Table.from_pylist([r | whole | {"cost": int(cost[0])} for r in out], schema=_arrow(_ENDS))


def _traced(batches, told: bool):
    """Of each block the state that each state leads to; or, told, from its own state the letters and the rows that stay."""
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            code, n = padded([np.frombuffer(r["codes"], np.uint8).astype(np.int64)])
            starts = np.array([r["entry"]] if told else range(4), np.int64)
            _, letters, path = least_paths(code, n, np.array([r["end"]], np.int64), np.array([r["last"]]), starts)
            if told:
                stays = "\n".join(edited(letters[0, 0], path[0, 0], r["roles"], r["texts"])) if (letters[0, 0] > 1).any() else None
                out.append({"name": r["name"], "part": r["part"], "seq": r["seq"], "audit": _LETTERS[letters[0, 0]].tobytes().rstrip(b"\0").decode(), "stays": stays})
            else:
                out.append({"name": r["name"], "part": r["part"], "seq": r["seq"], "exits": (path[0, :, -1] & 3).tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("name", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), *([("audit", pa.string()), ("stays", pa.string())] if told else [("exits", pa.list_(pa.int32()))])]))


_ENTRIES = "name string, part long, seq long, entry int"


def _entries(table: pa.Table) -> pa.Table:
    state, out = 0, []
    for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"])):
        out.append({"name": r["name"], "part": r["part"], "seq": r["seq"], "entry": state})
        state = r["exits"][state]
    return pa.Table.from_pylist(out, schema=_arrow(_ENTRIES))


def _hashed(batches):
    """Sorted blocks: each conversation's audit and hash, as they stream by."""
    shape = pa.schema([("name", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, sums, audit, begun = None, None, [], False
    for batch in batches:
        for r in batch.to_pylist():
            if r["name"] != now:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([{"name": now, "audit": "".join(audit), "repaired_sha256": sums.hexdigest()}], schema=shape)
                now, sums, audit, begun = r["name"], hashlib.sha256(), [], False
            audit.append(r["audit"])
            if r["stays"] is not None:
                sums.update((("\n" if begun else "") + r["stays"]).encode())
                begun = True
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"name": now, "audit": "".join(audit), "repaired_sha256": sums.hexdigest()}], schema=shape)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32(``conv_id:turn``) % 20; see the contract in op13."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    read = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(how == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), how.alias("how"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return read.where("how <> 0").withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def repaired(rows: DataFrame, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text; no nulls in role and text): name (conv_id as text, null as ''), gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    text_batches(spark)
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    keys = rows.select(name.alias("name"), "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("_m"), F.monotonically_increasing_id().alias("_s"))
    order = [F.col("name"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_m")]
    # equal rows are as good as each other, so their number deals them out
    placed = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, F.col("_s")).sortWithinPartitions(*order)
    scanned = durable(placed.select("name", "turn", "role", "text").mapInArrow(lambda b: _scan(b, block, chars), _SCHEMA), "repair-scanned")
    own, at = ["name", "part", "seq"], F.struct("part", "seq")
    blocks = scanned.where("NOT done").drop("done")
    digests = blocks.select(*own, F.posexplode("keys").alias("place", "key")).where("key IS NOT NULL")
    firsts = digests.groupBy("name", "key").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at")).where("first_at <> last_at").select("name", "key", "first_at")
    repeats = digests.join(firsts, ["name", "key"]).where(at > F.col("first_at")).groupBy(*own).agg(F.collect_list("place").alias("repeats"))
    facts = blocks.select(*own, "codes", "blank", "duplicate", "truncated", "illegal", "least", "most", "turns")
    known = durable(facts.join(repeats, own, "left").mapInArrow(_matrices, _KNOWN), "repair-known")
    ends = durable(known.groupBy("name").applyInArrow(_ends, _ENDS), "repair-ends")
    led = known.select(*own, "codes").join(ends.select(*own, "end", "last"), own)
    entries = durable(led.mapInArrow(lambda b: _traced(b, False), "name string, part long, seq long, exits array<int>").groupBy("name").applyInArrow(_entries, _ENTRIES), "repair-entries")
    told = led.join(entries, own).join(blocks.select(*own, "roles", "texts"), own).mapInArrow(lambda b: _traced(b, True), "name string, part long, seq long, audit string, stays string")
    hashed = told.repartition("name").sortWithinPartitions(*own).mapInArrow(_hashed, "name string, audit string, repaired_sha256 string")
    counts = ends.where("last").select("name", *_COUNTS)
    columns = ["name", *_COUNTS, "audit", "repaired_sha256"]
    return scanned.where("done").select(*columns).unionByName(counts.join(hashed, "name").select(*columns))


def conversation_repair(rows: DataFrame, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """Per conv_id of the rows: what repaired() gives for them after damage; a conversation that lost all rows has zeros, an empty audit and the hash of nothing."""
    found = repaired(damaged(rows), block, chars)
    every = rows.select("conv_id").distinct().withColumn("name", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    empty = {**{c: F.coalesce(c, F.lit(0).cast("long")) for c in _COUNTS}, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    return every.join(found, "name", "left").withColumns(empty).drop("name")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return conversation_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
