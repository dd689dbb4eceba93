import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from tesserae.llm import repair as R

SPACE = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Least (cost, letters, rows that stay) over all edits, by recursion over whole strings. rows: (role, text, fault)."""

    @lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in STEP:
                    c, a, kept = best(i, STEP[state, role[0]], inserted + 1)
                    options.append((c + 3, "I" + a, ((role, ""), *kept)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, kept = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, kept))
            for new in {role, "user", "assistant"} if fault in ("", "truncated") else ():
                if (state, new[:1]) in STEP:
                    c, a, kept = best(i + 1, STEP[state, new[:1]], 0)
                    price = 3 * (fault == "truncated")
                    if new == role:
                        options.append((c + price, "K" + a, ((new, text), *kept)))
                    if new in ("user", "assistant"):
                        options.append((c + price + 3, "R" + a, ((new, text), *kept)))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if how == 1 else text.translate(str.maketrans("", "", ".!?")) if how == 2 else text
            kept += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            core = text.strip(SPACE)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit, stays = cheapest(tuple((r, x, f) for (_, r, x), f in zip(kept, faults)))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in stays).encode()).hexdigest(),
        )
    return out


def rows_of(df):
    rows = df.select("conv_id", *FIELDS).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def made(seed, convs, most):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(draw.randint(1, most)):
            turn = None if draw.random() < 0.1 else draw.randint(0, t) if draw.random() < 0.1 else t
            role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "s", "User"])
            text = draw.choice(["Yes.", "No!\n", "cut", " ", "", None, "é?", "a.b", "Why?  x", "long " * 40 + "."])
            rows.append((None if c == 3 else c, turn, role, text))
    return rows


@pytest.mark.parametrize("block,partitions", [(R.BLOCK, 4), (2, 4), (1, 7), (5, 1)])
def test_like_brute_force(spark, block, partitions):
    rows = made(block, 40, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = rows_of(R.conversation_repair(df, block))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)


def test_a_long_conversation_in_blocks(spark):
    rows = made(9, 1, 150) + [(5, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 40}.") for t in range(160)] + [(6, 1, "user", "Same.")] * 50
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(R.conversation_repair(df, 16)) == brute(rows)


def test_conversation_without_rows_and_other_columns(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(gone[0], 0, "user", "Hi.", 1, "x"), (None, None, None, None, None, None)], "conv_id long, turn long, role string, text string, audit long, name string")
    got = rows_of(R.conversation_repair(df))
    assert got[gone[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == brute([(gone[0], 0, "user", "Hi."), (None, None, None, None)])


def test_nothing(spark):
    assert R.conversation_repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
