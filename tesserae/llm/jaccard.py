"""N-gram Jaccard join: size-aware, heavy and light sets apart.

Two sets of word shingles link when 7 |A n B| >= 3 (|A| + |B|), a similarity of 0.75 or more. All sets are in one
global order, rare shingles first (by a table of counts over the whole corpus), so two sets that link share a
shingle early in that order: within the first n - ceil(6n/7) + 1 of the smaller, and n - ceil(3n/4) + 1 of the
larger. Heavy sets put these into inverted lists and scan the lists. Light sets instead enumerate all pairs
of their first n - ceil(3n/4) + 2 shingles: linked sets share a pair, and far fewer others do. The
boundary is the size at which enumerating starts to cost more than scanning. Shingles are 64-bit hashes of their words,
candidates are verified on whole sets of these, and equal sets, told by a 64-bit hash of the set, are one node from the start.

Lists of up to LIST sets give all their pairs. Longer lists are worked on by rounds: each set chooses a few of its long lists
and is compared with one pivot in each, so a round makes a few rows per set, however long the lists are and however many a set is
in. Linked sets fall into one component, and only lists with several components go on. After the last round the sets of a list
that are not in its largest component are compared with all others of other components, block by block: whole sets, of which a block gives
one link at most for two components. That loses nothing, since a component is what is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.blocks import LOWER, mix, pieces, shingle_hashes, word_hashes, words
from tesserae.llm.packing import by_byte, from_bytes, pack, text_blocks, unpack
from tesserae.llm.shared import bucketed, documents, durable, fresh, text_batches, whole
from tesserae.operators.graph import components

WIDTH = 5
#: The table of counts has four counters or more for each row, 2**18 at least and 2**22 at most: a shingle
#: that comes more often than a counter's mean is told apart, and only those make long lists.
SKETCH = 18, 22
#: The digest of the documents whose sets are compared has DIGEST bits or more for each row, 2**27 at most, in PARTS parts; a row
#: sets HASHES of them. It lets a few others through, whose sets are made and not asked for.
DIGEST, PARTS, HASHES = (16, 27), 64, 4
#: Lists of up to LIST sets are compared in full. In each of ROUNDS a set meets the pivots of PIVOTS of its lists. What is
#: left of lists is compared in blocks of CHUNK sets, or HELD shingles, on each side. A bucket of lists is made for each SHARE shingles at least.
LIST, PIVOTS, ROUNDS, CHUNK, HELD, SHARE = 24, 3, 2, 2048, 2 << 20, 4 << 20
#: A set brings that many of its lists along, so that two sets are compared whole in one of those they share.
SEEN = 64
PIECE, BLOCK, BITS, FEW = 1 << 18, 2 << 20, 1024, 256
_LAST = np.iinfo(np.int64).max


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text, sorted, and where each text's begin."""
    low = LOWER[data]
    starts, ends, before = words(low, offsets)
    hashes, at = shingle_hashes(word_hashes(low, starts, ends), before, WIDTH)
    _sort_each(hashes, at)
    once = np.ones(len(hashes), bool)
    once[1:] = hashes[1:] != hashes[:-1]
    once[at[:-1][np.diff(at) > 0]] = True
    return hashes[once], np.concatenate([[0], np.cumsum(once)])[at]


def _sort_each(values: np.ndarray, at: np.ndarray) -> None:
    """Sort each run in place. A call per text is far cheaper than one sort that keeps the texts apart."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()


def _pieces(data, offsets):
    """Sets of up to PIECE bytes and 2**12 texts at a time."""
    for i, j in pieces(offsets, PIECE):
        for a in range(i, j, 1 << 12):
            b = min(a + (1 << 12), j)
            yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's size, and its name: a 64-bit hash of all its shingles."""
    spread = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(spread, dtype=np.uint64)])
    n = np.diff(at)
    return n, mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _survey(batches, bits: int):
    """Each document's set size and name; and this task's counts of shingles by the lower bits of their hashes."""
    names = ["id", "hash", "n", "name", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    counts = np.zeros(1 << bits, np.uint32)
    for rows, data, offsets in text_blocks(batches, "text", BLOCK, 1 << 20):
        sizes, keys = [], []
        for _, _, h, at in _pieces(data, offsets):
            n, key = _set_keys(h, at)
            sizes.append(n)
            keys.append(key)
            np.add.at(counts, (h & np.uint64((1 << bits) - 1)).view(np.int64), 1)
        m = rows.num_rows
        yield pa.RecordBatch.from_arrays([rows["id"].combine_chunks(), rows["hash"].combine_chunks(), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(keys)), pa.nulls(m, kinds[4]), pa.nulls(m, kinds[5])], names=names)
    parts = [by_byte(x).tobytes() for x in counts.reshape(PARTS, -1)] if counts.any() else []
    m = len(parts)
    yield pa.RecordBatch.from_arrays([*(pa.nulls(m, k) for k in kinds[:4]), pa.array(range(m), kinds[4]), pa.array(parts, kinds[5])], names=names)


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(len(table["counts"][0].as_buffer()) // 4, np.int64)
    for x in table["counts"]:
        total += from_bytes(np.frombuffer(x.as_buffer(), np.uint8), np.uint32)
    return pa.table([table["part"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def boundary(sizes: dict[int, int], counts: np.ndarray) -> int:
    """The size up to which sets enumerate pairs: while the pairs of one set cost less than scanning its lists.

    Lists hold rare shingles, whose counters are below twice the mean. If each shingle there came m times, those
    counters' variance would be m times their mean, so the quotient is the mean length of a list.
    sizes: sets by size class.
    """
    rare = counts[counts < 2 * max(counts.mean(), 1)].astype(float)
    length = max(rare.var() / max(rare.mean(), 1e-9), 1.0) if len(rare) else 1.0
    out = 0
    for n in sorted(sizes):
        prefix = n - -(-3 * n // 4) + 1
        if (prefix + 1) * prefix / 2 > prefix * (1 + length):
            break
        out = n
    return out


#: Of entries, those of a set together: keys, places and roles; of sets: names, sizes and how many entries. Places, sizes and numbers by byte.
_LISTED = [np.uint32, np.uint8, np.uint8, np.int64, np.uint8, np.uint8]
#: What an entry may be: found by a larger set, looking for smaller ones, a pair of shingles.
INDEX, PROBE, SUBSET = 1, 2, 4


def _entries(h: np.ndarray, at: np.ndarray, light: int, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys, set, place in the order, and role of all entries of some sets."""
    order = rank[(h & np.uint64(len(rank) - 1)).view(np.int64)].astype(np.uint64) << np.uint64(60) | h >> np.uint64(4)
    _sort_each(order, at)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - at[:-1][owner]
    size = n[owner]
    heavy = size > light
    index = (place < size - -(-6 * size // 7) + 1) & (heavy | (4 * size > 3 * light))
    probe = (place < size - -(-3 * size // 4) + 1) & heavy
    used = np.flatnonzero(index | probe)
    keys, sets, places, roles = [mix(order[used] + np.uint64(1))], [owner[used]], [place[used]], [(index * INDEX + probe * PROBE)[used]]
    first = np.flatnonzero((n <= light) & (n > 1))
    reach = n[first] - -(-3 * n[first] // 4) + 2
    for i in range(int(reach.max(initial=0))):
        for j in range(i + 1, int(reach.max())):
            some = first[reach > j]
            keys.append(mix(order[at[some] + i] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(order[at[some] + j])))
            sets.append(some)
            places.append(np.full(len(some), i))
            roles.append(np.full(len(some), SUBSET))
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(places), np.concatenate(roles).astype(np.uint8)


def _send(batches, buckets: int, light: int, rank: np.ndarray):
    for _, data, offsets in text_blocks(batches, "text", BLOCK, 1 << 20):
        found, seen = [], np.zeros(0, np.int64)
        for _, _, h, at in _pieces(data, offsets):
            n, name = _set_keys(h, at)
            _, one = np.unique(name, return_index=True)
            one = one[(n[one] > 1) & ~np.isin(name[one], seen)]  # equal sets of a block go once; single shingles link with equal sets only
            seen = np.union1d(seen, name[one])
            keep = np.zeros(len(n), bool)
            keep[one] = True
            key, owner, place, role = _entries(h[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])]), light, rank)
            found.append((key, name[keep][owner], n[keep][owner], place, role))
        if not found:
            continue
        key, name, n, place, role = (np.concatenate([f[c] for f in found]) for c in range(5))
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        own = np.unique(name, return_inverse=True)[1]
        order = np.argsort(bucket << 32 | own, kind="stable")
        bucket, own, key, name, n, place, role = (v[order] for v in (bucket, own, key, name, n, place, role))
        head = np.flatnonzero(np.concatenate([[len(own) > 0], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])]))
        many = np.diff(np.concatenate([head, [len(own)]]))
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        heads = np.searchsorted(head, cuts)
        for b in np.flatnonzero(np.diff(cuts)):
            c, d = slice(cuts[b], cuts[b + 1]), slice(heads[b], heads[b + 1])
            payload = pack([key[c].astype(np.uint32), by_byte(place[c].astype(np.uint32)), role[c], name[head[d]], by_byte(n[head[d]].astype(np.uint32)), by_byte(many[d].astype(np.uint32))])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "data"])


def _possible(n, m, i, j, r, s):
    """Whether sets of n <= m shingles that first share these entries can link."""
    fits = (4 * n >= 3 * m) & (7 * np.minimum(n - i, m - j) >= 3 * (n + m))
    return fits & (((r & INDEX > 0) & (s & PROBE > 0)) | (r & s & SUBSET > 0))


_PAIRS = "bucket int, list long, x long, y long, n int, place int, role int"


def _lists(table: pa.Table, longest: int) -> pa.Table:
    """One bucket: candidate pairs (list null), and the entries of long lists (y null)."""
    parts = [unpack(x.as_buffer(), _LISTED) for x in table["data"]]
    key, role, name = (np.concatenate([p[c] for p in parts]) for c in (0, 2, 3))
    place, n, many = (np.concatenate([from_bytes(p[c], np.uint32) for p in parts]) for c in (1, 4, 5))
    name, n = np.repeat(name, many), np.repeat(n, many)
    key = key.astype(np.int64) << 1 | (role == SUBSET)
    order = np.lexsort((name, n, key))
    key, name, n, place, role = key[order], name[order], n[order].astype(np.int64), place[order].astype(np.int64), role[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name, n, place, role = key[once], name[once], n[once], place[once], role[once]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.concatenate([head, [len(key)]]))
    long = np.repeat(length > longest, length)
    xs, ys = [], []
    short = np.flatnonzero(np.repeat((length > 1) & (length <= longest), length))
    k2, v2, n2, p2, r2 = key[short], name[short], n[short], place[short], role[short]
    for d in range(1, longest):
        if len(k2) <= d:
            break
        i = np.flatnonzero(k2[d:] == k2[:-d])
        if not len(i):
            break
        i = i[_possible(n2[i], n2[i + d], p2[i], p2[i + d], r2[i], r2[i + d])]
        xs.append(np.minimum(v2[i], v2[i + d]))
        ys.append(np.maximum(v2[i], v2[i + d]))
    pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *xs]), np.concatenate([np.zeros(0, np.int64), *ys])]), axis=1)
    m, bucket, many = pairs.shape[1], table["bucket"][0].as_py(), int(long.sum())
    cols = [
        pa.array([bucket] * (m + many), pa.int32()),
        pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(key[long])]),
        pa.array(np.concatenate([pairs[0], name[long]])),
        pa.concat_arrays([pa.array(pairs[1]), pa.nulls(many, pa.int64())]),
        *(pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array(x[long].astype(np.int32))]) for x in (n, place, role)),
    ]
    return pa.table(cols, names=["bucket", "list", "x", "y", "n", "place", "role"])


def folded(rows: np.ndarray, to: int) -> np.ndarray:
    """Parities of ``to`` bytes of classes, from those of a power of two times as many."""
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, to // 8), axis=1)


def _planes(bits: list) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Bytes of each of some parities; for each number of bytes those that have it; and each one's row there."""
    size = np.array([len(b) for b in bits], np.int64)
    planes, row = {}, np.zeros(len(size), np.int64)
    for w in np.unique(size).tolist():
        own = np.flatnonzero(size == w)
        planes[w] = np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(-1, w // 8)
        row[own] = np.arange(len(own))
    return size, planes, row


def _differ(x: tuple, y: tuple) -> np.ndarray:
    """In how many classes pairs of sets have another parity; of each set its planes, bytes and row. The parities of a set's
    shingles are kept for BITS classes or more, at least twice as many as it has shingles. Classes in which two sets
    differ are shingles that one of them lacks, so pairs that differ in more than a seventh of their shingles cannot link."""
    (a, size_a, row_a), (b, size_b, row_b) = x, y
    out = np.zeros(len(size_a), np.int64)
    for v, w in set(zip(size_a.tolist(), size_b.tolist())):
        own, to = np.flatnonzero((size_a == v) & (size_b == w)), min(v, w)
        out[own] = np.bitwise_count(folded(a[v][row_a[own]], to) ^ folded(b[w][row_b[own]], to)).sum(axis=1, dtype=np.int64)
    return out


_ENTRY = "bucket int, list long, i int, j int, x long, n int, place int, role int, component long, rest int"


def _meetings(table: pa.Table, comp: np.ndarray):
    """The sets of one block of a long list (columns of _ENTRY, bits), by size: each of the rest, and those of the others that are not in its
    component (comp, which may change meanwhile) and that their parities do not rule out."""
    n, place, role, rest = (table[c].to_numpy().astype(np.int64) for c in ("n", "place", "role", "rest"))
    size, planes, row = _planes([x.as_buffer() for x in table["bits"]])
    for i in np.flatnonzero(rest):
        j = np.arange(np.searchsorted(n, -(-3 * n[i] // 4)), np.searchsorted(n, 4 * n[i] // 3, "right"))
        j = j[(comp[j] != comp[i]) & (rest[j] == 0)]
        a, b = np.minimum(i, j), np.maximum(i, j)
        j = j[_possible(n[a], n[b], place[a], place[b], role[a], role[b])]
        own = np.full(len(j), i)
        j = j[7 * _differ((planes, size[own], row[own]), (planes, size[j], row[j])) <= n[j] + n[i]]
        if len(j):
            yield i, j


def _busy(table: pa.Table) -> pa.Table:
    """The entries of a block that have to be compared whole with others of it."""
    table = table.sort_by("n")
    busy = np.zeros(len(table), bool)
    for i, j in _meetings(table, table["component"].to_numpy()):
        busy[i] = busy[j] = True
    return table.drop_columns(["bits"]).filter(pa.array(busy))


def _owned(table: pa.Table) -> pa.Table:
    """The entries of a block (columns of _ENTRY, bits, seen) without those whose meetings all come in other lists too. Sets that are near share many
    lists; two of them are compared in the first list, by its place in the set with the smaller name, of those that compare them. seen: a
    set's first SEEN lists, so a set that is in more may be compared more than once."""
    table = table.sort_by("n")
    name, n, place = (table[c].to_numpy().astype(np.int64) for c in ("x", "n", "place"))
    here = table["bucket"][0].as_py() << 33 | table["list"][0].as_py()
    seen = table["seen"].combine_chunks()
    at = np.concatenate([[0], np.cumsum(seen.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    rows = seen.flatten()
    places, lists, roles = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "at", "role"))
    keep = np.zeros(len(table), bool)
    for i, j in _meetings(table, table["component"].to_numpy()):
        mine = at[i] + np.argsort(lists[at[i] : at[i + 1]])
        theirs = np.concatenate([np.arange(at[k], at[k + 1]) for k in j])
        other = np.repeat(j, at[j + 1] - at[j])
        own = mine[np.minimum(np.searchsorted(lists[mine], lists[theirs]), len(mine) - 1)]
        met = lists[own] == lists[theirs]
        own, theirs, other = own[met], theirs[met], other[met]
        small = np.where(n[other] >= n[i], own, theirs), np.where(n[other] >= n[i], theirs, own)
        sizes = np.minimum(n[i], n[other]), np.maximum(n[i], n[other])
        fits = _possible(*sizes, *(places[s] for s in small), *(roles[s] for s in small))
        # of sets of one size either may be taken for the smaller one
        fits &= (n[other] != n[i]) | _possible(*sizes, *(places[s] for s in small[::-1]), *(roles[s] for s in small[::-1]))
        first = name[i] < name[other]
        then, now = np.where(first, places[own], places[theirs]), np.where(first, place[i], place[other])
        j = np.setdiff1d(j, other[fits & ((then < now) | ((then == now) & (lists[own] < here)))])
        keep[j] = True
        keep[i] |= len(j) > 0
    return table.drop_columns(["bits", "seen"]).filter(pa.array(keep))


def _across(table: pa.Table) -> pa.Table:
    """One block of a long list (columns of _ENTRY, bits, shingles): links of a set of the rest and one of the others, one at most for two
    components. Whole sets are compared here, so no candidate pair leaves the block."""
    table = table.sort_by("n")
    x, n, comp = table["x"].to_numpy(), table["n"].to_numpy().astype(np.int64), table["component"].to_numpy().copy()
    _, ids = np.unique(np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in table["shingles"]]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    mark, links = np.zeros(int(ids.max(initial=0)) + 1, bool), []
    for i, j in _meetings(table, comp):
        mark[ids[at[i] : at[i + 1]]] = True
        shared = np.add.reduceat(mark[np.concatenate([ids[at[k] : at[k + 1]] for k in j])], np.concatenate([[0], np.cumsum(n[j])[:-1]]))
        mark[ids[at[i] : at[i + 1]]] = False
        j = j[7 * shared >= 3 * (n[j] + n[i])]
        _, first = np.unique(comp[j], return_index=True)
        links += [(x[i], y) for y in x[j[first]]]
        comp[np.isin(comp, comp[j])] = comp[i]
    a, b = (np.array(c, np.int64) for c in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
    return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["x", "y"])


def _spots(keys: np.ndarray, width: int):
    """The places of HASHES bits of each key in its part of a digest, which has ``width`` bits."""
    h = mix(keys.view(np.uint64))
    step = h >> np.uint64(32) | np.uint64(1)
    for _ in range(HASHES):
        yield (h & np.uint64(width - 1)).view(np.int64)
        h = h + step


def _digest(table: pa.Table, width: int) -> pa.Table:
    """One part of the digest of some keys."""
    bits = np.zeros(width, bool)
    for at in _spots(table["key"].to_numpy(), width):
        bits[at] = True
    return pa.table([table["part"].slice(0, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])


def _held(keys: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether a digest (a row of bytes for each part) may have been made with each key: true for all it was made with."""
    part, keep = keys % PARTS, np.ones(len(keys), bool)
    for at in _spots(keys, digest.shape[1] * 8):
        keep &= digest[part, at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
    return keep


def _sets_of(batches, digest: np.ndarray):
    """name, shingles (sorted) of the documents that the digest holds (columns key, text); and the parities of BITS or more classes of them, and of
    FEW or more and at least as many as there are shingles, which rule out most of a long list's pairs."""

    def held():
        for batch in batches:
            batch = batch.filter(pa.array(_held(batch.column("key").to_numpy(), digest)))
            if len(batch):
                yield batch.select(["text"])

    for _, data, offsets in text_blocks(held(), "text", BLOCK, 1 << 20):
        for _, _, h, at in _pieces(data, offsets):
            _, name = _set_keys(h, at)
            spread = mix(h)
            bits, few = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                width = max(BITS, 1 << int(2 * (j - i) - 1).bit_length())
                odd = (np.bincount((spread[i:j] % np.uint64(width)).view(np.int64), minlength=width) & 1).astype(np.uint8)
                bits.append(np.packbits(odd, bitorder="little").tobytes())
                odd = np.bitwise_xor.reduce(odd.reshape(-1, max(FEW, 1 << int(j - i - 1).bit_length())), axis=0)
                few.append(np.packbits(odd, bitorder="little").tobytes())
            shingles = pa.Array.from_buffers(pa.large_binary(), len(name), [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([pa.array(name), shingles.cast(pa.binary()), pa.array(bits, pa.binary()), pa.array(few, pa.binary())], names=["name", "shingles", "bits", "few"])


def _near(batches):
    """x, y of pairs whose parities do not rule out a link (columns x, y, n_x, bits_x, n_y, bits_y; n: bytes of shingles)."""
    for batch in batches:
        sides = []
        for c in ("bits_x", "bits_y"):
            size, planes, row = _planes([v.as_buffer() for v in batch.column(c)])
            sides.append((planes, size, row))
        keep = 56 * _differ(*sides) <= batch.column("n_x").to_numpy() + batch.column("n_y").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep))


def shared_counts(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """How many values the k-th run of ``a`` and the k-th of ``b`` share; runs are sorted and without repeats."""
    m = len(a_at) - 1
    owner = np.repeat(np.arange(m, dtype=np.uint64), np.diff(a_at))
    shift = np.uint64(max(m - 1, 1).bit_length())
    short = lambda own, x: own << (np.uint64(64) - shift) | x >> shift
    theirs = short(np.repeat(np.arange(m, dtype=np.uint64), np.diff(b_at)), b)
    if not len(theirs):
        return np.zeros(m, np.int64)
    mine = short(owner, a)
    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
    hit = b[at] == a
    close = theirs[at] == mine
    out = np.bincount(owner[hit & close].view(np.int64), minlength=m)
    for k in np.unique(owner[close & ~hit]).tolist():  # other values that begin alike
        out[k] = len(np.intersect1d(a[a_at[k] : a_at[k + 1]], b[b_at[k] : b_at[k + 1]], assume_unique=True))
    return out


def _verify(batches):
    """x, y of pairs that link (columns x, y, a, b: both sets)."""

    def runs(column) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2][int(at[0]) : int(at[-1])], np.uint64), (at - at[0]) // 8

    for batch in batches:
        if len(batch):
            (a, a_at), (b, b_at) = runs(batch.column("a")), runs(batch.column("b"))
            keep = 7 * shared_counts(a, a_at, b, b_at) >= 3 * (np.diff(a_at) + np.diff(b_at))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep))


def _open_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The entries of the lists that still have several components: with each set's component, the list's largest (crowd), its
    sets (k) and shingles (w), and the list's (total, weight)."""
    named = lists.join(found, lists.x == found.node, "left").select(*lists.columns, F.coalesce("component", "x").alias("component"))
    counted = named.groupBy("bucket", "list", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    largest = F.max(F.struct("k", "component", "w")).alias("top")
    sums = [F.sum("k").alias("total"), F.sum("w").alias("weight"), F.count(F.lit(1)).alias("parts")]
    split = counted.groupBy("bucket", "list").agg(largest, *sums).where("parts > 1")
    split = split.select("bucket", "list", F.col("top.component").alias("crowd"), F.col("top.k").alias("k"), "total", F.col("top.w").alias("w"), "weight")
    return durable(named.join(durable(split, "jaccard-split"), ["bucket", "list"]), "jaccard-open")


def _stars(lists: DataFrame, turn: int) -> DataFrame:
    """x, y: each set and the pivots of PIVOTS of its lists, if they are not in one component yet (columns bucket, list, x, n, component)."""
    choices = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("bucket", "list", F.lit(turn)).alias("order"), "bucket", "list"))), 1, PIVOTS)
    chosen = lists.groupBy("x").agg(choices.alias("c"), F.first("n").alias("n"), F.first("component").alias("component"))
    chosen = durable(chosen.select("x", "n", "component", F.explode("c").alias("c")).select("x", "n", "component", "c.bucket", "c.list"), "jaccard-chosen")
    pivot = F.min(F.struct(F.xxhash64("x", F.lit(turn)).alias("order"), "x", "n", "component")).alias("p")
    pivots = durable(chosen.groupBy("bucket", "list").agg(pivot).select("bucket", "list", F.col("p.x").alias("y"), F.col("p.n").alias("m"), F.col("p.component").alias("other")), "jaccard-pivots")
    met = chosen.join(pivots, ["bucket", "list"]).where("component <> other AND 4 * least(n, m) >= 3 * greatest(n, m)")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _blocks_of(entries: DataFrame) -> DataFrame:
    """Open lists in blocks in which all pairs of a block's rest with others are to be compared: bucket, list, i, j and the
    entry. The rest are the sets outside a list's largest component."""
    entries = entries.withColumn("rest", (F.col("component") != F.col("crowd")).cast("int"))
    chunks = lambda sets, shingles: F.greatest(F.ceil(sets / CHUNK), F.ceil(shingles / HELD)).cast("int")
    rests, alls = chunks(F.col("total") - F.col("k"), F.col("weight") - F.col("w")), chunks(F.col("total"), F.col("weight"))
    # block (i, j) has the rest's i-th chunk and everyone's j-th; of the rest every set is in chunk i and in chunk j
    own, every = F.pmod(F.xxhash64("x"), rests).cast("int"), F.pmod(F.xxhash64("x", F.lit(1)), alls).cast("int")
    as_rest = F.transform(F.sequence(F.lit(0), alls - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(1).alias("rest")))
    as_any = F.transform(F.sequence(F.lit(0), rests - 1), lambda i: F.struct(i.alias("i"), every.alias("j"), F.lit(0).alias("rest")))
    places = F.when(F.col("rest") == 1, F.concat(as_rest, as_any)).otherwise(as_any)
    wide = entries.select("bucket", "list", "x", "n", "place", "role", "component", F.explode(places).alias("at"))
    return wide.select("bucket", "list", "x", "n", "place", "role", "component", "at.i", "at.j", "at.rest")


def _contracted(links: DataFrame, found: DataFrame) -> DataFrame:
    """found with the components that new links join."""
    for side in ("x", "y"):
        links = links.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    roots = links.select(*(F.coalesce(f"c_{side}", side).alias(side) for side in ("x", "y"))).where("x <> y")
    joined = durable(components(roots.toDF("a", "b")).withColumnsRenamed({"node": "root", "component": "further"}), "jaccard-joined")
    old = found.join(joined, found.component == joined.root, "left").select("node", F.coalesce("further", "component").alias("component"))
    alone = joined.join(found, joined.root == found.node, "left_anti").select(F.col("root").alias("node"), F.col("further").alias("component"))
    return durable(old.unionByName(alone), "jaccard-found")


def _united(sets: DataFrame, lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, component of the sets that the candidate pairs and the long lists link."""

    def linked(found: DataFrame) -> DataFrame:
        marks = sets.select("name", F.octet_length("shingles").alias("n"), "bits")
        for side in ("x", "y"):
            found = found.join(marks.select(F.col("name").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
        found = found.mapInArrow(_near, "x long, y long")
        a, b = sets.select(F.col("name").alias("x"), F.col("shingles").alias("a")), sets.select(F.col("name").alias("y"), F.col("shingles").alias("b"))
        return durable(found.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(_verify, "x long, y long"), "jaccard-links")

    found = components(linked(pairs).toDF("a", "b"))
    for turn in range(ROUNDS + 1):
        entries = lists.withColumn("component", F.col("x")) if turn == 0 < ROUNDS else _open_lists(lists, found)
        if entries.isEmpty():
            break
        if turn < ROUNDS:
            more = _stars(entries, turn)
        else:  # every pair of the lists has been tried then, or both its sets were in one component already
            # parities choose the sets that have to be compared whole; only these bring their shingles
            entry = [c.split()[0] for c in _ENTRY.split(", ")]
            busy = _blocks_of(entries).join(sets.select(F.col("name").alias("x"), F.col("few").alias("bits")), "x").select(*entry, "bits").groupBy(*entry[:4]).applyInArrow(_busy, _ENTRY)
            busy = durable(busy, "jaccard-busy")
            lists_of = F.array_sort(F.collect_set(F.struct("place", F.shiftleft(F.col("bucket").cast("long"), 33).bitwiseOR(F.col("list")).alias("at"), "role")))
            seen = busy.groupBy("x").agg(F.slice(lists_of, 1, SEEN).alias("seen"))
            owned = busy.join(sets.select(F.col("name").alias("x"), "bits"), "x").join(seen, "x").select(*entry, "bits", "seen").groupBy(*entry[:4]).applyInArrow(_owned, _ENTRY)
            blocks = durable(owned, "jaccard-owned").join(sets.select(F.col("name").alias("x"), "bits", "shingles"), "x").select(*entry, "bits", "shingles")
            more = durable(blocks.groupBy(*entry[:4]).applyInArrow(_across, "x long, y long").distinct(), "jaccard-more")
        found = _contracted(linked(more) if turn < ROUNDS else more, found)
    return found


def _members(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row: id, hash (of the text), n (its shingles), least (its component's smallest id)."""
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("id"), F.xxhash64(whole("text")).alias("hash"), whole("text").alias("text"))
    total = max(docs.count(), 1)
    width = min(max((4 * total).bit_length(), SKETCH[0]), SKETCH[1])
    survey = durable(texts.mapInArrow(lambda b: _survey(b, width), "id long, hash long, n long, name long, part int, counts binary"), "jaccard-survey")
    rows = survey.where("part IS NULL").select("id", "hash", "n", "name")
    # PARTS parts of a table of bounded size
    parts = survey.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(_add_counts, "part int, counts binary").collect()
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(parts, key=lambda r: r["part"])]) if parts else np.zeros(1 << width, np.int64)
    # a row per size class: eight to each doubling
    classes = rows.where("n > 1").groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    light = boundary({r["n"]: r["k"] for r in classes}, counts)
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // SHARE)
    # shingles by how much more often than the mean their counter was hit: 0 below twice the mean, then by doublings
    rank = np.clip(np.log2(np.maximum(counts, 1) / max(counts.mean(), 1)).astype(np.int64), 0, 15).astype(np.uint8)
    table = spark.sparkContext.broadcast(rank)
    sent = texts.select("text").mapInArrow(lambda b: _send(b, buckets, light, table.value), "bucket int, data binary")
    longest = LIST
    listed = durable(sent.groupBy("bucket").applyInArrow(lambda t: _lists(t, longest), _PAIRS), "jaccard-lists")
    nodes = rows.where("n > 1").groupBy("name").agg(F.min(F.struct("id", "hash")).alias("first"))
    lists = listed.where("y IS NULL").select("bucket", "list", "x", "n", "place", "role")
    pairs = durable(listed.where("y IS NOT NULL").select("x", "y").distinct(), "jaccard-pairs")
    involved = pairs.select("x").unionByName(pairs.select(F.col("y").alias("x"))).unionByName(lists.select("x")).distinct().join(nodes, F.col("x") == F.col("name")).select(F.xxhash64("first.id", "first.hash").alias("key"))
    # each task takes the documents that are asked for by a digest of bounded size, so no text is shuffled
    span = 1 << max(min((DIGEST[0] * total).bit_length(), DIGEST[1]) - (PARTS - 1).bit_length(), 6)
    held = involved.withColumn("part", F.pmod("key", F.lit(PARTS)).cast("int")).groupBy("part").applyInArrow(lambda t: _digest(t, span), "part int, bits binary")
    bits = np.zeros((PARTS, span // 8), np.uint8)
    for r in held.collect():
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    digest = spark.sparkContext.broadcast(bits)
    # rows that repeat a document, or that the digest lets through, repeat links at most; dealt by name once, the sets stay where they are in all joins
    keyed = texts.select(F.xxhash64("id", "hash").alias("key"), "text")
    sets, drop_sets = bucketed(keyed.mapInArrow(lambda b: _sets_of(b, digest.value), "name long, shingles binary, bits binary, few binary"), "name", "jaccard_sets")

    try:
        found = _united(sets, lists, pairs)
    finally:
        drop_sets()
    # a node's component is named by its smallest document
    smallest = nodes.select("name", "first.id").join(found, F.col("name") == F.col("node"), "left").withColumn("component", F.coalesce("component", "name"))
    named = smallest.join(smallest.groupBy("component").agg(F.min("id").alias("least")), "component").select("name", "least")
    alone = rows.where("n = 1").groupBy("name").agg(F.min("id").alias("least"))
    return rows.join(named.unionByName(alone), "name", "left").select("id", "hash", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("least"))


def near_components(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words are runs of other characters than ``[\\x20\\x09-\\x0D]``, A-Z in lower case. Texts with fewer than five words have one
    shingle, null, empty and blank texts none: these link with nothing and are their own component. Rows
    with equal sets are one node, so repeated rows and copies share a component. A null doc_id counts as
    larger than any other; alone, its component is null. An empty table gives no rows.
    """
    out = _members(docs, buckets)
    return out.select(F.nullif("id", F.lit(_LAST)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("least", F.lit(_LAST)).alias("component_id"))


def near_dedup(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns of docs.

    Rows without words link with nothing, so all of them stay. Of rows that repeat the smallest doc_id one stays.
    """
    names = {c: fresh(docs, c) for c in ("id", "hash", "empty", "order")}
    own = F.coalesce("doc_id", F.lit(_LAST)).cast("long"), F.xxhash64(whole("text"))
    kept = _members(docs, buckets).where("id = least").groupBy("id", "least", F.when(F.col("n") == 0, F.col("hash")).alias("own")).agg(F.min("hash").alias("hash"), F.max(F.col("n") == 0).alias("empty"))
    kept = kept.select(*(F.col(c).alias(names[c]) for c in ("id", "hash", "empty")))
    found = docs.withColumn(names["id"], own[0]).withColumn(names["hash"], own[1]).join(kept, [names["id"], names["hash"]])
    first = W.partitionBy(names["id"], names["hash"]).orderBy(F.lit(0))
    return found.withColumn(names["order"], F.row_number().over(first)).where((F.col(names["order"]) == 1) | F.col(names["empty"])).select(*docs.columns)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))
