"""Removal of long repeats by a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller doc_id. Work is cut by
content. The LENGTH-byte strings of a text are grouped by the smallest hash of the GRAM-byte grams inside
them: a run of neighbouring strings with one smallest gram is a stretch of text, and equal strings always fall
to equal grams. Grams only bring runs together, so 32 bits of theirs do.

Texts are written once, compressed, in blocks, and each step reads the blocks where they lie: what it needs of the others comes
to them, never the texts. Texts of COPY bytes or more that equal one of a smaller doc_id, by a hash of 128 bits, go whole. Of the others
each block tells every bucket which grams it has, and hears which of them another block has too. Only runs of grams that more than one document has are reported to the gram's bucket, with a hash of the stretch, of 128 bits.

Equal stretches are settled at once, within a block of texts before anything is sent and then in the bucket: all but those of
the smallest doc_id go. So a passage costs a bucket one entry per block, however many documents have it. A gram that
comes very often in different stretches, as at the edge of such a passage, is taken apart: its strings are dealt one by
one, each by its own hash, over all buckets.

Only where one gram has different stretches of different documents are their bytes fetched and their suffixes compared: in the order of doc_id
a batch of suffixes is sorted (down to LENGTH bytes) into a suffix array and merge-scanned against the family's
levels; what it finds there starts in an earlier document. Then it becomes a level itself, and levels of equal
size merge, so there are only logarithmically many.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.blocks import _BYTE_VALUE, mix, pieces, powers, utf8
from tesserae.llm.packing import by_byte, from_bytes, pack, spans_union, text_blocks, unpack
from tesserae.llm.shared import documents, durable, scratch, text_batches, whole

#: Shorter grams make fewer runs, but meet by chance in more of a larger input, and then bytes are fetched.
LENGTH, GRAM = 50, 24
#: Bytes of texts worked on together; suffixes sorted together; strings of a run at most (longer runs are split).
BLOCK, BATCH, RUN = 4 << 20, 1 << 16, 255
_LAST = np.iinfo(np.int64).max
#: Rows of blocks in a batch; 2**PART blocks of a task are in one file.
ROWS, PART = 64, 2
#: Bytes of a text for which its hash is sent.
COPY = 1000
#: Grams are counted in 2**SKETCH counters. One that comes HOT times or more (with those that share its counter) is taken apart.
SKETCH, HOT = 18, 1 << 17
#: Bytes of text for which there is a bucket at least.
BUCKET = 64 << 20
#: Base of the second half of a stretch's hash, and values of bytes there, independent of those in the first.
_SECOND_BASE = 0xD1342543DE82EF95
_SECOND_VALUE = np.random.Generator(np.random.PCG64(20250311)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None = None, length: int = LENGTH, gram: int = GRAM, stretches: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest gram's hash, first place, number of strings, and the two halves of the stretch's hash of each run of strings. Strings
    under a hot gram (a flag for each counter) are runs of their own, with their own hash for the gram's. Without ``stretches`` their hashes can be missing."""
    n = len(data)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < length:
        return none
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    width = length - gram + 1
    padded = np.concatenate([grams, np.full(-len(grams) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    fits = np.ones(count, bool)  # strings that do not cross the end of a text
    for back in range(1, length):
        at = offsets[1:-1] - back
        fits[at[(at >= 0) & (at < count)]] = False
    head = np.ones(count, bool)
    head[1:] = (least[1:] != least[:-1]) | ~fits[:-1]
    head[offsets[1:-1][offsets[1:-1] < count]] = True
    head &= fits
    first = np.flatnonzero(head)
    if not len(first):
        return none
    end = np.concatenate([first[1:], [count]])
    gaps = np.flatnonzero(~fits)
    if len(gaps):
        next_gap = np.concatenate([gaps, [count]])[np.searchsorted(gaps, first)]
        end = np.minimum(end, next_gap)
    size = end - first
    key = mix(least[first] + np.uint64(1))  # smallest hashes are small: spread them over the buckets
    single = np.zeros(len(key), bool) if hot is None else hot[(key & np.uint64(len(hot) - 1)).view(np.int64)]
    unit = np.where(single, 1, RUN)
    parts = -(-size // unit)
    if parts.max() > 1:
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        unit, single, key = np.repeat(unit, parts), np.repeat(single, parts), np.repeat(key, parts)
        first, size = np.repeat(first, parts) + step * unit, np.minimum(np.repeat(size, parts) - step * unit, unit)
    if not stretches and not single.any():
        return key, first, size, *none[3:]
    stop = first + size + length - 1
    stretch = mix((total[stop] - total[first]) * down[first] + size.astype(np.uint64))
    up, down = powers(n + 1, _SECOND_BASE)
    np.cumsum(_SECOND_VALUE[data] * up[:n], out=total[1:])
    second = mix((total[stop] - total[first]) * down[first] + size.astype(np.uint64))
    return np.where(single, mix(stretch + np.uint64(2)), key), first, size, stretch, second


_RUNS = [np.uint32, np.uint64, np.uint64, np.uint8, np.uint8, np.uint8, np.uint8]


def _block_runs(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray, stretches: bool = True) -> tuple[np.ndarray, ...]:
    """runs() of a whole block, a piece at a time."""
    parts = list(pieces(offsets))
    found = [runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hot, stretches=stretches) for i, j in parts]
    gram, first, size, stretch, second = ([x[c] for x in found] for c in range(5))
    return tuple(np.concatenate(x) for x in (gram, [x + offsets[i] for x, (i, _) in zip(first, parts)], size, stretch, second))


def _places(gram: np.ndarray, buckets: int) -> np.ndarray:
    """A gram's bucket, by the upper half of its hash, above the lower half."""
    return (gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32) | gram & np.uint64(0xFFFFFFFF)


def _cuts(places: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted places, and their end."""
    return np.searchsorted(places, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def _store(batches):
    """Blocks of texts, compressed (columns part, block, data)."""
    from pyspark import TaskContext

    for k, (rows, data, offsets) in enumerate(text_blocks(batches, "text", BLOCK, 1 << 20)):
        block = TaskContext.get().partitionId() << 24 | k
        texts = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))
        table = pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), texts], names=["doc_id", "text"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(table)
        yield pa.RecordBatch.from_arrays([pa.array([block >> PART]), pa.array([block]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["part", "block", "data"])


def _opened(batches) -> Iterator[tuple[int, pa.RecordBatch, list[dict]]]:
    """Number, texts (columns doc_id, text, id) and rows of ``found`` of each block."""
    for batch in batches:
        for i in range(len(batch)):
            texts = pa.ipc.open_stream(batch["data"][i].as_buffer()).read_next_batch()
            found = batch["found"][i].as_py() if "found" in batch.schema.names else None
            yield batch["block"][i].as_py(), texts.append_column("id", pc.fill_null(texts["doc_id"], _LAST)), found or []


def stored(texts: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Blocks of texts as a table in the shared folder, whose parts stay where they are in joins; and what takes its name out of the
    catalog. Texts are not shuffled for it, since a part is of one task."""
    spark = texts.sparkSession
    table = f"texts_{uuid.uuid4().hex}"
    blocks = texts.select("doc_id", "text").mapInArrow(_store, "part long, block long, data binary")
    blocks.write.format("parquet").option("path", scratch(spark, "repeats-texts")).option("compression", "none").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").saveAsTable(table)
    return spark.table(table), lambda: spark.sql(f"DROP TABLE {table}") and None


def _with_found(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Each block with its rows of ``found`` (which has a column block); only these are shuffled."""
    lists = found.groupBy(F.shiftright("block", PART).alias("part")).agg(F.collect_list(F.struct(*found.columns)).alias("found"))
    joined = blocks.join(lists.hint("shuffle_hash"), "part", "left")
    return joined.select("block", "data", F.filter("found", lambda x: x["block"] == F.col("block")).alias("found"))


def _survey(batches):
    """This task's counts of smallest grams, in 64 parts, and in one part more the halves of its number of bytes."""
    counts, size = np.zeros(1 << SKETCH, np.uint32), 0
    for _, data, offsets in text_blocks(batches, "text", BLOCK, 1 << 20):
        size += len(data)
        for i, j in pieces(offsets):
            key = runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], stretches=False)[0]
            counts += np.bincount((key & np.uint64((1 << SKETCH) - 1)).view(np.int64), minlength=1 << SKETCH).astype(np.uint32)
    parts = [*(counts.reshape(64, -1) if counts.any() else []), np.array([size & 0xFFFFFFFF, size >> 32], np.uint32)]
    yield pa.RecordBatch.from_arrays([pa.array(range(65 - len(parts), 65), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "counts"])


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in table["counts"])
    return pa.table([table["part"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def hot_grams(texts: DataFrame, least: int) -> tuple[np.ndarray, int]:
    """A flag for each counter, from the whole table: whether its grams come ``least`` times or more; and the bytes of all texts."""
    # 65 parts of a table of fixed size
    parts = texts.select("text").mapInArrow(_survey, "part int, counts binary").groupBy("part").applyInArrow(_add_counts, "part int, counts binary").collect()
    out, size = np.zeros((64, (1 << SKETCH) // 64), bool), 0
    for r in parts:
        counts = np.frombuffer(r["counts"], np.int64)
        if r["part"] == 64:
            size = int(counts[0]) + (int(counts[1]) << 32)
        else:
            out[r["part"]] = counts >= least
    return out.ravel(), size


def _digests(batches):
    """Hash, id, block and place in it of each text of COPY bytes or more."""
    for block, texts, _ in _opened(batches):
        data, offsets = utf8(texts["text"])
        place = np.flatnonzero(np.diff(offsets) >= COPY)
        digests = [hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest() for i in place]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), texts["id"].take(pa.array(place)), pa.array([block] * len(place), pa.int64()), pa.array(place.astype(np.int32))], names=["digest", "id", "block", "place"])


def copies_of(blocks: DataFrame) -> DataFrame:
    """Per block the places of texts that equal one of a smaller doc_id, where there are any."""
    digests = blocks.select("block", "data").mapInArrow(_digests, "digest binary, id long, block long, place int")
    least = digests.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    return digests.join(least, "digest").where("id > least").groupBy("block").agg(F.collect_list("place").alias("copies"))


def _copies(found: list[dict], offsets: np.ndarray) -> np.ndarray:
    """A flag for each text of a block."""
    out = np.zeros(len(offsets) - 1, bool)
    for x in found:
        out[x["copies"] or []] = True
    return out


def _tell(batches, buckets: int, hot: np.ndarray):
    """Each block's different grams of each bucket, in order, as differences."""
    for block, texts, found in _opened(batches):
        data, offsets = utf8(texts["text"])
        gram, first, *_ = _block_runs(data, offsets, hot, stretches=False)
        places = np.unique(_places(gram[~_copies(found, offsets)[np.searchsorted(offsets, first, "right") - 1]], buckets))
        cuts = _cuts(places, buckets)
        some = np.flatnonzero(np.diff(cuts))
        keys = [by_byte(np.diff(places[cuts[b] : cuts[b + 1]].astype(np.uint32), prepend=np.uint32(0))).tobytes() for b in some]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([block] * len(some), pa.int64()), pa.array(keys, pa.binary())], names=["bucket", "block", "keys"])


def _common(table: pa.Table) -> pa.Table:
    """One bucket: for each block a bit for each of its grams, whether another block has it."""
    keys = [np.cumsum(from_bytes(np.frombuffer(x.as_buffer(), np.uint8), np.uint32), dtype=np.uint32) for x in table["keys"]]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    at = np.flatnonzero(_starts(every[order]))
    n = np.diff(np.concatenate([at, [len(every)]]))
    common = np.zeros(len(every), bool)
    common[order] = np.repeat(n > 1, n)  # a block has each of its grams once
    bits = [np.packbits(x).tobytes() for x in np.split(common, np.cumsum([len(x) for x in keys])[:-1])]
    return pa.table([table["bucket"], table["block"], pa.array(bits, pa.binary())], names=["bucket", "block", "bits"])


def _of_several(places: np.ndarray, ids: np.ndarray, answers: list[dict], buckets: int) -> np.ndarray:
    """Whether the gram of a run is in another document: another block has it, by the answers, or another document of this one."""
    order = np.argsort(places, kind="stable")
    at = np.flatnonzero(_starts(places[order]))
    own = ids[order]
    several = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at) if len(at) else np.zeros(0, bool)
    cuts = _cuts(places[order[at]], buckets)
    for x in answers:
        a, b = cuts[x["bucket"]], cuts[x["bucket"] + 1]
        several[a:b] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
    out = np.zeros(len(places), bool)
    out[order] = np.repeat(several, np.diff(np.concatenate([at, [len(order)]])))
    return out


_SENT = "bucket int, block long, kind int, data binary"
#: Kinds of rows: spans that go, runs (whose bytes are needed, once settled).
GONE, OPEN = range(2)


def _send(batches, buckets: int, hot: np.ndarray, block: int = 0, found: list[dict] | None = None):
    """What one block's texts send: of all runs, or, with what is found, of those whose grams are in several documents."""
    names, kinds = ["bucket", "block", "kind", "data"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def row(bucket: int, kind: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((bucket, block, kind, data), kinds)], names=names)

    for rows, data, offsets in text_blocks(batches, "text", BLOCK, 1 << 20):
        ids = rows["id"].combine_chunks().to_numpy()
        gram, first, size, stretch, second = _block_runs(data, offsets, hot)
        place, doc = _places(gram, buckets), np.searchsorted(offsets, first, "right") - 1
        if found is not None:
            new = np.flatnonzero(~_copies(found, offsets)[doc])
            chosen = new[_of_several(place[new], ids[doc[new]], [x for x in found if x["bits"] is not None], buckets)]
            place, first, size, stretch, second, doc = (x[chosen] for x in (place, first, size, stretch, second, doc))
        order = np.lexsort((ids[doc], second, stretch, place))
        place, first, size, stretch, second, doc = (x[order] for x in (place, first, size, stretch, second, doc))
        # of equal stretches of this block those of the smallest document alone go on; the others are settled
        head = np.flatnonzero(_starts(place, stretch, second))
        later = ids[doc] > np.repeat(ids[doc[head]], np.diff(np.concatenate([head, [len(place)]])))
        if later.any():
            yield row(-1 - block % buckets, GONE, _spans(first[later], size[later] + LENGTH - 1))
            place, first, size, stretch, second, doc = (x[~later] for x in (place, first, size, stretch, second, doc))
        cuts = _cuts(place, buckets)
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            yield row(int(b), OPEN, pack([place[s].astype(np.uint32), stretch[s], second[s], size[s].astype(np.uint8), by_byte(first[s].astype(np.uint32)), *_of_ids(ids[doc[s]])]))


def _of_ids(ids: np.ndarray) -> list[np.ndarray]:
    """Different ids, and which of them each is."""
    different, which = np.unique(ids, return_inverse=True)
    return [by_byte(different), by_byte(which.astype(np.uint32))]


def _ids(different: np.ndarray, which: np.ndarray) -> np.ndarray:
    return from_bytes(different, np.int64)[from_bytes(which, np.uint32)]


def _spans(first: np.ndarray, length: np.ndarray | int) -> bytes:
    """What stretches cover of a block: distances of starts, and lengths."""
    first = first.astype(np.int64)
    starts, ends = spans_union(first, first + length)
    return pack([by_byte(np.diff(starts, prepend=0).astype(np.uint32)), by_byte((ends - starts).astype(np.uint32))])


def _starts_and_lengths(packed: list) -> tuple[np.ndarray, np.ndarray]:
    """Of all spans in some such columns."""
    parts = [[from_bytes(x, np.uint32).astype(np.int64) for x in unpack(data, [np.uint8, np.uint8])] for data in packed]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(np.cumsum(p[0]) for p in parts)]), np.concatenate([none, *(p[1] for p in parts)])


def _starts(*columns: np.ndarray) -> np.ndarray:
    head = np.zeros(len(columns[0]), bool)
    if len(head):
        head[0] = True
        for c in columns:
            head[1:] |= c[1:] != c[:-1]
    return head


_NEED = [np.uint32, np.uint8]


def _settle(table: pa.Table) -> pa.Table:
    """One bucket: for each block the spans that go and the runs whose bytes are needed."""
    bucket = table["bucket"][0].as_py()
    if bucket < 0:
        return table
    blocks = table["block"].to_numpy()
    parts = [unpack(x.as_buffer(), _RUNS) for x in table["data"]]
    sizes = [len(p[0]) for p in parts]
    key, stretch, second, size = (np.concatenate([p[i] for p in parts]) for i in range(4))
    first = np.concatenate([from_bytes(p[4], np.uint32) for p in parts])
    ids = np.concatenate([_ids(p[5], p[6]) for p in parts])
    block = np.repeat(np.arange(len(parts)), sizes)
    order = np.lexsort((ids, second, stretch, key))
    k, i = key[order], ids[order]
    same_key, same = _starts(k), _starts(k, stretch[order], second[order])
    at = np.flatnonzero(same)
    smallest = np.repeat(i[at], np.diff(np.concatenate([at, [len(k)]])))
    gone = i > smallest
    # a gram with different stretches, whose smallest documents differ
    at = np.flatnonzero(same_key)
    n = np.diff(np.concatenate([at, [len(k)]]))
    several = np.add.reduceat(same.astype(np.int64), at) > 1 if len(at) else np.zeros(0, bool)
    differ = np.minimum.reduceat(smallest, at) != np.maximum.reduceat(smallest, at) if len(at) else several
    need = np.repeat(several & differ, n) & ~gone
    out_block, out_kind, out = [], [], []
    for kind, chosen in ((GONE, order[gone]), (OPEN, order[need])):
        chosen = chosen[np.argsort(block[chosen], kind="stable")]
        cuts = np.searchsorted(block[chosen], np.arange(len(parts) + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            c = chosen[cuts[b] : cuts[b + 1]]
            out_block.append(int(blocks[b]))
            out_kind.append(kind)
            out.append(_spans(first[c], size[c].astype(np.int64) + LENGTH - 1) if kind == GONE else pack([first[c], size[c]]))
    return pa.table([pa.array([bucket] * len(out), pa.int32()), pa.array(out_block, pa.int64()), pa.array(out_kind, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "block", "kind", "data"])


def _by_block(table: pa.Table) -> pa.Table:
    """One block: the spans that go and the runs that are needed, by their places in the block."""
    kinds, buckets = table["kind"].to_numpy(), table["bucket"].to_numpy()
    starts, length = _starts_and_lengths([table["data"][int(r)].as_buffer() for r in np.flatnonzero(kinds == GONE)])
    rows = np.flatnonzero(kinds == OPEN)
    parts = [unpack(table["data"][int(r)].as_buffer(), _NEED) for r in rows]
    need = [np.concatenate([np.zeros(0, t), *(p[c] for p in parts)]) for c, t in enumerate(_NEED)]
    bucket = np.repeat(buckets[rows], [len(p[0]) for p in parts]).astype(np.int32)
    gone = _spans(starts, length) if len(starts) else None
    return pa.table([table["block"].slice(0, 1), pa.array([gone], pa.binary()), pa.array([pack([*need, bucket]) if len(rows) else None], pa.binary())], names=["block", "gone", "need"])


_BYTES = [np.uint8, np.uint8, np.uint8, np.uint8, np.uint8]


def _fetch(batches, buckets: int):
    """The bytes of the needed runs, packed by bucket (columns bucket, block, data)."""
    for block, texts, found in _opened(batches):
        if not found:
            continue
        data, offsets = utf8(texts["text"])
        ids = texts["id"].to_numpy()
        need = [unpack(x["need"], [np.uint32, np.uint8, np.int32]) for x in found]
        first, size, bucket = (np.concatenate([x[c] for x in need]).astype(np.int64) for c in range(3))
        order = np.lexsort((first, bucket))
        first, size, bucket = first[order], size[order], bucket[order]
        doc = np.searchsorted(offsets, first, "right") - 1
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            length = size[s] + LENGTH - 1
            ends = np.cumsum(length)
            bytes_ = data[np.arange(ends[-1]) + np.repeat(first[s] - (ends - length), length)]
            payload = pack([bytes_, size[s].astype(np.uint8), by_byte(first[s].astype(np.uint32)), *_of_ids(ids[doc[s]])])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["bucket", "block", "data"])


class Family:
    """Sorted arrays of LENGTH-byte suffixes of earlier documents: level i holds about 2**i batches."""

    def __init__(self, batch: int = BATCH):
        self.batch, self.levels = batch, []

    def scan(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the sorted suffixes stand in a level."""
        found = np.zeros(len(suffixes), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            found |= level[at] == suffixes
        return found

    def add(self, suffixes: np.ndarray) -> None:
        """A sorted array without repeats becomes a level; levels of equal size class merge."""
        if not len(suffixes):
            return
        self.levels.append(suffixes)
        rank = lambda x: max(len(x) // self.batch, 1).bit_length()
        while len(self.levels) > 1 and rank(self.levels[-1]) >= rank(self.levels[-2]):
            merged = np.sort(np.concatenate([self.levels.pop(), self.levels.pop()]), kind="stable")
            self.levels.append(merged[_starts(merged)])


def repeated(stretches: np.ndarray, size: np.ndarray, ids: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Which strings also start in a stretch of a smaller id. stretches: the bytes one after the other, ``size`` + LENGTH - 1
    of each; the result has ``size`` flags of each."""
    at = np.cumsum(size + LENGTH - 1) - size - LENGTH + 1
    out_at = np.cumsum(size) - size
    out = np.zeros(size.sum(), bool)
    place = np.arange(len(out)) + np.repeat(at - out_at, size)
    up, down = powers(len(stretches) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[stretches] * up[: len(stretches)], dtype=np.uint64)])
    hashes = (total[place + LENGTH] - total[place]) * down[place]
    del total
    # strings of which no other document has one with the same hash cannot repeat; all others are compared byte for byte
    order = np.argsort(hashes)
    head = np.flatnonzero(_starts(hashes[order]))
    owner = np.repeat(np.arange(len(size)), size)
    doc = ids[owner[order]]
    shared = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head) if len(head) else np.zeros(0, bool)
    chosen = np.sort(order[np.repeat(shared, np.diff(np.concatenate([head, [len(order)]])))])
    chosen = chosen[np.argsort(ids[owner[chosen]], kind="stable")]
    doc = ids[owner[chosen]]
    del order, hashes, owner
    strings = np.lib.stride_tricks.sliding_window_view(stretches, LENGTH) if len(stretches) >= LENGTH else None
    family = Family(batch)
    i = 0
    while i < len(chosen):
        j = min(i + batch, len(chosen))
        j = int(np.searchsorted(doc, doc[j - 1], "right"))  # a document is in one batch
        suffix = np.ascontiguousarray(strings[place[chosen[i:j]]]).view(f"S{LENGTH}").ravel()
        array = np.argsort(suffix, kind="stable")  # documents are in order, so equal suffixes are too
        suffix, own = suffix[array], doc[i:j][array]
        head = np.flatnonzero(_starts(suffix))
        repeats = np.diff(np.concatenate([head, [len(suffix)]]))
        different = suffix[head]
        out[chosen[i:j][array]] = np.repeat(family.scan(different), repeats) | (own > np.repeat(own[head], repeats))
        family.add(different)
        i = j
    return out


def _compare(table: pa.Table) -> pa.Table:
    """One bucket's needed stretches: per block the spans that go."""
    blocks = table["block"].to_numpy()
    parts = [unpack(x.as_buffer(), _BYTES) for x in table["data"]]
    stretches, size = (np.concatenate([p[c] for p in parts]) for c in range(2))
    first = np.concatenate([from_bytes(p[2], np.uint32) for p in parts]).astype(np.int64)
    ids = np.concatenate([_ids(p[3], p[4]) for p in parts])
    size = size.astype(np.int64)
    gone = repeated(stretches, size, ids)
    owner = np.repeat(np.arange(len(size)), size)
    place = (first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size))[gone]
    cuts = np.searchsorted(owner[gone], np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])]))
    some = np.flatnonzero(np.diff(cuts))
    spans = [_spans(place[cuts[i] : cuts[i + 1]], LENGTH) for i in some]
    return pa.table([pa.array(blocks[some]), pa.array(spans, pa.binary())], names=["block", "gone"])


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches, with_text: bool):
    """Remove the spans of each block."""
    for _, texts, found in _opened(batches):
        data, offsets = utf8(texts["text"])
        starts, length = _starts_and_lengths([x["gone"] for x in found if x["gone"] is not None])
        copies = _copies(found, offsets)
        begins = np.concatenate([starts, offsets[:-1][copies]])
        starts, ends = spans_union(begins, begins + np.concatenate([length, np.diff(offsets)[copies]]))
        edges = np.concatenate([[0], np.stack([starts, ends], 1).ravel(), [len(data)]])
        gone = np.repeat(np.arange(len(edges) - 1) % 2 == 1, np.diff(edges))
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        head[begins] = gone[begins]  # a run ends with its text
        n_spans, kept = (np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.uint32)])[offsets].astype(np.int64)) for x in (head, ~gone))
        left = memoryview(data[~gone].tobytes())
        ends = np.cumsum(kept)
        parts = [left[a:b] for a, b in zip(ends - kept, ends)]
        n = np.diff(offsets)
        digests = pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        bytes_ = pa.array([x.tobytes() for x in parts], pa.binary()) if with_text else pa.nulls(len(n), pa.binary())
        yield pa.RecordBatch.from_arrays([texts["doc_id"], *(pa.array(x.astype(np.int64)) for x in (n, n - kept, n_spans)), digests, bytes_], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, with_text: bool = True, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes that
    stay; null without ``with_text``).

    Null and empty texts have nothing to remove; texts below LENGTH bytes neither give nor lose any. Strings are
    judged on the input. Rows with one doc_id are one document: they take nothing from each other.
    A null doc_id is larger than any other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    heavy, size = hot_grams(texts, hot)
    flags = spark.sparkContext.broadcast(heavy)  # 2**SKETCH flags
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    blocks, drop_blocks = stored(texts)
    text_batches(spark, ROWS)

    def send(batches):
        for block, some, known in _opened(batches):
            yield from _send([some], buckets, flags.value, block, known)

    try:
        copies = durable(copies_of(blocks), "repeats-copies")
        told = _with_found(blocks, copies).mapInArrow(lambda b: _tell(b, buckets, flags.value), "bucket int, block long, keys binary")
        common = told.groupBy("bucket").applyInArrow(_common, "bucket int, block long, bits binary")
        known = common.select("block", "bucket", "bits").unionByName(copies, allowMissingColumns=True)
        settled = _with_found(blocks, known).mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(_settle, _SENT)
        found = durable(settled.groupBy("block").applyInArrow(_by_block, "block long, gone binary, need binary"), "repeats-found")
        stretches = _with_found(blocks, found.select("block", "need").where("need IS NOT NULL")).mapInArrow(lambda b: _fetch(b, buckets), "bucket int, block long, data binary")
        compared = stretches.groupBy("bucket").applyInArrow(_compare, "block long, gone binary")
        spans = found.select("block", "gone").where("gone IS NOT NULL").unionByName(compared).unionByName(copies, allowMissingColumns=True)
        return _with_found(blocks, spans).mapInArrow(lambda b: _cut(b, with_text), _CUT)
    finally:
        drop_blocks()


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False).drop("kept")
