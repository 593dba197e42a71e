"""A corpus as shards: rows of a table in the shared folder that hold the texts of many documents each, and the exchange
between them.

Shards send sorted runs of records to buckets; a reducer sees all runs of a bucket and answers each; the answers come back
to the shards, whose texts stay where they are, as the table is bucketed by shard. What travels is distinct within a shard,
so a passage in a third of all documents costs a record for each shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textbytes as tb

NAMES = ("shard", "ids", "nulls", "ends", "text")
RUN = "shard long, bucket long, run binary"
#: Records of short runs that are sorted together.
GATHER = 8192
#: Bytes of stretches that are compared at once: those of other anchors wait.
AT_ONCE = 4 << 20
#: Buckets of the table; Spark has a limit of 100,000.
MOST = 50_000


def parts_of(docs: DataFrame) -> int:
    """Buckets of docs' shard table; with fewer than a shuffle has partitions, joins would deal the texts anew."""
    return max(1, min(MOST, max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def shards(docs: DataFrame, size: int = 2_000_000, parts: int | None = None) -> tuple[DataFrame, int]:
    """The shard table, and the number of bytes in it. A text longer than `size` bytes is a shard of its own.

    Each partition of docs makes shards of its own rows, all in one bucket: texts aren't dealt anew.
    """
    spark = docs.sparkSession
    # rows of a megabyte and more: a few of them at a time between Spark and its workers, for what this session runs
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = parts or parts_of(docs)

    def pack(batches):
        from pyspark import TaskContext

        number = numbered(TaskContext.get().partitionId(), parts)
        held: list[tuple[pa.Array, pa.Array]] = []
        held_bytes = 0

        def row():
            nonlocal held, held_bytes
            ids = pa.concat_arrays([h[0] for h in held])
            buf, offsets = tb.text_bytes(pa.concat_arrays([h[1].cast(pa.large_string()) for h in held]))
            nulls = np.asarray(ids.is_null())
            out = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), np.packbits(nulls), offsets.astype("<i8"), buf]
            held, held_bytes = [], 0
            return pa.RecordBatch.from_arrays([pa.array([next(number)]), *(pa.array([x.tobytes()], pa.binary()) for x in out)], names=list(NAMES))

        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            _, offsets = tb.text_bytes(text)
            begun = 0
            while begun < len(ids):
                end = int(np.searchsorted(offsets, offsets[begun] + size - held_bytes, "right")) - 1
                if end <= begun and not held:
                    end = begun + 1
                if end > begun:
                    held.append((ids.slice(begun, end - begun), text.slice(begun, end - begun)))
                    held_bytes += int(offsets[end] - offsets[begun])
                if end < len(ids):
                    yield row()
                begun = max(begun, end)
        if held:
            yield row()

    name, where = storage.table(spark, "shards")
    docs.mapInArrow(pack, "shard long, ids binary, nulls binary, ends binary, text binary").write.bucketBy(parts, "shard").option("path", where).saveAsTable(name)
    return spark.table(name), int(total)


def bucket_of(number: np.ndarray, parts: int) -> np.ndarray:
    """Spark's bucket of a long: Murmur3 of its two halves with seed 42."""
    with np.errstate(over="ignore"):
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        h = np.full(len(number), 42, np.uint32)
        for half in (number.astype(np.uint64).astype(np.uint32), (number.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)):
            h = turn(h ^ turn(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % parts


def numbered(task: int, parts: int):
    """Shard numbers of a task: all of them fall in the bucket of the task's own number, so it writes one file."""
    at = 0
    while True:
        some = (task << 32) + np.arange(at, at + 4096)
        yield from some[bucket_of(some, parts) == task % parts].tolist()
        at += 4096


class Shard:
    """One row of the table, perhaps without the texts. order: a number for each document's id, null first; rank: the same without gaps."""

    def __init__(self, row: dict) -> None:
        self.number = row["shard"]
        ids = np.frombuffer(row["ids"], "<i8")
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8))[: len(ids)].astype(bool)
        self.ids, self.offsets, self.buf = ids, np.frombuffer(row.get("ends", b""), "<i8"), np.frombuffer(row.get("text", b""), np.uint8)
        above = ids.astype(np.uint64) ^ np.uint64(1 << 63)
        self.order = np.where(self.nulls, np.uint64(0), np.maximum(above, above + np.uint64(1)))
        self.rank = np.unique(self.order, return_inverse=True)[1]

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, mask=self.nulls)


def give_back() -> None:
    """What a worker has freed, to the machine: its allocators would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def squeeze(data: bytes, level: int = 1) -> bytes:
    """Its length, then the bytes compressed: closer than a shuffle does it."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def spread(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, "zstd", asbytes=True) if n else b""


def each(table: DataFrame, use: Callable[[Shard, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """use(shard, row) for every row, one shard in memory at a time."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield from use(Shard(row), row)
                del row
                give_back()

    return table.mapInArrow(run, schema)


def stretches(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each stretch of one bucket; they are sorted."""
    if not len(bucket):
        return []
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[at].tolist(), at.tolist(), np.append(at[1:], len(bucket)).tolist(), strict=True))


def runs(number: int, bucket: np.ndarray, pack: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """A row of RUN for each stretch; pack(begin, end) gives its bytes."""
    found = stretches(bucket)
    return pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array([b for b, _, _ in found], pa.int64()), pa.array([squeeze(pack(a, e)) for _, a, e in found], pa.binary())], names=["shard", "bucket", "run"])


def answer(sent: DataFrame, reduce: Callable[[list[bytes], list[int]], list[bytes]], name: str, parts: int | None = None) -> DataFrame:
    """shard, `name`: the answers to a shard's runs. reduce(runs, shards) answers the runs of one bucket.

    A shard can send itself a row, with the bucket -1 - shard: it comes back as it is. With `parts`, the shard table's
    own, the answers are dealt to shards once and kept in that many buckets, so no later join deals them again.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")
        if bucket[0].as_py() < 0:
            return table.select(["shard", "bucket", "run"])
        said = reduce([spread(x) for x in table.column("run").to_pylist()], table.column("shard").to_pylist())
        give_back()
        return pa.table({"shard": table.column("shard"), "bucket": bucket, "run": pa.array(said, pa.binary())})

    spark = sent.sparkSession
    back = sent.groupBy("bucket").applyInArrow(run, RUN)
    with storage.shuffles_dropped(spark):
        if not parts:
            back = storage.keep(back, name)
        by_shard = (back.repartition(parts, "shard") if parts else back).groupBy("shard").agg(F.collect_list(F.struct("bucket", "run")).alias(name))
        if not parts:
            return by_shard
        called, where = storage.table(spark, name)
        by_shard.write.bucketBy(parts, "shard").option("path", where).saveAsTable(called)
        return spark.table(called)


def own(number: int, state: bytes) -> pa.RecordBatch:
    """The row that a shard sends itself."""
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1 - number]), pa.array([state], pa.binary())], names=["shard", "bucket", "run"])


def answers(row: dict, name: str) -> dict[int, bytes]:
    return {r["bucket"]: r["run"] for r in row[name] or ()}


def bits(said: dict[int, bytes], bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits of all records in order, count[i] for the i-th, whose buckets are given and sorted."""
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(ends[-1]), bool)
    for b, a, e in stretches(bucket):
        out[ends[a] : ends[e]] = np.unpackbits(np.frombuffer(said[b], np.uint8))[: ends[e] - ends[a]]
    return out


# ---- strings of several windows ---------------------------------------------------------------------------------------
class Strings:
    """Stretches of elements, `width` bytes each, that hold windows of `window` elements: what shards compare at last.

    A record is the stretch itself, the order of its document, the place of its anchor in it (the `key` elements from
    there on tell whether two stretches can share a window; 255: only equal ones do), and how many windows it has.
    """

    def __init__(self, window: int, width: int, key: int, by_shard: bool) -> None:
        self.window, self.width, self.key, self.by_shard = window, width, key, by_shard

    def pack(self, order: np.ndarray, place: np.ndarray, count: np.ndarray, start: np.ndarray, data: np.ndarray) -> Callable[[int, int], bytes]:
        """start: of each stretch, in elements of data (bytes)."""

        def run(a: int, e: int) -> bytes:
            at = tb.row_ranges(start[a:e] * self.width, (count[a:e] + self.window - 1) * self.width)
            return np.int64(e - a).tobytes() + order[a:e].astype("<u8").tobytes() + place[a:e].astype(np.uint8).tobytes() + count[a:e].astype("<u2").tobytes() + data[at].tobytes()

        return run

    def reduce(self, sent: list[bytes], number: list[int]) -> list[bytes]:
        """A bit for each window of each record: an earlier document has it, in the order of (order, shard) if by_shard."""
        orders, places, counts, texts, of = [], [], [], [], []
        for k, x in enumerate(sent):
            n = int(np.frombuffer(x, np.int64, 1)[0])
            orders.append(np.frombuffer(x, "<u8", n, 8))
            places.append(np.frombuffer(x, np.uint8, n, 8 + 8 * n))
            counts.append(np.frombuffer(x, "<u2", n, 8 + 9 * n))
            texts.append(np.frombuffer(x, np.uint8, -1, 8 + 11 * n))
            of.append(np.full(n, k))
        order, place, of = np.concatenate(orders), np.concatenate(places).astype(np.int64), np.concatenate(of)
        count = np.concatenate(counts).astype(np.int64)
        data = np.concatenate(texts)
        size = (count + self.window - 1) * self.width
        start = np.cumsum(size) - size
        by = np.array(number)[of] if self.by_shard else np.zeros(len(of), np.int64)
        rank = _dense(order, by)
        bit_at = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), bool)
        for some in self._apart(data, start, size, place):
            if len(some) == len(start):
                out = self._seen(data, start, size, place, count, rank, of)
            else:
                part = data[tb.row_ranges(start[some], size[some])]
                seen = self._seen(part, np.cumsum(size[some]) - size[some], size[some], place[some], count[some], rank[some], of[some])
                out[tb.row_ranges(bit_at[some], count[some])] = seen
        ends = np.append(bit_at, len(out))
        edge = np.searchsorted(of, np.arange(len(sent) + 1))
        return [np.packbits(out[ends[edge[k]] : ends[edge[k + 1]]]).tobytes() for k in range(len(sent))]

    def _apart(self, data, start, size, place) -> list[np.ndarray]:
        """The records in groups of about AT_ONCE bytes that share no window: by their anchors, or whole strings if alone."""
        parts = -(-int(size.sum()) // AT_ONCE)
        if parts < 2:
            return [np.arange(len(start))]
        alone = place == 255
        lead = start + np.where(alone, 0, place) * self.width
        group = (tb.segments(data, lead, lead + np.where(alone, size, self.key * self.width)) >> np.uint64(20)) % np.uint64(parts)
        return [x for x in np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group.astype(np.int64), minlength=parts))[:-1]) if len(x)]

    def _seen(self, data, start, size, place, count, rank, of) -> np.ndarray:
        """Of every window of every record: an earlier rank has it. data holds the stretches end to end."""
        # equal stretches, from sorted runs merged by binary search
        string = self._merged(data, start, size, place, of)
        least = np.full(int(string.max(initial=-1)) + 1, int(rank.max(initial=0)) + 1)
        np.minimum.at(least, string, rank)
        whole = least[string] < rank
        # one of each that can share windows with another: those with an anchor that has several
        first = np.unique(string, return_index=True)[1]
        alone = place[first] == 255
        lead = start[first] + np.where(alone, 0, place[first]) * self.width
        anchor = np.where(alone, np.arange(len(first), dtype=np.uint64), tb.segments(data, lead, lead + self.key * self.width))
        _, inverse, times = np.unique(anchor, return_inverse=True, return_counts=True)
        contested = first[(times[inverse] > 1) & ~alone]
        bit_at = np.cumsum(count) - count
        out = np.repeat(whole, count)
        if len(contested):
            at = tb.row_ranges(np.zeros(len(contested), np.int64), count[contested])
            mine = np.repeat(contested, count[contested])
            seen = self._windows(data, start[mine] + at * self.width, least[string[mine]])
            # to every record of the string: what the others' windows say
            told = np.zeros(len(first) + 1, np.int64)
            told[string[contested]] = np.cumsum(count[contested]) - count[contested] + 1
            rows = np.flatnonzero((told[string] > 0) & ~whole)
            out[tb.row_ranges(bit_at[rows], count[rows])] = seen[tb.row_ranges(told[string[rows]] - 1, count[rows])]
        return out

    def _merged(self, data, start, size, place, of) -> np.ndarray:
        """A number for each stretch, equal for equal ones: each run's distinct stretches in order, runs merged two by two,
        each one's places in the other found by binary search over the bytes."""
        wide = int(size.max(initial=0)) + 2
        rows = np.zeros((len(start), wide), np.uint8)
        for at in range(0, len(start), GATHER):  # data holds the stretches end to end
            some = slice(at, at + GATHER)
            inside = np.arange(wide - 2) < size[some, None]
            rows[some, :-2][inside] = data[start[at] : start[some][-1] + size[some][-1]]
        rows[:, -2] = place
        rows[:, -1] = 1 + (size % 255)  # never 0, which a string would lose at its end
        text = rows.view(f"S{wide}")[:, 0]
        # runs follow one another; short ones are sorted together, so that the work doesn't grow with their number
        edge = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(1, np.int64)
        edge = np.append(edge[np.unique(edge // GATHER, return_index=True)[1]], len(of))
        merged = [np.unique(text[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        while len(merged) > 1:
            merged = [_union(*merged[k : k + 2]) for k in range(0, len(merged), 2)]
        return np.searchsorted(merged[0], text)

    def _windows(self, data: np.ndarray, start: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Whether each window's bytes also come with a lower rank."""
        wide = self.window * self.width
        rows = np.ones((len(start), wide + 1), np.uint8)
        rows[:, :wide] = np.lib.stride_tricks.sliding_window_view(data, wide)[start]
        _, inverse = np.unique(rows.view(f"S{wide + 1}")[:, 0], return_inverse=True)
        least = np.full(int(inverse.max()) + 1, int(rank.max()) + 1)
        np.minimum.at(least, inverse, rank)
        return least[inverse] < rank


def _union(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    if b is None:
        return a
    at = np.searchsorted(a, b)
    new = np.ones(len(b), bool)
    inside = at < len(a)
    new[inside] = a[at[inside]] != b[inside]
    return np.insert(a, at[new], b[new])


def _dense(order: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Ranks of (order, by) without gaps."""
    if not len(order):
        return np.zeros(0, np.int64)
    at = np.lexsort([by, order])
    new = np.append(False, (order[at][1:] != order[at][:-1]) | (by[at][1:] != by[at][:-1]))
    out = np.empty(len(order), np.int64)
    out[at] = np.cumsum(new)
    return out
