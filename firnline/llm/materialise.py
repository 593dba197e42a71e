"""Training-order materialisation: token sequences in a random order that a key fixes, in files of fixed-stride records.

The ids of all documents, each closed, run on through the sequences of a partition. A keyed Feistel permutation with
cycle-walking sends each sequence's number to its slot among all of them, so order needs no sort and no stored map. Slots
are dealt by range to shard files. A record is a header (slot, doc_id of the first id, its place in that document, ids
used; little-endian) and `length` ids, padded with 0, then one line feed: record k of a shard starts at k * stride.

Texts are encoded once: the sequences of each partition go, compressed, to a table of the shared folder that holds how
many came before, and are numbered from there once all are counted. The table goes when the shards are written.

Null or empty texts give their closing id alone; null doc_ids are kept as null; repeated rows are written as often as
they come. An empty table gives no shards and an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shards as sh
from . import storage, tokens
from . import textbytes as tb

HEADER = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("start", "<u4"), ("used", "<u4")])
_NONE = -(1 << 63)
#: Sequences in a row of the table between.
HELD = 512


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0 .. n - 1, fixed by the key; values that leave the range walk on until they are back."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = tb.mix(np.arange(1, rounds + 1, dtype=np.uint64) * tb.BASE + np.uint64(key & (2**64 - 1)))
    x = x.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (tb.mix(right ^ k) & mask)
        x[todo] = left << shift | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def _sequences(batches, path: str, length: int, close: int):
    """(first doc_id, its place, ids) of each sequence of a partition, in order."""
    encode = tokens.encoder(path)
    held: list[np.ndarray] = []
    docs: list[tuple[int | None, int, int]] = []  # doc_id, place of the first id held, ids held
    size = 0

    def take(n: int):
        nonlocal size, held
        ids = np.concatenate(held) if len(held) != 1 else held[0]
        first, place = docs[0][0], docs[0][1]
        out, held = ids[:n], [ids[n:]]
        size -= len(out)
        n = len(out)
        while docs and n:
            doc, at, count = docs[0]
            used = min(n, count)
            n -= used
            if used == count:
                docs.pop(0)
            else:
                docs[0] = (doc, at + used, count - used)
        return first, place, out

    for batch in batches:
        ids_of = batch.column(0).to_pylist()
        for lo in range(0, len(ids_of), 512):
            ids, ends = encode.encode(batch.column(1).slice(lo, 512))
            for k in range(len(ends) - 1):
                own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(close))
                held.append(own)
                docs.append((ids_of[lo + k], 0, len(own)))
                size += len(own)
                if size >= 64 * length or k == len(ends) - 2:
                    while size >= length:
                        yield take(length)
    if size:
        yield take(length)


def materialise(docs: DataFrame, where: str, key: int = 1, length: int = 2048, shard: int = 4096, tokenizer: str | None = None, close: int = 1) -> int:
    """Writes the shards of all sequences below `where`; returns their number."""
    path, spark = tokenizer or tokens.default_path(), docs.sparkSession
    # rows of megabytes: a few of them at a time between Spark and its workers
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    from tokenizers import Tokenizer

    wide = np.dtype("<u4" if Tokenizer.from_file(path).get_vocab_size() > 1 << 16 else "<u2")

    def encode(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        heads, bodies = [], []

        def row():
            nonlocal before, heads, bodies
            body = np.zeros((len(bodies), length), wide)
            for mine, ids in zip(body, bodies, strict=True):
                mine[: len(ids)] = ids
            out = [part, before, len(heads), np.array(heads, HEADER).tobytes(), sh.squeeze(body.tobytes(), 4)]
            before += len(heads)
            heads, bodies = [], []
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=["part", "before", "n", "heads", "ids"])

        for doc, place, ids in _sequences(batches, path, length, close):
            heads.append((0, _NONE if doc is None else doc, place, len(ids)))
            bodies.append(ids)
            if len(heads) == HELD:
                yield row()
        if heads:
            yield row()

    mark, held = storage.mark(), storage.path(spark, "encoded")
    made = docs.select("doc_id", "text").mapInArrow(encode, "part long, before long, n long, heads binary, ids binary")
    made.write.option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.size", 8 << 20).parquet(held)
    made = spark.read.schema(made.schema).parquet(held)
    first, total = {}, 0
    for p, n in sorted(made.groupBy("part").agg(F.sum("n")).collect()):  # one for each partition
        first[p] = total
        total += n
    if not total:
        storage.sweep(spark, mark)
        return 0
    state = spark.sparkContext.broadcast(first)
    shards = -(-total // shard)

    def write(batches):
        for batch in batches:
            for part, before, n, heads, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heads = np.frombuffer(heads, HEADER).copy()
                heads["slot"] = slots = feistel(state.value[part] + before + np.arange(n), total, key)
                body = np.frombuffer(sh.spread(ids), np.uint8).reshape(n, -1)
                records = np.concatenate([heads.view(np.uint8).reshape(n, -1), body], 1)
                ends = np.arange(n + 1, dtype=np.int32) * np.int32(records.shape[1])
                records = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(records)])
                yield pa.RecordBatch.from_arrays([pa.array(slots // shard), pa.array(slots), records], names=["shard", "slot", "record"])

    made = made.mapInArrow(write, "shard long, slot long, record binary")
    tasks = min(shards, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # shards in order over the tasks: the ranges are known, so nothing has to be sampled
    dealt = made.repartitionById(tasks, (F.col("shard") * tasks / shards).cast("int")).sortWithinPartitions("shard", "slot")
    dealt.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(where)
    storage.sweep(spark, mark)
    return total


def read(spark: SparkSession, where: str, length: int = 2048, wide: str = "<u2", from_slot: int = 0, shard: int = 4096) -> DataFrame:
    """shard, slot, offset, doc_id, doc_start, n_tokens, ids: records in order within each shard file, from a slot on."""
    stride = HEADER.itemsize + length * np.dtype(wide).itemsize + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(where).where(F.col("shard") >= from_slot // shard)

    def parse(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_buffer()
                for lo in range(0, len(data), 512 * stride):
                    part = np.frombuffer(data[lo : lo + 512 * stride], np.uint8).reshape(-1, stride)
                    heads = np.ascontiguousarray(part[:, : HEADER.itemsize]).view(HEADER)[:, 0]
                    keep = heads["slot"] >= from_slot
                    at, part, heads = lo + np.flatnonzero(keep) * stride, part[keep], heads[keep]
                    ids = np.ascontiguousarray(part[:, HEADER.itemsize : -1])
                    doc = pa.array(heads["doc_id"].astype(np.int64), mask=heads["doc_id"] == _NONE)
                    n = heads["used"].astype(np.int64)
                    raw = [x[: k * np.dtype(wide).itemsize].tobytes() for x, k in zip(ids, n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), int(number)), pa.int64()), pa.array(heads["slot"].astype(np.int64)), pa.array(at), doc, pa.array(heads["start"].astype(np.int64)), pa.array(n), pa.array(raw, pa.binary())], names=["shard", "slot", "offset", "doc_id", "doc_start", "n_tokens", "ids"])

    return files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(parse, "shard long, slot long, offset long, doc_id long, doc_start long, n_tokens long, ids binary")


def manifest(docs: DataFrame, key: int = 1) -> DataFrame:
    """Materialises docs in the shared folder and reads the records back: their digests, one row for each sequence."""
    spark = docs.sparkSession
    where = storage.path(spark, "sequences")
    if not materialise(docs, where, key):
        return spark.createDataFrame([], "shard long, slot long, offset long, doc_id long, doc_start long, n_tokens long, ids_crc32 long")
    return read(spark, where).select("shard", "slot", "offset", "doc_id", "doc_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
