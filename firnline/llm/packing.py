"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Whole stretches of `length` ids fill sequences of their own; the rest of each document is a piece. Rows are dealt evenly
to partitions, equal ones as well, and packed there in the order of a hash of their content, `group` pieces at a time,
so groups are random and no group grows with the input. Pieces leave a task BYTES at a time. The pieces of the emptiest sequences of a group are cut to fill the gaps of the
others. A sequence whose size is a power of two needs no padding.

Null or empty texts have one id, the closing one. Repeated rows are packed each on its own; ties keep hash order.
An empty table has no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: Ids held before a batch of pieces leaves.
BYTES = 4 << 20
#: Rows and bytes of text that a partition is worth; bytes that it has at most.
ROWS, PART, MOST = 1024, 8 << 20, 128 << 20


class Tournament:
    """Free room of bins; `place` gives the first bin with enough room, a new one if none has."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> list[int]:
    """The bin of each size; every size is at most `room`."""
    bins, tree = [0] * len(sizes), Tournament(max(1, len(sizes)), room)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.place(sizes[i])
    return bins


def pack_group(sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (piece, start, length): first-fit decreasing, then the emptiest bins' pieces are cut into the gaps."""
    bins: dict[int, list] = {}
    for i, b in enumerate(first_fit_decreasing(sizes, room)):
        bins.setdefault(b, []).append((i, 0, sizes[i]))
    order = sorted(bins.values(), key=lambda b: sum(x[2] for x in b))
    used = [sum(x[2] for x in b) for b in order]
    low, high = 0, len(order) - 1
    while low < high:
        if used[high] == room:
            high -= 1
            continue
        if not order[low]:
            low += 1
            continue
        piece, start, size = order[low].pop()
        take = min(size, room - used[high])
        order[high].append((piece, start, take))
        used[high] += take
        used[low] -= take
        if take < size:
            order[low].append((piece, start + take, size - take))
    return [b for b in order if b]


def partitions(docs: DataFrame) -> int:
    """As many as a shuffle has, but of ROWS rows or PART bytes at least, and of MOST bytes at most."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    held = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(held, max(rows // ROWS, size // PART)), -(-size // MOST))


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, group: int = 4096, close: int = 1) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset."""
    path = tokenizer or tokens.default_path()

    def run(batches):
        from pyspark import TaskContext

        encode = tokens.encoder(path)
        base, made = (TaskContext.get().partitionId() << 40), 0
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []
        rest: list[tuple] = []
        held = 0

        def put(row):
            nonlocal held
            rows.append(row)
            held += len(row[3]) + 64

        def flush():
            nonlocal rest, made
            for b in pack_group([len(r[2]) for r in rest], length):
                offset = 0
                for i, s, n in b:
                    doc, at, ids, total = rest[i]
                    put((doc, at + s, n, ids[s : s + n].tobytes(), total, base + made, offset))
                    offset += n
                made += 1
            rest = []

        def out():
            nonlocal rows, held
            held = 0
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo in range(0, len(doc_ids), 256):
                part = batch.column(1).slice(lo, 256)
                ids, ends = encode.encode(part)
                ids = ids.astype("<u4")
                for k in range(len(part)):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.array([close], "<u4"))
                    whole = len(own) // length * length
                    for at in range(0, whole, length):
                        put((doc_ids[lo + k], at, length, own[at : at + length].tobytes(), len(own), base + made, 0))
                        made += 1
                    if whole < len(own):
                        rest.append((doc_ids[lo + k], whole, own[whole:].copy(), len(own)))
                    if len(rest) >= group:
                        flush()
                    if held >= BYTES:
                        yield out()
        flush()
        yield out()

    # round robin over sorted rows: equal rows aren't one task's, and a lost task deals the same rows again. So many
    # partitions, not as many as a session's advised size makes: each ends with a sequence that isn't full
    dealt = docs.select("doc_id", "text").repartition(partitions(docs)).sortWithinPartitions(F.xxhash64("doc_id", "text"))
    return dealt.mapInArrow(run, SCHEMA)


def piece_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
