"""Suffix-array dedup: removes bytes covered by a string of `window` bytes that also starts in an earlier document.

Each shard's text has a suffix array by Larsson-Sadakane refinement: suffixes are grouped by their first bytes, and groups
of several are split by the rank of what follows, twice as far each time, until DEPTH bytes are settled. Kasai's
common prefixes of neighbours, carried from each position to the next, tell where `window` bytes agree: such neighbours
are one string. A string that an earlier document of the shard has is a repeat.

Between shards, what is left travels: the other strings of a shard, as stretches of text in the order of the suffixes, so
that neighbouring strings share their bytes. Each goes to the bucket of its anchor (its least hashed gram), where the sorted
runs of all shards are merged by binary search over the bytes, and each string's earliest document is found. Equal bytes
alone decide. Beforehand one exchange of the anchors' hashes tells which of them a second shard has at all: strings
without such an anchor stay where they are. An anchor that very many stretches have sends its strings one by one, each
to a bucket of its own, so a passage that a third of all documents share isn't one task's.

Texts are bytes of UTF-8, so what is left may cut characters: `kept` is binary. Null or empty texts have no bytes.
Rows that share a doc_id are one document in this: none of them is earlier than another, whatever shards they are in.
Null doc_ids come first and count as one. An empty table gives an empty result; extra columns are ignored. A text is
held whole by one task, with its suffix array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards
from . import textbytes as tb

#: Stretches of one anchor, in all shards, from which on its strings travel one by one.
COMMON = 4096
#: Bytes of text for each bucket.
SHARE = 4 << 20
_PLACE = np.uint64((1 << 21) - 1)


def suffix_array(buf: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions sorted by the bytes from there to the end, or by the first `depth` of them at least."""
    n, h = len(buf), 5
    if not n:
        return np.zeros(0, np.int64)
    small = n <= int(_PLACE) + 1
    head = tb.eights(buf)[:n].byteswap()
    head >>= np.uint64(24)  # five bytes
    if small:  # the position in the low bits: sorting numbers is several times faster than sorting places
        head <<= np.uint64(21)
        head |= np.arange(n, dtype=np.uint64)
        head.sort()
        order = (head & _PLACE).astype(np.int32)
        head >>= np.uint64(21)
    else:
        order = np.argsort(head, kind="stable")
        head = head[order]
    new = np.append(True, head[1:] != head[:-1])
    del head
    # beyond the end: below all ranks, and the lower the further
    beyond = max(h, n if depth is None else depth)
    rank = np.empty(n + beyond, np.int32)
    rank[n:] = -1 - np.arange(beyond)
    at = np.flatnonzero(new)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    while depth is None or h < depth:
        # members of groups that aren't single, by group and by the rank h bytes on
        places = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(places):
            break
        i = order[places].astype(np.int64)
        follow = (rank[i + h] + (h + 1)).astype(np.uint64)
        group = rank[i].astype(np.uint64)
        if small:
            group <<= np.uint64(22)
            group |= follow
            group <<= np.uint64(21)
            group |= i.astype(np.uint64)
            group.sort()
            i = (group & _PLACE).astype(np.int64)
            group >>= np.uint64(21)
            key = group
        else:
            by = np.lexsort([follow, group])
            i, key = i[by], group[by] << np.uint64(32) | follow[by]
        order[places] = i
        if depth is not None and 2 * h >= depth:  # no round asks for ranks any more
            break
        fresh = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(fresh)
        rank[i] = np.repeat(places[first], np.diff(np.append(first, len(i))))
        new[places] = fresh
        h *= 2
    return order


def common_prefixes(buf: np.ndarray, order: np.ndarray, most: int, lane: int = 32) -> np.ndarray:
    """For each place of the array, the common prefix with the place before, up to `most`."""
    n = len(buf)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    words = tb.eights(buf)
    by_position = np.zeros(n, np.int16)
    start = np.arange(0, n, lane)
    length = np.zeros(len(start), np.int64)
    for t in range(lane):  # in each lane, a prefix loses one byte at most from one position to the next
        i = start + t
        if not len(i):
            break
        if i[-1] >= n:
            inside = i < n
            i, start, length = i[inside], start[inside], length[inside]
        j = before[i].astype(np.int64)
        length = np.where(j >= 0, np.maximum(length - 1, 0), 0)
        going = np.flatnonzero(j >= 0)
        while len(going):
            at = length[going]
            differ = words[np.minimum(i[going] + at, n)] ^ words[np.minimum(j[going] + at, n)]
            # bytes from the lowest on that agree: eight for each bit below the lowest that differs
            same = np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3
            length[going] = at + same
            going = going[(same == 8) & (at + same < most)]
        # beyond the end nothing agrees
        length = np.minimum(np.minimum(length, most), n - np.maximum(i, j))
        by_position[i] = length
    return by_position[order]


def grams(buf: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from every place that has so many; n is a multiple of eight."""
    words = tb.eights(buf)
    m = max(0, len(buf) - n + 1)
    h = np.full(m, n, np.uint64)
    for k in range(0, n, 8):
        h ^= words[k : k + m]
        h *= tb.BASE
        h ^= h >> np.uint64(32)
    return h


def anchors(buf: np.ndarray, start: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at `start`: where the gram with the least hash is; and the hashes of all grams."""
    h = grams(buf, gram)
    bits = np.uint64(max(1, len(buf).bit_length()))
    least = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    room, size = window - gram + 1, 1
    while size * 2 <= room:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if room > size:
        least = np.minimum(least[: size - room], least[room - size :])
    at = (least[start] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    return at, h


def windows(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window's start, and its document."""
    n = np.maximum(0, np.diff(offsets) - window + 1)
    return tb.row_ranges(offsets[:-1], n), np.repeat(np.arange(len(n)), n)


def strings_of(buf: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and a number for each of its places: equal where `window` bytes agree."""
    order = suffix_array(buf, window)
    equal = common_prefixes(buf, order, window) >= window
    # suffixes that agree beyond the depth of the sort come in any order, where a carried prefix can be too long
    at, words = np.flatnonzero(equal), tb.eights(buf)
    for k in [*range(0, window - 7, 8), window - 8]:
        at = at[words[order[at].astype(np.int64) + k] == words[order[at - 1].astype(np.int64) + k]]
    equal[:] = False
    equal[at] = True
    return order, np.cumsum(~equal)


def cover(start: np.ndarray, window: int, n: int) -> np.ndarray:
    """The places of windows at `start`."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + window, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 24, size: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and removed (stretches of bytes)."""
    table, total = shards.shards(docs, size)
    buckets = max(1, -(-total // SHARE))
    strings = shards.Strings(window, 1, gram, by_shard=False)

    def tell(shard, row):
        """The distinct anchors, and how many stretches each has, up to 255."""
        start, doc = windows(shard.offsets, window)
        if not len(start):
            return
        at, h = anchors(shard.buf, start, window, gram)
        h = tb.mix(h[at[np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))]])
        h, n = np.unique(h, return_counts=True)
        by = np.argsort(_bucket(h, buckets), kind="stable")
        h, n = h[by], np.minimum(n[by], 255).astype(np.uint8)
        bucket, low = _bucket(h, buckets), h.astype("<u4")  # half of a hash will do within a bucket: it only filters
        yield shards.runs(shard.number, bucket, lambda a, e: low[a:e].tobytes() + n[a:e].tobytes())

    def count(sent, _):
        """Two bits for each anchor: another shard has it; very many stretches have it."""
        n = [len(x) // 5 for x in sent]
        h = np.concatenate([np.frombuffer(x, "<u4", k) for x, k in zip(sent, n, strict=True)])
        times = np.concatenate([np.frombuffer(x, np.uint8, k, 4 * k) for x, k in zip(sent, n, strict=True)])
        _, inverse, held = np.unique(h, return_inverse=True, return_counts=True)
        both = np.column_stack([held[inverse] > 1, np.bincount(inverse, times)[inverse] > COMMON])
        return [np.packbits(x).tobytes() for x in np.split(both, np.cumsum(n)[:-1])]

    told = shards.answer(shards.each(table.select(*shards.NAMES), tell, shards.RUN), count, "anchors")

    def sort(shard, row):
        """Repeats within the shard, and the stretches whose strings another shard may have. The shard's own row says which."""
        start, doc = windows(shard.offsets, window)
        if not len(start):
            return
        order, number = strings_of(shard.buf, window)
        rank = np.full(len(shard.buf), np.iinfo(np.int32).max, np.int32)
        rank[start] = shard.rank[doc]
        least = np.minimum.reduceat(rank[order], np.flatnonzero(np.append(True, number[1:] != number[:-1])))
        of = np.empty(len(order), np.int32)
        of[order] = number - number[0]
        own = of[start]
        again = least[own] < rank[start]
        del order, number, least, rank, of
        at, h = anchors(shard.buf, start, window, gram)
        lead = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # once for each anchor
        mixed = tb.mix(h[at[lead]])
        one, inverse = np.unique(mixed, return_inverse=True)
        by = np.argsort(_bucket(one, buckets), kind="stable")
        bit = shards.bits(shards.answers(row, "anchors"), _bucket(one[by], buckets), np.full(len(one), 2)).reshape(-1, 2)
        flags = np.empty_like(bit)
        flags[by] = bit
        many = np.diff(np.append(lead, len(at)))
        shared, common = (np.repeat(f, many) for f in np.ascontiguousarray(flags[inverse].T))
        open_ = np.flatnonzero(shared & ~again)
        if len(open_):
            # neighbouring windows of one anchor are a stretch; those of common anchors stay apart
            new = np.append(True, (start[open_][1:] != start[open_][:-1] + 1) | (at[open_][1:] != at[open_][:-1]) | common[open_][1:])
            low = open_[new]
            n = np.diff(np.append(np.flatnonzero(new), len(open_)))
            # equal stretches begin and end with equal strings
            name = own[low].astype(np.uint64) << np.uint64(36) | own[low + n - 1].astype(np.uint64) << np.uint64(8) | n.astype(np.uint64)
            _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
            lead, n = low[first], n[first]
            bucket = _bucket(np.where(common[lead], tb.segments(shard.buf, start[lead], start[lead] + window), tb.mix(h[at[lead]])), buckets)
            by = np.lexsort([own[lead], bucket])  # in the order of suffixes
            record = np.empty(len(by), np.int64)
            record[by] = np.arange(len(by))
            record, bucket, n, lead = record[inverse], bucket[by], n[by], lead[by]
            anchor = np.where(common[lead], 255, at[lead] - start[lead])
            pack = strings.pack(shard.order[doc[lead]], anchor, n, start[lead], shard.buf)
            yield shards.runs(shard.number, bucket, pack)
        else:
            bucket = n = low = record = np.zeros(0, np.int64)
        state = [np.packbits(cover(start[again], window, len(shard.buf))), bucket.astype("<i8"), n.astype("<u2"), start[low].astype("<u4"), record.astype("<u4")]
        sizes = np.array([len(bucket), len(low)], np.int64)
        yield shards.own(shard.number, sizes.tobytes() + b"".join(x.tobytes() for x in state))

    sent = shards.each(table.join(told, "shard", "left").select(*shards.NAMES, "anchors"), sort, shards.RUN)
    found = shards.answer(sent, strings.reduce, "found")

    def remove(shard, row):
        n = len(shard.buf)
        covered = np.zeros(n, bool)
        said = shards.answers(row, "found")
        if x := said.get(-1 - shard.number):
            records, stretches = np.frombuffer(x, np.int64, 2)
            at = 16
            parts = []
            for kind, many in ((np.uint8, -(-n // 8)), ("<i8", records), ("<u2", records), ("<u4", stretches), ("<u4", stretches)):
                parts.append(np.frombuffer(x, kind, int(many), at))
                at += parts[-1].nbytes
            covered = np.unpackbits(parts[0])[:n].astype(bool)
            count, low, record = (p.astype(np.int64) for p in parts[2:])
            bit = shards.bits(said, parts[1], count)
            first = (np.cumsum(count) - count)[record]
            many = count[record]
            start = tb.row_ranges(low, many)
            covered |= cover(start[bit[tb.row_ranges(first, many)]], window, n)
        yield _output(shard, covered)

    joined = table.join(found, "shard", "left").select(*shards.NAMES, "found")
    return shards.each(joined, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start: long, end: long>>")


def _output(shard: shards.Shard, covered: np.ndarray) -> pa.RecordBatch:
    kept, removed = [], []
    for a, b in zip(shard.offsets.tolist(), shard.offsets[1:].tolist(), strict=False):
        own = covered[a:b]
        kept.append(shard.buf[a:b][~own].tobytes())
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        removed.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
    gone = [sum(r["end"] - r["start"] for r in x) for x in removed]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([shard.doc_ids(), pa.array(np.diff(shard.offsets)), pa.array(gone, pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])


def repeat_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
