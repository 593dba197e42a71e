"""Substring dedup by recompression: removes words covered by a window whose words start earlier in the corpus.

Names are global: in each round every shard sends what it wants named, once, and Spark reducers give equal things one
number and tell whether a second shard has them. Round 0 names words, by their bytes. Each later round folds runs of one
symbol, lets symbols fall into left and right ones by a bit of their name, and has every left symbol followed by a right
one named as a pair, runs with their lengths. Which symbols arise depends on nearby words only: each carries the stretch
of words that decides it, and equal windows share all symbols decided within them.

So a window can be in another shard only if all symbols decided within it are; one that holds a symbol of a single shard
is new there. The others are revealed by their anchor, the symbol of the highest round decided within them with the least
mixed name. Stretches of windows with one anchor go to the anchor's bucket as the numbers of their words, and there each
window is verified word by word against the other shards' (see shards.Strings). Within a shard, windows are named by
doubling from the words' numbers. Equal words alone decide; hashes only choose buckets and anchors.

An anchor that very many places have sends its windows one by one, each to a bucket of its own.

Null or empty texts have no words. Order is by doc_id, nulls first; rows that share a doc_id follow one another by shard
and place in it. Windows never cross rows. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards
from . import textbytes as tb
from .suffixes import cover, windows

ROUNDS = 3
#: Places of one symbol, in all shards, from which on its windows travel one by one.
COMMON = 4096
#: Bytes of text for each bucket, as every shard sends every bucket a row; bytes of a word's number.
SHARE, WIDTH = 8 << 20, 6


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """Numbers byte by byte, the lowest bytes of all first: what is 0 in all of them compresses to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def numbers(data: bytes, at: int, n: int, width: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8")[:, 0]


@dataclass
class Names:
    """Of a shard's distinct symbols: global number, whether a second shard has it, whether very many places have it."""

    number: np.ndarray
    shared: np.ndarray
    common: np.ndarray

    def add(self, other: Names) -> Names:
        return Names(*(np.concatenate([a, b]) for a, b in zip((self.number, self.shared, self.common), (other.number, other.shared, other.common), strict=True)))


@dataclass
class Symbols:
    """A round's symbols in order: which of the shard's, document, and the words [left, right) that decide it."""

    which: np.ndarray
    doc: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _mix(number: np.ndarray, count: np.ndarray, salt: int) -> np.ndarray:
    return tb.mix(tb.mix(number * tb.BASE + count.astype(np.uint64)) + np.uint64(salt))


def beside(s: Symbols, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far left the symbol before reaches, and how far right the one behind; at a document's edge, a word beyond it,
    which no window holds."""
    left, right = np.empty_like(s.left), np.empty_like(s.right)
    left[1:], right[:-1] = s.left[:-1], s.right[1:]
    # at the edges alone are documents looked up
    edge = np.flatnonzero(s.doc[1:] != s.doc[:-1])
    begin, end = np.append(0, edge + 1)[: len(left)], np.append(edge, len(left) - 1)[: len(left)]
    left[begin], right[end] = first[s.doc[begin]] - 1, first[s.doc[end] + 1] + 1
    return left, right


def fold(s: Symbols, first: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Runs of one symbol as one, and their lengths; deciding that a run ends takes the symbols on both sides."""
    new = np.ones(len(s.which), bool)
    new[1:] = (s.which[1:] != s.which[:-1]) | (s.doc[1:] != s.doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(new)) - 1
    left, right = beside(s, first)
    return Symbols(s.which[at], s.doc[at], left[at], right[last]), last - at + 1


def pair(s: Symbols, count: np.ndarray, names: Names, first: np.ndarray, salt: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Left symbols join the right ones behind them; only those that several shards have.

    Returns symbols whose `which` is that of the left one, and of each its right one (-1: none) as a place in s, and its
    own place in s.
    """
    # nearly all are runs of one: their bit is taken once for each name
    is_left = (_mix(names.number, np.ones(1, np.int64), salt) & np.uint64(1)).astype(bool)[s.which]
    many = np.flatnonzero(count > 1)
    is_left[many] = (_mix(names.number[s.which[many]], count[many], salt) & np.uint64(1)).astype(bool)
    live = names.shared[s.which]
    joins = np.zeros(len(s.which), bool)
    joins[:-1] = is_left[:-1] & ~is_left[1:] & live[:-1] & live[1:] & (s.doc[1:] == s.doc[:-1])
    keep = np.flatnonzero(~np.append(False, joins[:-1]))
    paired = joins[keep]
    after = np.where(paired, keep + 1, -1)
    left, right = beside(s, first)
    # a pair is decided by its two; a left symbol alone by what follows, a right one alone by what comes before; one of a
    # single shard by itself
    alone = ~paired & live[keep]
    lo = np.where(alone & ~is_left[keep], np.minimum(s.left[keep], left[keep]), s.left[keep])
    hi = np.where(paired, s.right[after], np.where(alone & is_left[keep], np.maximum(s.right[keep], right[keep]), s.right[keep]))
    return Symbols(s.which[keep], s.doc[keep], lo, hi), after, keep


# ---- what a shard wants named ------------------------------------------------------------------------------------------
class Wanted:
    """Distinct things, sorted by bucket: `pack` gives the bytes of a run of them, `inverse` where each place's thing is."""

    def __init__(self, bucket: np.ndarray, inverse: np.ndarray, pack) -> None:
        self.bucket, self.inverse, self.pack = bucket, inverse, pack


def answered(said: dict[int, bytes]) -> Names:
    """Of what a shard wanted, in its order: by bucket."""
    number, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for b in sorted(b for b in said if b >= 0):
        x, n = said[b], (len(said[b]) - 8) // 9
        buckets = int(np.frombuffer(x, np.int64, 1)[0])
        number.append(np.cumsum(numbers(x, 8, n)) * np.uint64(buckets) + np.uint64(b + 1))
        flags.append(np.frombuffer(x, np.uint8, n, 8 + 8 * n))
    flags = np.concatenate(flags)
    return Names(np.concatenate(number), (flags & 1) > 0, (flags & 2) > 0)


def _answer(index: np.ndarray, flags: np.ndarray, buckets: int) -> bytes:
    """Numbers within the bucket, which grow along a run, as differences."""
    return np.int64(buckets).tobytes() + planes(np.diff(index, prepend=0)) + flags.astype(np.uint8).tobytes()


def _answers(index: np.ndarray, times: np.ndarray, sizes: list[int], buckets: int) -> list[bytes]:
    """Of runs of `sizes` things, numbered by index and each there so many times: number, and what Names tells."""
    held, total = np.bincount(index), np.bincount(index, times)
    flags = (held > 1)[index] + 2 * (total > COMMON)[index]
    cuts = np.cumsum(sizes)[:-1]
    return [_answer(i, f, buckets) for i, f in zip(np.split(index, cuts), np.split(flags, cuts), strict=True)]


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each distinct word, by hash and then by bytes, and where each word is among them."""
    h, size = tb.segments(data, start, end), end - start
    order = np.argsort(h)
    new = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
    one, inverse = order[new], np.empty(len(h), np.int64)
    hashes, inverse[order] = h[one], np.cumsum(new) - 1
    lead = one[inverse]
    same = size[lead] == size
    equal = same.all() and tb.same(data, start[lead], start, size)
    if not equal:  # words of one hash that differ
        text = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        names = {k: i for i, k in enumerate(sorted({*zip(h.tolist(), text, strict=True)}))}
        inverse = np.array([names[k] for k in zip(h.tolist(), text, strict=True)])
        one = np.unique(inverse, return_index=True)[1]
        hashes = h[one]
    return hashes, one, inverse


def words_wanted(shard: shards.Shard, start: np.ndarray, end: np.ndarray, buckets: int) -> Wanted:
    h, one, inverse = distinct_words(shard.buf, start, end)
    bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    times = np.minimum(np.bincount(inverse, minlength=len(h))[order], 255)
    at, size = start[one][order], (end - start)[one][order]

    def pack(a: int, e: int) -> bytes:
        return np.int64(e - a).tobytes() + times[a:e].astype(np.uint8).tobytes() + size[a:e].astype("<u4").tobytes() + shard.buf[tb.row_ranges(at[a:e], size[a:e])].tobytes()

    return Wanted(bucket[order], back[inverse], pack)


def name_words(buckets: int):
    def reduce(sent: list[bytes], number: list[int]) -> list[bytes]:
        n = [int(np.frombuffer(x, np.int64, 1)[0]) for x in sent]
        times = np.concatenate([np.frombuffer(x, np.uint8, k, 8) for x, k in zip(sent, n, strict=True)])
        size = np.concatenate([np.frombuffer(x, "<u4", k, 8 + k) for x, k in zip(sent, n, strict=True)]).astype(np.int64)
        data = np.concatenate([np.frombuffer(x, np.uint8, -1, 8 + 5 * k) for x, k in zip(sent, n, strict=True)])
        end = np.cumsum(size)
        return _answers(distinct_words(data, end - size, end)[2], times, n, buckets)

    return reduce


def pairs_wanted(left: np.ndarray, right: np.ndarray, which: np.ndarray, count: np.ndarray, number: np.ndarray, buckets: int) -> Wanted:
    """left, right: places in which and count (-1: a run alone); number: of each symbol."""
    # distinct as pairs of this shard's own small numbers: of its symbols, then of runs of more than one
    many = np.flatnonzero(count > 1)
    own, more = np.unique(which[many].astype(np.uint64) << np.uint64(32) | count[many].astype(np.uint64), return_inverse=True)
    small = which.copy()
    small[many] = len(number) + more
    values = np.ones((len(number) + len(own), 2), np.uint64)
    values[: len(number), 0] = number
    values[len(number) :] = np.column_stack([number[(own >> np.uint64(32)).astype(np.int64)], own & np.uint64(0xFFFFFFFF)])
    code = (small[left] + 1).astype(np.uint64) << np.uint64(32) | np.where(right < 0, 0, small[right] + 1).astype(np.uint64)
    code, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
    a, b = values[(code >> np.uint64(32)).astype(np.int64) - 1], np.zeros((len(code), 2), np.uint64)
    second = (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
    b[second > 0] = values[second[second > 0] - 1]
    h = tb.mix(_mix(a[:, 0], a[:, 1], 0) * tb.BASE ^ _mix(b[:, 0], b[:, 1], 1))
    bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort([b[:, 1], b[:, 0], a[:, 1], a[:, 0], bucket])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    a, b, times = a[order], b[order], times[order]

    def pack(i: int, e: int) -> bytes:
        head = np.int64(e - i).tobytes() + np.minimum(times[i:e], 255).astype(np.uint8).tobytes()
        return head + b"".join(planes(x) for x in (np.diff(a[i:e, 0], prepend=np.uint64(0)), a[i:e, 1], b[i:e, 0], b[i:e, 1]))

    return Wanted(bucket[order], back[inverse], pack)


def name_pairs(buckets: int):
    def reduce(sent: list[bytes], number: list[int]) -> list[bytes]:
        sizes, times, rows = [], [], []
        for x in sent:
            n = int(np.frombuffer(x, np.int64, 1)[0])
            sizes.append(n)
            times.append(np.frombuffer(x, np.uint8, n, 8))
            a = [numbers(x, 8 + n + 8 * n * k, n) for k in range(4)]
            rows.append(np.column_stack([np.cumsum(a[0], dtype=np.uint64), *a[1:]]))
        rows, times = np.concatenate(rows), np.concatenate(times)
        order = np.lexsort([rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]])
        new = np.append(False, (rows[order][1:] != rows[order][:-1]).any(1))
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new)
        return _answers(index, times, sizes, buckets)

    return reduce


def _places(state: bytes) -> np.ndarray:
    return numbers(state, 1, (len(state) - 1) // state[0], state[0]).astype(np.int64)


class Parsed:
    """A shard's words and rounds of symbols, as far as they have been named.

    A shard sends itself where each place's thing is among those that it wants, so later rounds need neither its texts nor
    to tell equal things apart again.
    """

    def __init__(self, shard: shards.Shard, row: dict, buckets: int, rounds: int) -> None:
        self.levels: list[Symbols] = []
        said = shards.answers(row, "round0") if rounds >= 0 else {}
        if state := said.get(-1 - shard.number):
            state = shards.spread(state)
            ends = 8 * (len(shard.ids) + 1)
            self.first = np.frombuffer(state[:ends], "<i8")
            inverse = _places(state[ends:])
            self.wanted = Wanted(np.zeros(0, np.int64), inverse, None)
        else:
            start, end, self.first = tb.runs(~tb.SPACE[shard.buf], shard.offsets)
            self.wanted = words_wanted(shard, start, end, buckets)
            inverse = self.wanted.inverse
        n = self.words = len(inverse)
        if rounds < 0 or not n:
            return
        self.names = answered(said)
        at = np.arange(n)
        self.levels.append(Symbols(inverse, np.repeat(np.arange(len(shard.ids)), np.diff(self.first)), at, at + 1))
        for k in range(1, ROUNDS + 1):
            run, count = fold(self.levels[-1], self.first)
            made, after, own = pair(run, count, self.names, self.first, k)
            # pairs, and runs alone, get new names; runs of a symbol of one shard can't be in another
            new = np.flatnonzero((after >= 0) | ((count[own] > 1) & self.names.shared[made.which]))
            single = np.flatnonzero((after < 0) & (count[own] > 1) & ~self.names.shared[made.which])
            said = shards.answers(row, f"round{k}") if k <= rounds else {}
            if state := said.get(-1 - shard.number):
                inverse = _places(shards.spread(state))
            else:
                self.wanted = pairs_wanted(own[new], after[new], run.which, count, self.names.number, buckets)
                inverse = self.wanted.inverse
            if k > rounds:
                return
            base = len(self.names.number)
            self.names = self.names.add(answered(said))
            which = made.which.copy()
            which[new] = base + inverse
            # a run in one shard: some symbol that nothing else equals
            which[single] = len(self.names.number) + np.arange(len(single))
            none = np.zeros(len(single), bool)
            self.names = self.names.add(Names(np.zeros(len(single), np.uint64), none, none))
            self.levels.append(Symbols(which, made.doc, made.left, made.right))

    def state(self, round: int) -> bytes:
        """What a shard sends itself with what it wants."""
        inverse = self.wanted.inverse
        width = max(1, (int(inverse.max(initial=0)).bit_length() + 7) // 8)
        return shards.squeeze((b"" if round else self.first.astype("<i8").tobytes()) + bytes([width]) + planes(inverse, width))

    def closed(self, window: int) -> np.ndarray:
        """Of every place: whether the window from there holds a symbol that no other shard has."""
        n = self.words
        edge = np.zeros(n + 1, np.int64)
        for s in self.levels:
            own = np.flatnonzero(~self.names.shared[s.which] & (s.right - s.left <= window) & (s.left >= self.first[s.doc]) & (s.right <= self.first[s.doc + 1]))
            edge += np.bincount(np.maximum(0, s.right[own] - window), minlength=n + 1) - np.bincount(s.left[own] + 1, minlength=n + 1)
        return np.cumsum(edge)[:n] > 0

    def anchors(self, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows at `start`: where the anchor's words begin, which symbol it is, and its round with that."""
        low, which, name = (np.zeros(len(start), np.int64) for _ in range(3))
        todo = np.arange(len(start))
        for level, s in reversed([*enumerate(self.levels)]):
            first = np.searchsorted(s.left, start[todo], "left")
            last = np.searchsorted(s.right, start[todo] + window, "right")
            ok = first < last
            at, first, last = todo[ok], first[ok], last[ok]
            todo = todo[~ok]
            if len(at):
                bits = np.uint64(len(s.which).bit_length())
                least = tb.mix(self.names.number[s.which]) >> bits << bits | np.arange(len(s.which), dtype=np.uint64)
                # the least of a range, from two overlapping stretches of a power of two
                power = np.frexp((last - first).astype(float))[1] - 1
                best = np.empty(len(at), np.uint64)
                for p in range(int(power.max()) + 1):
                    if p:
                        half = 1 << (p - 1)
                        least = np.minimum(least[:-half], least[half:])
                    mine = power == p
                    best[mine] = np.minimum(least[first[mine]], least[last[mine] - (1 << p)])
                symbol = (best & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
                low[at], which[at], name[at] = s.left[symbol], s.which[symbol], symbol * (ROUNDS + 1) + level
        return low, which, name


def doubled(which: np.ndarray, window: int) -> np.ndarray:
    """A number for the window from every place: equal for equal words. Hashes by doubling sort the windows, and equal
    ones are compared word by word; if some differ, their words' numbers are doubled instead."""
    h, length = tb.mix(which.astype(np.uint64) + np.uint64(1)), 1
    while length < window:
        step = min(length, window - length)
        if len(h) <= step:
            return np.zeros(0, np.int64)
        h = tb.mix(h[:-step] * tb.BASE + h[step:])
        length += step
    order = np.argsort(h)
    new = h[order][1:] != h[order][:-1]
    a, b = order[:-1][~new], order[1:][~new]
    for j in range(window):
        if not (which[a + j] == which[b + j]).all():
            return _doubled(which, window)
    name = np.empty(len(h), np.int64)
    name[order] = np.append(0, np.cumsum(new))
    return name


def _doubled(which: np.ndarray, window: int) -> np.ndarray:
    name, length = which.astype(np.uint64), 1
    while length < window:
        step = min(length, window - length)
        name = np.unique(name[:-step] << np.uint64(32) | name[step:], return_inverse=True)[1].astype(np.uint64)
        length += step
    return name.astype(np.int64)


def remove_repeats(docs: DataFrame, window: int = 20, size: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space, UTF-8) and removed (stretches of words)."""
    parts = shards.parts_of(docs)
    table, total = shards.shards(docs, size, parts)
    buckets = max(1, -(-total // SHARE))
    strings = shards.Strings(window, WIDTH, 1, by_shard=True)
    asked, names = table, [*shards.NAMES]

    for k in range(ROUNDS + 1):

        def want(shard, row, k=k):
            parsed = Parsed(shard, row, buckets, k - 1)
            yield shards.runs(shard.number, parsed.wanted.bucket, parsed.wanted.pack)
            yield shards.own(shard.number, parsed.state(k))

        sent = shards.each(asked.select(*names), want, shards.RUN)
        asked = asked.join(shards.answer(sent, (name_pairs if k else name_words)(buckets), f"round{k}", parts), "shard", "left")
        # the texts are read in the first round and in the end
        names = ["shard", "ids", "nulls", *(f"round{i}" for i in range(k + 1))]

    def reveal(shard, row):
        """Repeats within the shard, and the windows that another shard may have. The shard's own row says which."""
        parsed = Parsed(shard, row, buckets, ROUNDS)
        start, doc = windows(parsed.first, window)
        if not len(start):
            return
        number = doubled(parsed.levels[0].which, window)[start]
        # the first of each that comes again: by document, then by place
        again = np.zeros(len(start), bool)
        several = np.flatnonzero(np.bincount(number)[number] > 1)
        order = several[np.lexsort([start[several], shard.rank[doc[several]], number[several]])]
        again[order[1:]] = number[order][1:] == number[order][:-1]
        open_ = np.flatnonzero(~again & ~parsed.closed(window)[start])
        if len(open_):
            at, which, name = parsed.anchors(start[open_], window)
            common = parsed.names.common[which]
            new = np.append(True, (start[open_][1:] != start[open_][:-1] + 1) | (name[1:] != name[:-1]) | common[1:])
            lead = np.flatnonzero(new)
            low = open_[lead]
            n = np.diff(np.append(lead, len(open_)))
            word = planes6(parsed.names.number[parsed.levels[0].which])
            h = tb.mix(parsed.names.number[which[lead]] + (name[lead] % (ROUNDS + 1)).astype(np.uint64) * tb.BASE)
            h = np.where(common[lead], tb.segments(word, start[low] * WIDTH, (start[low] + window) * WIDTH), h)
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort([number[low], bucket])  # every window of the shard is sent once
            low, n, bucket, lead = low[by], n[by], bucket[by], lead[by]
            place = np.where(common[lead], 255, at[lead] - start[low])
            yield shards.runs(shard.number, bucket, strings.pack(shard.order[doc[low]], place, n, start[low], word))
        else:
            bucket = n = low = np.zeros(0, np.int64)
        state = [np.packbits(cover(start[again], window, parsed.words)), bucket.astype("<i8"), n.astype("<u2"), start[low].astype("<u4")]
        yield shards.own(shard.number, shards.squeeze(np.int64(len(bucket)).tobytes() + b"".join(x.tobytes() for x in state)))

    found = shards.answer(shards.each(asked.select(*names), reveal, shards.RUN), strings.reduce, "found", parts)

    def remove(shard, row):
        start, end, first = tb.runs(~tb.SPACE[shard.buf], shard.offsets)
        n = len(start)
        covered = np.zeros(n, bool)
        said = shards.answers(row, "found")
        if x := said.get(-1 - shard.number):
            x = shards.spread(x)
            records = int(np.frombuffer(x, np.int64, 1)[0])
            at, parts = 8, []
            for kind, many in ((np.uint8, -(-n // 8)), ("<i8", records), ("<u2", records), ("<u4", records)):
                parts.append(np.frombuffer(x, kind, many, at))
                at += parts[-1].nbytes
            bit = shards.bits(said, parts[1], parts[2].astype(np.int64))
            at = tb.row_ranges(parts[3].astype(np.int64), parts[2].astype(np.int64))
            covered = np.unpackbits(parts[0])[:n].astype(bool) | cover(at[bit], window, n)
        yield _output(shard, start, end, first, covered)

    joined = table.select(*shards.NAMES).join(found, "shard", "left")
    return shards.each(joined, remove, "doc_id long, n_words long, n_removed long, kept binary, removed array<struct<start: long, end: long>>")


def planes6(number: np.ndarray) -> np.ndarray:
    """WIDTH bytes of each number, end to end."""
    return np.ascontiguousarray(number.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).reshape(-1)


def _output(shard: shards.Shard, start: np.ndarray, end: np.ndarray, first: np.ndarray, covered: np.ndarray) -> pa.RecordBatch:
    text, kept, removed = shard.buf.tobytes(), [], []
    starts, ends = start.tolist(), end.tolist()
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        own = covered[a:b]
        kept.append(b" ".join([text[starts[j] : ends[j]] for j in (np.flatnonzero(~own) + a).tolist()]))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        removed.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
    gone = [sum(r["end"] - r["start"] for r in x) for x in removed]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([shard.doc_ids(), pa.array(np.diff(first)), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], names=["doc_id", "n_words", "n_removed", "kept", "removed"])


def repeat_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
