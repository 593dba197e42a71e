"""Token ids of whole texts by a tokenizer file, exactly as its library gives them, with each distinct unit encoded once.

A unit is a piece of text that the pre-tokenizer can't join to its neighbours: it ends at ASCII white space (dropped),
between letters or digits and other ASCII characters, and between ASCII digits; letters are here those of ASCII and the
accented Latin ones of two bytes. Apostrophes and other characters stay with what is next to them. Units are looked up
in a table of fixed size, which compares their bytes. Units of Latin letters, of one digit or of ASCII signs are single pre-tokens
and merged many at a time (see bpe); the library encodes the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import bpe
from . import textbytes as tb

_KIND = np.full(256, 3, np.uint8)  # other ASCII
_KIND[tb.SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[39, *range(128, 256)]] = 4
#: whether a unit can end between two kinds of bytes
_ENDS = np.zeros((5, 5), bool)
_ENDS[0, :] = _ENDS[:, 0] = True
_ENDS[1, [2, 3]] = _ENDS[[2, 3], 1] = True
_ENDS[2, [2, 3]] = _ENDS[3, 2] = True
_ENDS = _ENDS.reshape(-1)


#: Units of up to so many bytes are kept, as two numbers of eight bytes each, and their length.
SHORT = 16
UNIT = np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<i8")])
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _kinds(buf: np.ndarray) -> np.ndarray:
    """_KIND of each byte, with accented Latin letters as letters. Signs among them, and the one letter that lower case
    takes apart, are left out."""
    kind = _KIND[buf]
    lead = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5))
    a, b = buf[lead], buf[lead + 1]
    lead = lead[~(((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) | ((a == 0xC4) & (b == 0xB0)) | ((a == 0xC5) & (b == 0x89)))]
    kind[lead] = kind[lead + 1] = 1
    return kind


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts. Memory is fixed: a table of 2**bits units of up to SHORT bytes, kept with their bytes, and `most`
    ids of them. The table is emptied when the ids are full; longer units are encoded as they come."""

    def __init__(self, path: str, bits: int = 20, most: int = 1 << 22) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = bpe.of_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mask, n = np.uint64((1 << bits) - 1), 1 << bits
        self.unit, self.at, self.size = np.zeros(n, UNIT), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(most, np.uint32), 0

    def _units(self, data: bytes, start: list[int], end: list[int], single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units and how many each has; single: those that are one pre-token of the kinds that `bpe` follows."""
        ids, size = [], np.zeros(len(start), np.int64)
        order = []
        if self.merges is None:
            single = np.zeros(len(start), bool)
        for mine in (np.flatnonzero(single), np.flatnonzero(~single)):
            if not len(mine):
                continue
            units = [data[start[i] : end[i]] for i in mine.tolist()]
            if single[mine[0]]:
                units = [u if u.isascii() else u.decode("utf-8", "replace").lower().encode() for u in units]
                found, n = self.merges.encode(units)
            else:
                lists = [x.ids for x in self.tokenizer.encode_batch([u.decode("utf-8", "replace") for u in units], add_special_tokens=False)]
                n = np.array([len(x) for x in lists], np.int64)
                found = np.fromiter((i for x in lists for i in x), np.uint32, int(n.sum()))
            size[mine] = n
            ids.append(found)
            order.append(np.repeat(mine, n))
        order = np.concatenate(order)
        return np.concatenate(ids)[np.argsort(order, kind="stable")], size

    def _named(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each unit, and its UNIT: the bytes themselves for units of up to SHORT bytes."""
        words, n = tb.eights(low), end - start
        unit = np.empty(len(n), UNIT)
        unit["n"] = n
        unit["a"] = words[start] & _HEAD[np.minimum(n, 8)]
        unit["b"] = words[np.minimum(start + 8, len(low))] & _HEAD[np.clip(n - 8, 0, 8)]
        return tb.mix(unit["a"] * tb.BASE ^ tb.mix(unit["b"] + n.astype(np.uint64))), unit

    def _ids(self, where: np.ndarray, size: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Ids of units; those at len(pool) and beyond are in extra."""
        rows = tb.row_ranges(where, size)
        new = rows >= len(self.pool)
        if not new.any():
            return self.pool[rows]
        out = self.pool[np.where(new, 0, rows)]
        out[new] = extra[rows[new] - len(self.pool)]
        return out

    def _keep(self, slot: np.ndarray, unit: np.ndarray, ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Units into the table, the last one of those that share a slot."""
        short = np.flatnonzero((unit["n"] <= SHORT) & (size <= SHORT))
        short = short[len(short) - 1 - np.unique(slot[short][::-1], return_index=True)[1]]
        ids = ids[tb.row_ranges(at[short], size[short])]
        if self.used + len(ids) > len(self.pool):
            self.unit["n"], self.used = 0, 0
            if len(ids) > len(self.pool):
                return
        slot, size = slot[short], size[short]
        self.pool[self.used : self.used + len(ids)] = ids
        self.unit[slot], self.at[slot], self.size[slot] = unit[short], self.used + np.cumsum(size) - size, size
        self.used += len(ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) end to end, and n + 1 offsets; null counts as empty."""
        buf, offsets = tb.text_bytes(column)
        ids, counts = [], []
        for a, b in tb.slices(offsets, 512 << 10):
            i, c = self._slice(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(i)
            counts.append(c)
        total = np.concatenate([[0], *counts]).cumsum()
        return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), total

    def _slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        low = tb.LOWER[buf]
        kind = _kinds(buf)
        edge = np.empty(len(buf) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = _ENDS.take(kind[:-1] * np.uint8(5) + kind[1:])
        edge[offsets] = True
        at = np.flatnonzero(edge)
        keep = kind[at[:-1]] != 0
        start, end = at[:-1][keep], at[1:][keep]
        h, unit = self._named(low, start, end)
        slot = (h & self.mask).astype(np.int64)
        where, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        known = self.unit[slot]
        missed = np.flatnonzero((known["n"] != unit["n"]) | (known["a"] != unit["a"]) | (known["b"] != unit["b"]) | (unit["n"] > SHORT))
        extra = np.empty(0, np.uint32)
        if len(missed):
            data = low.tobytes()
            seen: dict[bytes, int] = {}
            one = [seen.setdefault(data[i:j], len(seen)) for i, j in zip(start[missed].tolist(), end[missed].tolist(), strict=True)]
            inverse = np.array(one)
            first = missed[np.unique(inverse, return_index=True)[1]]
            # bytes that keep a unit from being one of the simple ones: of other characters, or signs that don't print
            odd = np.concatenate([[0], np.cumsum((kind == 4) | ((kind == 3) & ((buf < 33) | (buf > 126))))])
            # of long ones the library keeps a heap of pairs
            single = (odd[end[first]] == odd[start[first]]) & (end[first] - start[first] <= 64)
            extra, new_size = self._units(data, start[first].tolist(), end[first].tolist(), single)
            new_at = np.cumsum(new_size) - new_size
            where[missed], size[missed] = len(self.pool) + new_at[inverse], new_size[inverse]
        ids = self._ids(where, size, extra)
        if len(missed):
            self._keep(slot[first], unit[first], extra, new_at, new_size)
        ends = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(ends[np.searchsorted(start, offsets)])
        if self.special and (b"<|" in (data := buf.tobytes())):  # the library looks for these in the raw text
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in range(n):
                text = data[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")
                if any(s in text for s in self.special):
                    parts[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
