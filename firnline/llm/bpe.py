"""Byte-pair merges of many units at once: in each step every unit merges its pair of lowest rank, the leftmost first."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int64(1) << 40


def _byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, more = [], 256
    for b in range(256):
        names.append(chr(b) if b in plain else chr(more))
        more += b not in plain
    return names


class Merges:
    """Of a byte-level BPE with an end-of-word suffix. `units` are bytes of single pre-tokens, lower case and composed."""

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        names = _byte_names()
        self.plain = np.array([vocab[c] for c in names], np.int64)
        self.end = np.array([vocab[c + suffix] for c in names], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, both = (np.array([vocab[x] for x in column], np.int64) for column in zip(*[(a, b, a + b) for a, b in pairs], strict=True))
        self.merged = both
        # an open hash table: key and rank; a pair is at most `probes` slots from its own
        size = 1 << 20
        self.shift, self.mask = np.uint64(44), size - 1
        keys = left << 16 | right
        self.key, self.rank, self.probes = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int64), 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            at = slot
            while self.key[at] >= 0:
                at += 1
            self.key[at], self.rank[at] = key, rank
            self.probes = max(self.probes, at - slot + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 16 | right
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE)
        for p in range(self.probes):
            hit = self.key[slot + p] == keys
            out[hit] = self.rank[slot + p][hit]
        return out

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units end to end, and how many each has."""
        size = np.array([len(u) for u in units], np.int64)
        data = np.frombuffer(b"".join(units), np.uint8)
        ends = np.cumsum(size)
        sym = self.plain[data]
        sym[ends - 1] = self.end[data[ends - 1]]
        unit = np.repeat(np.arange(len(units)), size)
        rank = np.full(len(sym), _NONE)
        inside = np.flatnonzero(unit[:-1] == unit[1:])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat(rank << 22 | np.arange(len(sym)), start)
            over = best >= _NONE << 22
            if over.any():
                gone = np.repeat(over, np.diff(np.append(start, len(sym))))
                done.append((unit[gone], sym[gone]))
                keep = ~gone
                sym, unit, rank = sym[keep], unit[keep], rank[keep]
                if len(sym):
                    shift = np.cumsum(gone)[best[~over] & ((1 << 22) - 1)]
                    at = (best[~over] & ((1 << 22) - 1)) - shift
                else:
                    break
            else:
                at = best & ((1 << 22) - 1)
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol goes for each unit
            sym, unit, rank = sym[keep], unit[keep], rank[keep]
            for i in (at, at - 1):  # the pairs that changed
                ok = (i >= 0) & (i + 1 < len(sym))
                i = i[ok]
                same = unit[i] == unit[i + 1]
                value = np.full(len(i), _NONE)
                value[same] = self.ranks(sym[i[same]], sym[i[same] + 1])
                rank[i] = np.where(same, value, np.where(unit[i] == unit[i + 1], rank[i], _NONE))
            rank[-1] = _NONE
        if not done:
            return np.empty(0, np.uint32), np.zeros(len(units), np.int64)
        unit, sym = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(unit, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(unit, minlength=len(units))


def of_file(path: str) -> Merges | None:
    """The merges of a tokenizer file whose parts are the ones that this module follows; None for any other."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    model, steps = t["model"], [n["type"] for n in (t.get("normalizer") or {}).get("normalizers", ())]
    pre = (t.get("pre_tokenizer") or {}).get("pretokenizers", ())
    known = model["type"] == "BPE" and model.get("end_of_word_suffix") and not (model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges"))
    known = known and steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"]
    known = known and pre[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and len(model["vocab"]) < 1 << 16
    return Merges(model) if known else None
