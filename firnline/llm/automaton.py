"""Regular rules to one minimal deterministic automaton over byte classes, as numpy transition arrays: subset construction,
then minimisation by splitting blocks."""

from __future__ import annotations

import numpy as np

LETTERS = {*range(65, 91), *range(97, 123)}


class Nfa:
    """Thompson-style fragments: moves[s] lists (bytes, target), free[s] lists targets without input."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, node, at: int) -> int:
        """Adds the node behind state `at`; returns the state where it ends."""
        kind, *rest = node
        if kind == "set":
            end = self.state()
            self.moves[at].append((rest[0], end))
            return end
        if kind == "cat":
            for part in rest[0]:
                at = self.build(part, at)
            return at
        if kind == "alt":
            end = self.state()
            for part in rest[0]:
                self.free[self.build(part, at)].append(end)
            return end
        if kind == "opt":
            end = self.build(rest[0], at)
            self.free[at].append(end)
            return end
        if kind == "rep":  # at least `least` times
            part, least = rest
            for _ in range(least):
                at = self.build(part, at)
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.build(part, loop)].append(loop)
            return loop
        raise ValueError(kind)


def chars(text: str, fold: bool = False):
    """A set of bytes: single characters and a-z ranges, letters in either case if fold."""
    found, i = set(), 0
    while i < len(text):
        if text[i + 1 : i + 2] == "-" and i + 2 < len(text):
            found |= {*range(ord(text[i]), ord(text[i + 2]) + 1)}
            i += 3
        else:
            found.add(ord(text[i]))
            i += 1
    if fold:
        found |= {b ^ 32 for b in found & LETTERS}
    return ("set", frozenset(found))


def word(text: str, fold: bool = False):
    return ("cat", [("set", frozenset({ord(c), ord(c) ^ 32} if fold and ord(c) in LETTERS else {ord(c)})) for c in text])


def cat(*parts):
    return ("cat", list(parts))


def alt(*parts):
    return ("alt", list(parts))


def opt(part):
    return ("opt", part)


def rep(part, least: int = 0):
    return ("rep", part, least)


def backwards(node):
    """The rule of the reversed texts."""
    kind, *rest = node
    if kind == "cat":
        return ("cat", [backwards(part) for part in reversed(rest[0])])
    if kind == "alt":
        return ("alt", [backwards(part) for part in rest[0]])
    if kind in ("opt", "rep"):
        return (kind, backwards(rest[0]), *rest[1:])
    return node


def subsets(rule, search: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte, moves of each state by class, and whether it accepts; state 0 is the start."""
    nfa = Nfa()
    start = nfa.state()
    end = nfa.build(rule, start)
    sets = [s for moves in nfa.moves for s, _ in moves]
    signature: dict[tuple, int] = {}
    classes = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)])
    closed = []
    for s in range(len(nfa.moves)):
        seen, todo = {s}, [s]
        while todo:
            fresh = [t for t in nfa.free[todo.pop()] if t not in seen]
            seen.update(fresh)
            todo += fresh
        closed.append(frozenset(seen))
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(signature))]
    step = [[frozenset().union(*(closed[to] for on, to in m if b in on)) for b in sample] for m in nfa.moves]
    begin = closed[start]
    names, order, moves = {begin: 0}, [begin], []
    for now in order:
        row = []
        for c in range(len(sample)):
            to = frozenset().union(*(step[s][c] for s in now), begin if search else ())
            if to not in names:
                names[to] = len(order)
                order.append(to)
            row.append(names[to])
        moves.append(row)
    return classes, np.array(moves), np.array([int(end in s) for s in order])


def product(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All automata side by side: the states that can be reached together, with a bit of acceptance for each."""
    _, first, classes = np.unique(np.column_stack([c for c, _, _ in parts]), axis=0, return_index=True, return_inverse=True)
    classes = classes.reshape(-1)
    sizes = [len(a) for _, _, a in parts]
    scale = np.cumprod([1, *sizes[:-1]])
    known, layer, found, moves = np.zeros(1, np.int64), np.zeros(1, np.int64), [], []
    while len(layer):
        to = sum(m[layer // s % n][:, c[first]] * s for (c, m, _), s, n in zip(parts, scale.tolist(), sizes, strict=True))
        found.append(layer)
        moves.append(to)
        layer = np.setdiff1d(to, known)
        known = np.union1d(known, layer)
    state = np.concatenate(found)
    order = np.argsort(state)
    accept = sum(a[state // s % n] << i for i, ((_, _, a), s, n) in enumerate(zip(parts, scale.tolist(), sizes, strict=True)))
    return classes, order[np.searchsorted(state[order], np.concatenate(moves))], accept


def minimal(classes: np.ndarray, moves: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least automaton of the same texts: blocks of states are split until their moves agree. The start first, states
    that accept last."""
    part, blocks = np.unique(accept, return_inverse=True)[1], 0
    while part.max() + 1 > blocks:
        blocks = int(part.max()) + 1
        rows = np.ascontiguousarray(np.column_stack([part, part[moves]]).astype(np.int32))
        part = np.unique(rows.view(f"V{rows.shape[1] * 4}")[:, 0], return_inverse=True)[1]
    one = np.unique(part, return_index=True)[1]
    order = np.lexsort([one, accept[one] > 0, one != one[part[0]]])
    place = np.empty(len(one), np.int64)
    place[order] = np.arange(len(one))
    one = one[order]
    return classes, place[part][moves[one]], accept[one]


class Dfa:
    """table[state * width + class] is the next state times width; accept[state] has a bit for each rule; start is 0.

    Each rule goes through subset construction and minimisation, then all of them together through minimisation again.
    """

    def __init__(self, rules: list, search: bool) -> None:
        classes, self.next, accept = minimal(*product([minimal(*subsets(rule, search)) for rule in rules]))
        self.states, self.width = self.next.shape
        self.classes, self.accept = classes.astype(np.uint8), accept.astype(np.uint8)
        self.table = (self.next * self.width).astype(np.int32).reshape(-1)
        self.accepts_from = int((self.accept == 0).sum()) * self.width if not self.accept[0] else 0
        self.dead = {s for s in range(self.states) if not self.accept[s] and (self.next[s] == s).all()}
        #: Bytes after which the state is the start's, whatever it was before: texts can be cut behind them.
        self.resets = (self.next == self.next[0]).all(0)[self.classes] & (self.next[0] == 0)[self.classes]

    def longest(self, data: bytes, at: int, end: int) -> int:
        """End of the longest match that starts at `at`, or -1."""
        state, found = 0, -1
        rows, classes, accept, dead = self.rows, self.class_list, self.accept_list, self.dead
        for i in range(at, end):
            state = rows[state][classes[data[i]]]
            if state in dead:
                break
            if accept[state]:
                found = i + 1
        return found

    @property
    def rows(self):
        if not hasattr(self, "_rows"):
            self._rows, self.class_list, self.accept_list = self.next.tolist(), self.classes.tolist(), self.accept.tolist()
        return self._rows

    def lasts(self, buf: np.ndarray, low: np.ndarray, at: np.ndarray, lock: int = 64) -> np.ndarray:
        """Read backwards from each place `at` down to `low`: the furthest place where a match ends, -1 if none does."""
        found = np.full(len(at), -1, np.int64)
        lanes, here, floor, state = np.arange(len(at)), at.copy(), low, np.zeros(len(at), np.int64)
        dead = np.zeros(self.states, bool)
        dead[list(self.dead)] = True
        for _ in range(lock):
            if not len(lanes):
                break
            state = self.next[state, self.classes[buf[here]]]
            hit = self.accept[state] > 0
            found[lanes[hit]] = here[hit]
            here = here - 1
            going = ~dead[state] & (here >= floor)
            lanes, here, floor, state = lanes[going], here[going], floor[going], state[going]
        rows = self.rows
        for lane, i, f, s in zip(lanes.tolist(), here.tolist(), floor.tolist(), state.tolist(), strict=True):  # long ones
            data = buf[f : i + 1].tobytes()
            for k in range(len(data) - 1, -1, -1):
                s = rows[s][self.class_list[data[k]]]
                if s in self.dead:
                    break
                if self.accept_list[s]:
                    found[lane] = f + k
        return found

    def scan(self, buf: np.ndarray, cuts: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Positions of bytes after which some rule accepts, and those rules' bits. cuts: positions (with 0) before which
        the state is the start's.

        All lanes advance by one byte at a time, so the pass is one gather a byte; lanes begin at the cuts, or behind a
        resetting byte, about `lane` bytes apart.
        """
        n = len(buf)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.uint8)
        safe = self.resets[buf[:-1]]
        marks = np.zeros(n, bool)
        marks[1:] = safe
        cuts = cuts[cuts < n]
        marks[cuts] = True
        marks[0] = True
        at = np.flatnonzero(marks)
        # of the safe positions, the first of each stretch of `lane` bytes, and every cut
        keep = np.empty(len(at), bool)
        keep[0] = True
        np.not_equal(at[1:] // lane, at[:-1] // lane, out=keep[1:])
        must = np.zeros(n, bool)
        must[cuts] = True
        start = at[keep | must[at]]
        length = np.diff(np.append(start, n))
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        alive = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # lanes longer than t
        codes = self.classes[buf]
        state = np.zeros(len(start), np.int32)
        hits = []
        for t in range(int(length[0])):
            k = int(alive[t])
            s = np.take(self.table, state[:k] + np.take(codes, start[:k] + t, mode="clip"), mode="clip")
            state[:k] = s
            hit = s >= self.accepts_from
            if hit.any():
                hits.append((start[:k][hit] + t, self.accept[s[hit] // self.width]))
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.uint8)
        at, rules = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(at)
        return at[order], rules[order]
