"""Re-Pair rules over row symbols, and the cheapest edits of a run of rows as min-plus matrices with audit ropes.

A row of a conversation is one symbol: the initial of its role (s, u, a or another) and whether it is cut off, or DROP if it
has to go. An automaton of four states reads the roles that are kept: nothing yet, after a system turn, after a
user turn, after an assistant turn. The matrix of a run of symbols holds, for every two states, the cheapest edits
that lead from one to the other and the least audit among equally cheap ones. Matrices compose, so that of a rule
is made once of those of its two parts and serves every conversation in which the rule occurs.

Two audits of the same rows and the same cost never are a prefix of one another (what follows the shorter one could only be
further insertions, which cost), so the least audit of a whole is made of least audits of its parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

#: Symbols: role class (0 s, 1 u, 2 a, 3 another), CUT more if the text is cut off; DROP for rows that must go.
CUT = 4
DROP = 8
SYMBOLS = 9
STATES = 4
#: state -> state, after a turn of the class
_STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: what an inserted or changed turn becomes in each state, and the state after it
PUT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: insertions that take one state to another
_INSERTS = {(0, 0): 0, (0, 2): 1, (0, 3): 2, (1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 2): 0, (2, 3): 1, (3, 3): 0, (3, 2): 1}
RECAST_COST, DELETE_COST, INSERT_COST, CUT_COST = 1, 2, 5, 5

Rope = str | tuple
Cell = tuple[int, Rope] | None
Matrix = list[list[Cell]]


def after_kept(state: int, role_class: int) -> int:
    return _STEP[state, role_class]


def text_of(rope: Rope) -> str:
    """The characters of a rope, a string or a pair of ropes."""
    parts, rest = [], [rope]
    while rest:
        top = rest.pop()
        if isinstance(top, str):
            parts.append(top)
        else:
            rest += (top[1], top[0])
    return "".join(parts)


def less(a: Rope, b: Rope) -> bool:
    """Whether ``a`` comes before ``b`` by code point; parts that both share are passed over unread."""
    left, right, x, y = [a], [b], "", ""
    while True:
        if not x and not y and left and right:
            if left[-1] is right[-1]:
                left.pop()
                right.pop()
                continue
            if isinstance(left[-1], tuple) and isinstance(right[-1], tuple):
                for stack in (left, right):
                    top = stack.pop()
                    stack += (top[1], top[0])
                continue
        if not x:
            if not left:
                return bool(y) or any(text_of(part) for part in right)
            x = left.pop()
            if isinstance(x, tuple):
                left += (x[1], x[0])
                x = ""
        elif not y:
            if not right:
                return False
            y = right.pop()
            if isinstance(y, tuple):
                right += (y[1], y[0])
                y = ""
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            x, y = x[n:], y[n:]


def better(new: Cell, old: Cell) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1]))


def times(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest edits of one run followed by another, for the rows of ``a`` (any number of them)."""
    out: Matrix = []
    for row in a:
        made: list[Cell] = []
        for q in range(STATES):
            best: Cell = None
            for r in range(STATES):
                if row[r] is not None and b[r][q] is not None:
                    found = (row[r][0] + b[r][q][0], (row[r][1], b[r][q][1]))
                    if better(found, best):
                        best = found
            made.append(best)
        out.append(made)
    return out


def _edits(symbol: int) -> Matrix:
    m: Matrix = [[None] * STATES for _ in range(STATES)]

    def put(p: int, q: int, cost: int, audit: str) -> None:
        if better((cost, audit), m[p][q]):
            m[p][q] = (cost, audit)

    for p in range(STATES):
        put(p, p, DELETE_COST, "D")
        if symbol != DROP:
            kept, cut = symbol % CUT, CUT_COST * (symbol >= CUT)
            if (p, kept) in _STEP:
                put(p, _STEP[p, kept], cut, "K")
            put(p, PUT[p][1], RECAST_COST + cut, "R")
    return m


def inserts() -> Matrix:
    m: Matrix = [[None] * STATES for _ in range(STATES)]
    for (p, q), k in _INSERTS.items():
        m[p][q] = (k * INSERT_COST, "I" * k)
    return m


#: Nothing read yet: the state before the first row.
START: Matrix = [[(0, ""), None, None, None]]


def matrices(rules: Sequence[tuple[int, int]]) -> list[Matrix]:
    """The matrix of every symbol, then of every rule, from the bottom up; insertions come before a row."""
    out = [times(inserts(), _edits(s)) for s in range(SYMBOLS)]
    for a, b in rules:
        out.append(times(out[a], out[b]))
    return out


def product(symbols: Iterable[int], of: list[Matrix], start: Matrix) -> Matrix:
    for s in symbols:
        start = times(start, of[s])
    return start


def ended(row: Sequence[Cell]) -> tuple[int, str]:
    """Cost and audit of a whole conversation: insertions after the last row, then an accepting state."""
    closed = times([list(row)], inserts())[0]
    best: Cell = None
    for q in (0, 3):
        if closed[q] is not None and better(closed[q], best):
            best = closed[q]
    return best[0], text_of(best[1])


def _places(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """First places of the pair in ``x``, from the left and without overlaps."""
    at = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
    if a != b or not len(at):
        return at
    index = np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    return at[(index - np.maximum.accumulate(np.where(new, index, 0))) % 2 == 0]


def rewrite(sequences: Sequence[bytes], rules: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """Each sequence of symbols in terms of the rules, applied in their order."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    x = np.full(int(lengths.sum()) + len(sequences), -1, np.int32)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(x), bool)
    inside[ends] = False
    x[inside] = np.frombuffer(b"".join(sequences), np.uint8)
    for k, (a, b) in enumerate(rules):
        at = _places(x, a, b)
        if len(at):
            x[at] = SYMBOLS + k
            keep = np.ones(len(x), bool)
            keep[at + 1] = False
            x = x[keep]
    return np.split(x[x >= 0], np.cumsum(np.diff(np.flatnonzero(x < 0), prepend=-1) - 1)[:-1]) if len(ends) else []


def pair_counts(sequences: Sequence[np.ndarray], weights: Sequence[int]) -> dict[tuple[int, int], int]:
    """How often each pair of neighbours occurs without overlaps, every sequence counted ``weight`` times."""
    if not len(sequences):
        return {}
    x = np.concatenate([np.append(s, -1) for s in sequences]).astype(np.int64)
    w = np.repeat(np.asarray(weights, np.int64), [len(s) + 1 for s in sequences])
    both = (x[:-1] >= 0) & (x[1:] >= 0)
    equal = both & (x[:-1] == x[1:])
    for s in np.unique(x[:-1][equal]):  # of a run of equal symbols every other pair counts
        run = np.flatnonzero((x[:-1] == s) & (x[1:] == s))
        both[np.setdiff1d(run, _places(x, s, s), assume_unique=True)] = False
    keys, which = np.unique((x[:-1] << 32 | (x[1:] & 0xFFFFFFFF))[both], return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, which, w[:-1][both])
    return {(int(k >> 32), int(k & 0xFFFFFFFF)): int(n) for k, n in zip(keys, total)}


def next_rules(counts: Sequence[tuple[int, int, int]], room: int) -> list[tuple[int, int]]:
    """The pairs to replace next, from (a, b, count) by falling count.

    Pairs that share no symbol don't change each other's counts, and no pair made by a replacement is more frequent than what it
    replaces, so these are pairs that replacing one at a time would also come to.
    """
    taken, out = set(), []
    for a, b, _ in counts:
        if len(out) < room and a not in taken and b not in taken:
            out.append((a, b))
            taken |= {a, b}
    return out
