"""Ropes of edit letters and the min-plus matrices that grammar rules and symbols stand for."""

from __future__ import annotations

_PRIME, _BASE = (1 << 61) - 1, 1_000_003
#: What a conversation's output so far ends in: nothing, a system turn, a user turn, an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
# fixed values: cost of an edit, of a truncated row that stays
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Row symbols: x must go; s, u, a and o by the role's initial; upper case if truncated.
SYMBOLS = "xsuaoSUAO"
#: Insertions that lead from one state to another: letters of the roles.
_INSERTS = {EMPTY: {EMPTY: "", USER: "U", ASSISTANT: "UA"}, SYSTEM: {SYSTEM: "", USER: "U", ASSISTANT: "UA"}, USER: {USER: "", ASSISTANT: "A"}, ASSISTANT: {ASSISTANT: "", USER: "U"}}
_NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Letters of the edits. Insertions and changed roles tell user from assistant here; `audit` writes them as I and R.
AUDIT = str.maketrans({"U": "I", "A": "I", "u": "R", "a": "R"})


class Rope:
    """A string as a leaf or as two ropes, with its length and a hash by which equal parts are skipped in a comparison."""

    __slots__ = ("left", "right", "leaf", "size", "mark", "shift")

    def __init__(self, leaf: str | None, left: Rope | None = None, right: Rope | None = None):
        self.leaf, self.left, self.right = leaf, left, right
        if left is None:
            self.size, self.mark = len(leaf), 0
            for c in leaf:
                self.mark = (self.mark * _BASE + ord(c)) % _PRIME
            self.shift = pow(_BASE, self.size, _PRIME)
        else:
            self.size = left.size + right.size
            self.mark = (left.mark * right.shift + right.mark) % _PRIME
            self.shift = left.shift * right.shift % _PRIME

    def __add__(self, other: Rope) -> Rope:
        return Rope(None, self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.left is None:
                out.append(r.leaf)
            else:
                todo += (r.right, r.left)
        return "".join(out)


def less(a: Rope, b: Rope) -> bool:
    """Whether the audit of `a` comes before that of `b`."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p.size == q.size and p.mark == q.mark:
            continue
        if p.left is not None and (p.size >= q.size or q.left is None):
            x += (p.right, p.left)
            y.append(q)
        elif q.left is not None:
            y += (q.right, q.left)
            x.append(p)
        else:
            s, t = p.leaf.translate(AUDIT), q.leaf.translate(AUDIT)
            n = min(len(s), len(t))
            if s[:n] != t[:n]:
                return s[:n] < t[:n]
            if len(s) > n:
                x.append(Rope(p.leaf[n:]))
            if len(t) > n:
                y.append(Rope(q.leaf[n:]))
    return bool(y) and not x


Cell = tuple[int, Rope]
Vector = dict[int, Cell]
Matrix = dict[int, Vector]


def _put(row: Vector, state: int, cost: int, rope: Rope) -> None:
    old = row.get(state)
    if old is None or cost < old[0] or cost == old[0] and less(rope, old[1]):
        row[state] = (cost, rope)


def symbol(sign: str) -> Matrix:
    """Cheapest edits of one row from state to state: insertions, then the row. (An insertion before a deletion is never the least; it may follow it.)"""
    made: Matrix = {}
    for i in STATES:
        row: Vector = {}
        _put(row, i, DELETE, Rope("D"))
        if sign != "x":
            extra = CUT if sign.isupper() else 0
            for k, before in _INSERTS[i].items():
                for letter, role, cost in (("K", sign.lower(), KEEP), ("u", "u", REROLE), ("a", "a", REROLE)):
                    to = _NEXT.get(role, {}).get(k)
                    if to is not None:
                        _put(row, to, len(before) * INSERT + cost + extra, Rope(before + letter))
        made[i] = row
    return made


def through(vector: Vector, matrix: Matrix) -> Vector:
    """Min-plus product of a row with a matrix; of equal costs the least audit."""
    out: Vector = {}
    for k, (cost, rope) in vector.items():
        for j, (more, rest) in matrix[k].items():
            total, old = cost + more, out.get(j)
            if old is None or total < old[0]:
                out[j] = (total, rope + rest)
            elif total == old[0]:
                longer = rope + rest
                if less(longer, old[1]):
                    out[j] = (total, longer)
    return out


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """The matrix of every symbol and, bottom-up, of every rule; rule i stands for a pair of signs and is written `rule_sign(i)`."""
    known = {s: symbol(s) for s in SYMBOLS}
    for i, pair in enumerate(rules):
        left, right = known[pair[0]], known[pair[1]]
        known[rule_sign(i)] = {s: through(left[s], right) for s in STATES}
    return known


def rule_sign(i: int) -> str:
    return chr(0xE000 + i)


def compressed(sequence: str, rules: list[str]) -> str:
    for i, pair in enumerate(rules):
        sequence = sequence.replace(pair, rule_sign(i))
    return sequence


#: What ends a conversation from each state.
LAST: dict[int, tuple[int, str]] = {EMPTY: (0, ""), SYSTEM: (2 * INSERT, "UA"), USER: (INSERT, "A"), ASSISTANT: (0, "")}
