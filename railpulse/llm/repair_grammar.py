"""Repair of conversations as a shortest path over a grammar-compressed sequence.

Every row of a conversation is one symbol: its role's initial (s, u, a or another) and
its first fault (none, truncated, blank, duplicate). The cheapest edits that make the roles
``(s?(ua)+)?`` are a min-plus product of transfer matrices over four states, one matrix
for each symbol. Re-Pair replaces the most frequent neighbouring pair of symbols by a new one
again and again, over all conversations together; a rule's matrix is the product of
its two parts' matrices and is worked out once, bottom-up. A conversation then needs one
matrix for each symbol that is left of it.

* **Matrix**: from state p to q, the least cost and, of the cheapest audits (initials of the
  edits), the ASCII-least. Equal-cost audits over the same rows are never a prefix
  of one another (what is longer holds one more paid insert), so the least of two
  joined audits is joined from least ones and the product is well defined.
* **Audit rope**: an entry of a rule holds the middle state and so points into its
  parts; the text is written out only where two equal costs have to be compared and at
  the end.
* What a rule also carries: numbers of rows and of each fault, first and last initial
  and the unlawful neighbours inside it.

States: nothing yet, after a leading s, after u, after a. Nothing yet and after a are ends.
Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and
duplicate), Insert 3; a truncated row that isn't deleted costs 3 more.
"""

from __future__ import annotations

from collections import Counter

ROLES, FAULTS = "suao", ("", "truncated", "blank", "duplicate")
#: Symbols 0-15: role x 4 + fault. Rules follow. A symbol is written as chr(BASE + symbol).
BASE, TERMINALS = 0x100, 16
#: Symbols at most, so that none meets the surrogates.
MOST_SYMBOLS = 0xD000

START, S, U, A = range(4)
STATES, ENDS = range(4), (START, A)
INF = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LAWFUL = {"su", "ua", "au"}
#: Next state by state and what is put out.
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}


def _inserts() -> dict[tuple[int, int], int]:
    """From state to state by inserts alone: how many."""
    least = {(p, p): 0 for p in STATES}
    for _ in STATES:
        for (p, q), k in list(least.items()):
            for role in "ua":
                if (q, role) in NEXT:
                    to = (p, NEXT[q, role])
                    least[to] = min(least.get(to, k + 1), k + 1)
    return least


INSERTS = _inserts()


def _terminal(symbol: int) -> list[list[tuple[int, str] | None]]:
    """Cost and audit of one row with the inserts before it."""
    role, fault = ROLES[symbol // 4], FAULTS[symbol % 4]
    edits = [(p, p, DELETE, "D") for p in STATES]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        edits += [(p, NEXT[p, role], KEEP + more, "K") for p in STATES if (p, role) in NEXT]
        edits += [(p, NEXT[p, new], REROLE + more, "R") for p in STATES for new in "ua" if (p, new) in NEXT]
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
    for (p, m), k in INSERTS.items():
        for at, q, cost, edit in edits:
            if at == m:
                found = (INSERT * k + cost, "I" * k + edit)
                if best[p][q] is None or found < best[p][q]:
                    best[p][q] = found
    return best


class Grammar:
    """Re-Pair rules and, for every symbol, its transfer matrix and what it counts.

    ``rules[k]`` are the two symbols that TERMINALS + k stands for. Costs are in ``cost[symbol][p][q]``
    (INF: no way); ``middle`` has the state between the parts of a rule.
    """

    def __init__(self, rules: list[tuple[int, int]] = ()):
        self.rules: list[tuple[int, int]] = []
        self.cost: list[list[list[int]]] = []
        self.middle: list[list[list[int]]] = []
        self.leaf: list[list[list[str]]] = []
        self.rows: list[int] = []
        self.faults: list[tuple[int, int, int]] = []
        self.ends: list[tuple[str, str]] = []
        self.unlawful: list[int] = []
        for s in range(TERMINALS):
            m = _terminal(s)
            self.cost.append([[x[0] if x else INF for x in row] for row in m])
            self.leaf.append([[x[1] if x else "" for x in row] for row in m])
            self.middle.append([])
            self.rows.append(1)
            f = FAULTS[s % 4]
            self.faults.append(tuple(int(f == g) for g in ("blank", "duplicate", "truncated")))
            self.ends.append((ROLES[s // 4],) * 2)
            self.unlawful.append(0)
        for left, right in rules:
            self.add(left, right)

    def add(self, left: int, right: int) -> int:
        """The symbol of a new rule, with its matrix from those of its parts."""
        cost, middle = [[INF] * 4 for _ in STATES], [[0] * 4 for _ in STATES]
        for p in STATES:
            for q in STATES:
                cost[p][q], middle[p][q] = self.least([(self.cost[left][p][m] + self.cost[right][m][q], m) for m in STATES], lambda m, p=p, q=q: self.pieces([(right, m, q), (left, p, m)]))
        self.rules.append((left, right))
        self.cost.append(cost)
        self.middle.append(middle)
        self.leaf.append([])
        self.rows.append(self.rows[left] + self.rows[right])
        self.faults.append(tuple(map(sum, zip(self.faults[left], self.faults[right]))))
        self.ends.append((self.ends[left][0], self.ends[right][1]))
        self.unlawful.append(self.unlawful[left] + self.unlawful[right] + ((self.ends[left][1] + self.ends[right][0]) not in LAWFUL))
        return len(self.cost) - 1

    def pieces(self, stack: list[tuple[int, int, int]]):
        """The audit text of entries (symbol, p, q), the last one first, piece by piece."""
        while stack:
            symbol, p, q = stack.pop()
            if symbol < TERMINALS:
                yield self.leaf[symbol][p][q]
            else:
                left, right = self.rules[symbol - TERMINALS]
                m = self.middle[symbol][p][q]
                stack.append((right, m, q))
                stack.append((left, p, m))

    @staticmethod
    def least(ways: list[tuple[int, int]], audit) -> tuple[int, int]:
        """Of (cost, way): the cheapest, and among equal ones that of the least audit."""
        cheapest = min(c for c, _ in ways)
        if cheapest >= INF:
            return INF, 0
        equal = [w for c, w in ways if c == cheapest]
        best = equal[0]
        for way in equal[1:]:
            if _before(audit(way), audit(best)):
                best = way
        return cheapest, best

    def compress(self, text: str, since: int = 0) -> str:
        """A sequence of symbols after the rules from ``since`` on, in the order they were made."""
        for k in range(since, len(self.rules)):
            left, right = self.rules[k]
            pair = chr(BASE + left) + chr(BASE + right)
            if pair in text:
                text = text.replace(pair, chr(BASE + TERMINALS + k))
        return text


def _before(a, b) -> bool:
    """Whether one text, given in pieces, is less than another."""
    one = two = ""
    while True:
        while not one and (one := next(a, None)) == "":
            pass
        while not two and (two := next(b, None)) == "":
            pass
        if one is None or two is None:
            return one is None and two is not None
        n = min(len(one), len(two))
        if one[:n] != two[:n]:
            return one[:n] < two[:n]
        one, two = one[n:], two[n:]


class Fold:
    """A conversation's cheapest way, symbol by symbol.

    For each state the cost and a rope: (symbol, p, q, rope before), shared between states.
    """

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.cost = [0, INF, INF, INF]
        self.rope: list = [None] * 4
        self.rows = 0
        self.faults = (0, 0, 0)
        self.unlawful = 0
        self.last = ""

    def _text(self, symbol: int, p: int, q: int):
        entries, rope = [(symbol, p, q)], self.rope[p]
        while rope:
            entries.append(rope[:3])
            rope = rope[3]
        return self.g.pieces(entries)

    def push(self, symbol: int) -> None:
        g, cost, rope = self.g, [INF] * 4, [None] * 4
        for q in STATES:
            cost[q], p = g.least([(self.cost[p] + g.cost[symbol][p][q], p) for p in STATES], lambda p, q=q: self._text(symbol, p, q))
            rope[q] = (symbol, p, q, self.rope[p])
        self.cost, self.rope = cost, rope
        self.rows += g.rows[symbol]
        self.faults = tuple(map(sum, zip(self.faults, g.faults[symbol])))
        first, last = g.ends[symbol]
        self.unlawful += g.unlawful[symbol] + (bool(self.last) and (self.last + first) not in LAWFUL)
        self.last = last

    def end(self) -> tuple[int, str]:
        """Cost and audit of the cheapest way to an end, trailing inserts included."""
        ways = [(self.cost[p] + INSERT * INSERTS[p, q], (p, q)) for p in STATES for q in ENDS if (p, q) in INSERTS]

        def audit(way):
            rope, entries = self.rope[way[0]], []
            while rope:
                entries.append(rope[:3])
                rope = rope[3]
            yield from self.g.pieces(entries)
            yield "I" * INSERTS[way]

        cost, way = self.g.least(ways, audit)
        return cost, "".join(audit(way))


def pairs(sequences, grammar: Grammar) -> Counter:
    """How often two symbols are neighbours in (sequence, weight) after the rules so far."""
    found: Counter = Counter()
    for text, weight in sequences:
        text = grammar.compress(text)
        for a, b in zip(text, text[1:]):
            found[a + b] += weight
    return found


def output(audit: str, initials: str):
    """For every row: (roles put in before it, its edit, its role or None where the text and role stay or go); at last the trailing roles.

    The roles put out follow from the audit: s first if a kept row that starts is an s, then u and a in turn.
    """
    state, before, row = START, "", 0
    for edit in audit:
        role = {START: "u", S: "u", U: "a", A: "u"}[state]
        if edit == "I":
            before, state = before + role, NEXT[state, role]
            continue
        if edit == "K":
            role = initials[row]
        yield before, edit, role if edit == "R" else None
        if edit != "D":
            state = NEXT[state, role]
        before, row = "", row + 1
    yield before, "", None
