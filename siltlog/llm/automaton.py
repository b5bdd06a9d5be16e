"""Regular expressions over bytes, compiled by subset construction and minimised into transition arrays.

The grammar: literals, backslash escapes (also \\xHH), classes with ranges, groups, alternation, and the counts
? * + {m} {m,} {m,n}. That is all the rules here need.
"""

from __future__ import annotations

import numpy as np


def parse(pattern: str, ignore_case: bool = False):
    """A syntax tree: ("set", frozenset of bytes), ("cat", parts), ("alt", parts) or ("rep", part, low, high or None)."""
    at = 0

    def fold(s: set[int]) -> tuple:
        if ignore_case:
            s = s | {x ^ 32 for x in s if 65 <= x & ~32 <= 90}
        return ("set", frozenset(s))

    def escape() -> int:
        nonlocal at
        at += 1
        if pattern[at] == "x":
            at += 3
            return int(pattern[at - 2 : at], 16)
        at += 1
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(pattern[at - 1], pattern[at - 1]))

    def one() -> int:
        nonlocal at
        if pattern[at] == "\\":
            return escape()
        at += 1
        return ord(pattern[at - 1])

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            if pattern[at] == "(":
                at += 1
                part = alternatives()
                assert pattern[at] == ")", pattern
                at += 1
            elif pattern[at] == "[":
                at += 1
                negated = pattern[at] == "^"
                at += negated
                members: set[int] = set()
                while pattern[at] != "]":
                    low = one()
                    if pattern[at] == "-" and pattern[at + 1] != "]":
                        at += 1
                        members |= set(range(low, one() + 1))
                    else:
                        members.add(low)
                at += 1
                part = fold(set(range(256)) - members if negated else members)
            else:
                part = fold({one()})
            while at < len(pattern) and pattern[at] in "?*+{":
                if pattern[at] == "{":
                    end = pattern.index("}", at)
                    low, comma, high = pattern[at + 1 : end].partition(",")
                    part = ("rep", part, int(low), int(high) if high else None if comma else int(low))
                    at = end + 1
                else:
                    part = ("rep", part, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]])
                    at += 1
            parts.append(part)
        return ("cat", parts)

    tree = alternatives()
    assert at == len(pattern), pattern
    return tree


def mirrored(tree):
    """The tree of all matches read backwards."""
    if tree[0] == "cat":
        return ("cat", [mirrored(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [mirrored(x) for x in tree[1]])
    return ("rep", mirrored(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.arcs.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """States for tree from start on; the state where it ends."""
        if tree[0] == "set":
            end = self.state()
            self.arcs[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if tree[0] == "alt":
            for part in tree[1]:
                self.free[self.add(part, self._from(start))].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self._from(start)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
        else:
            for _ in range(high - low):
                self.free[start].append(end)
                start = self.add(part, start)
            self.free[start].append(end)
        return end

    def _from(self, start: int) -> int:
        s = self.state()
        self.free[start].append(s)
        return s

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """A minimal deterministic automaton for several trees at once.

    moves[state, byte] is the next state; accepts[state] has bit k if a match of tree k ends there. Unanchored, a match
    may begin at any byte. State 0 is the start; dead is the state that no match leaves, or -1.
    """

    def __init__(self, trees: list, anchored: bool = True):
        nfa = _Nfa()
        root = nfa.state()
        ends = {nfa.add(tree, nfa._from(root)): 1 << k for k, tree in enumerate(trees)}
        sets = list(dict.fromkeys(s for arcs in nfa.arcs for s, _ in arcs))
        same: dict[tuple, int] = {}
        kind = [same.setdefault(tuple(b in s for s in sets), len(same)) for b in range(256)]
        member = list(same)
        begin = nfa.closure([root])
        number, rows, accepts = {begin: 0}, [], []
        for now in number_growing(number):
            accepts.append(sum(bit for end, bit in ends.items() if end in now))
            arcs = [(sets.index(s), to) for x in now for s, to in nfa.arcs[x]]
            row = []
            for m in member:
                to = {t for k, t in arcs if m[k]}
                after = nfa.closure(to if anchored else to | {root})
                row.append(number.setdefault(after, len(number)))
            rows.append(row)
        table, accepts = self._minimal(np.array(rows, dtype=np.int64), np.array(accepts, dtype=np.int64))
        self.moves, self.accepts = table[:, kind].astype(np.int32), accepts
        stuck = [s for s in range(len(table)) if not accepts[s] and (table[s] == s).all()]
        self.dead = stuck[0] if stuck else -1

    @staticmethod
    def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split blocks of states until all states of a block move to the same blocks."""
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if new.max() == block.max():
                break
            block = new
        order = np.full(block.max() + 1, -1)
        order[block[0]] = 0
        rest = [b for b in range(len(order)) if b != block[0]]
        order[rest] = np.arange(1, len(order))
        block = order[block]
        first = np.unique(block, return_index=True)[1]
        return block[table[first]], accepts[first]


def number_growing(number: dict):
    """The keys of a dict that grows meanwhile, each once."""
    done = 0
    while done < len(number):
        batch = list(number)[done:]
        done += len(batch)
        yield from batch
