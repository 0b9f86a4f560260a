"""Probabilistic automata inferred from sample strings by merging prefix-tree states.

The prefix tree of the sample counts arrivals, ends and steps. States are merged in breadth-first
order with the first compatible kept state of the same depth: two states are compatible if Hoeffding
bounds allow equal ending and step rates, recursively. States of different depth stay apart, so the
automaton has no loops and its ends know the lengths of the sample; a string that leaves it (longer,
or other steps than any seen) goes on at the rate of blind guessing. Symbols are classes of
characters, so an automaton learns a format (lengths, order of classes) and not the values.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

#: Character classes: digits, hex letters, other letters by case, then each sign alone.
CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-"]
SYMBOL = {c: i for i, group in enumerate(CLASSES) for c in group}
#: Log probability of a step that is guessed blindly: any class, or the end.
BLIND = -math.log(len(CLASSES) + 1)


class Automaton:
    """States as lists of counts; `step[s]` maps a symbol to [next state, count]."""

    def __init__(self, strings: Iterable[str], alpha: float = 0.05):
        self.seen, self.ends, self.step = [0], [0], [{}]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.grow(([SYMBOL[c] for c in text], 1) for text in strings)

    def grow(self, strings: Iterable[tuple[list[int], int]]) -> None:
        """Adds strings (as symbols), each so many times. States that are there stay; what is new is merged into them or beside them."""
        old = len(self.seen)
        for symbols, times in strings:
            self._add(symbols, times)
        self._merge_all(old)
        self._finish()

    def walk(self, symbols: list[int]) -> list[int] | None:
        """The states that a string goes through; None if it leaves the automaton."""
        path, at = [0], 0
        for x in symbols:
            at = self.next[at][x]
            if at < 0:
                return None
            path.append(at)
        return path

    def recount(self, counts: dict[tuple[int, int], int]) -> None:
        """Sets all counts: of steps by (state, symbol), of ends by (state, -1)."""
        for s, edges in enumerate(self.step):
            self.ends[s] = counts.get((s, -1), 0)
            for x, edge in edges.items():
                edge[1] = counts.get((s, x), 0)
            self.seen[s] = self.ends[s] + sum(edge[1] for edge in edges.values())
        self._finish()

    def _add(self, symbols: list[int], times: int) -> None:
        at = 0
        self.seen[0] += times
        for x in symbols:
            edge = self.step[at].get(x)
            if edge is None:
                self.seen.append(0)
                self.ends.append(0)
                self.step.append({})
                edge = self.step[at][x] = [len(self.seen) - 1, 0]
            edge[1] += times
            at = edge[0]
            self.seen[at] += times
        self.ends[at] += times

    def _differ(self, a: int, m: int, b: int, n: int) -> bool:
        return abs(a / m - b / n) > self._bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            m, n = self.seen[p], self.seen[q]
            if not m or not n:
                continue
            if self._differ(self.ends[p], m, self.ends[q], n):
                return False
            for x in self.step[p].keys() | self.step[q].keys():
                a, b = self.step[p].get(x), self.step[q].get(x)
                if self._differ(a[1] if a else 0, m, b[1] if b else 0, n):
                    return False
                if a and b and a[0] != b[0]:
                    todo.append((a[0], b[0]))
        return True

    def _fold(self, keep: int, gone: int) -> None:
        """Adds the tree under `gone` to `keep`; `gone` is still a tree, so every state goes once."""
        todo = [(keep, gone)]
        while todo:
            keep, gone = todo.pop()
            self.seen[keep] += self.seen[gone]
            self.ends[keep] += self.ends[gone]
            for x, (child, count) in self.step[gone].items():
                edge = self.step[keep].get(x)
                if edge is None:
                    self.step[keep][x] = [child, count]
                else:
                    edge[1] += count
                    todo.append((edge[0], child))

    def _merge_all(self, old: int) -> None:
        """States from number `old` on are new, and still a tree."""
        kept, level = [0], [0]
        while level:  # the states of one depth, then those after them
            edges = [(p, x) for p in level for x in sorted(self.step[p])]
            blue = [(p, x) for p, x in edges if self.step[p][x][0] >= old]
            level = list(dict.fromkeys(q for p, x in edges if (q := self.step[p][x][0]) < old))
            for p, x in sorted(blue, key=lambda e: (-self.seen[self.step[e[0]][e[1]][0]], e)):  # those seen most choose first
                q = self.step[p][x][0]
                r = next((r for r in level if self._compatible(r, q)), None)
                if r is None:
                    level.append(q)
                else:
                    self.step[p][x][0] = r
                    self._fold(r, q)
            kept += level
        number = {s: i for i, s in enumerate(kept)}
        self.step = [{x: [number[q], n] for x, (q, n) in self.step[s].items()} for s in kept]
        self.seen, self.ends = [self.seen[s] for s in kept], [self.ends[s] for s in kept]

    def _finish(self) -> None:
        """Log probabilities with a small count added to every step and end."""
        small, ways = 0.05, len(CLASSES) + 1
        self.next, self.log_step, self.log_end = [], [], []
        for s in range(len(self.seen)):
            total = math.log(self.seen[s] + small * ways)
            self.next.append([self.step[s][x][0] if x in self.step[s] else -1 for x in range(len(CLASSES))])
            self.log_step.append([math.log((self.step[s][x][1] if x in self.step[s] else 0) + small) - total for x in range(len(CLASSES))])
            self.log_end.append(math.log(self.ends[s] + small) - total)
        self.lost = BLIND

    @property
    def states(self) -> int:
        return len(self.next)

    def log_likelihood(self, text: str) -> float:
        return self.chance([SYMBOL[c] for c in text])

    def chance(self, symbols: list[int]) -> float:
        """The log likelihood of a string of symbols."""
        at, total = 0, 0.0
        for x in symbols:
            if at < 0:
                total += self.lost
                continue
            total += self.log_step[at][x]
            at = self.next[at][x]
        return total + (self.lost if at < 0 else self.log_end[at])
