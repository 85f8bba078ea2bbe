"""Grammar inference: a prefix tree of labelled strings, merged into a probabilistic automaton.

States are merged in red-blue order when the Hoeffding bound cannot tell their frequencies apart, here and below
(the ALERGIA test). An `Alphabet` maps characters to the symbols of the tree: fine enough to tell formats apart, and
coarse enough that many strings share a path, without which no state could be told from another. Within a symbol,
characters have the frequencies of the sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: A literal of a common beginning is the symbol of this number and the character's own.
LITERAL = 0x100


class Alphabet:
    """Symbols by place and character: what (nearly) all strings begin with stays literal, then letters and digits are one.

    Other marks are symbols of their own. sizes: the number of characters that a symbol stands for.
    """

    def __init__(self, prefix: str, letters: str):
        self.letters, self.prefix = frozenset(letters), prefix

    def __call__(self, at: int, c: str) -> str:
        if at < len(self.prefix) and c == self.prefix[at]:
            return chr(LITERAL + ord(c))
        return "x" if c in self.letters else c

    def size(self, symbol: str) -> int:
        return len(self.letters) if symbol == "x" else 1


class Classes:
    """Symbols by kind of character, wherever it stands: for ordinary strings."""

    kinds = {**dict.fromkeys(DIGITS, "d"), **dict.fromkeys(LOWER, "l"), **dict.fromkeys(UPPER, "u")}

    def __call__(self, at: int, c: str) -> str:
        return self.kinds.get(c, c)

    def size(self, symbol: str) -> int:
        return {"d": 10, "l": 26, "u": 26}.get(symbol, 1)


def pattern(symbol: Callable[[int, str], str], s: str) -> str:
    """The symbols of a string, a character each."""
    return "".join([symbol(k, c) for k, c in enumerate(s)])


def paths_of(counted, deepest: int | None = None):
    """(beginning, n that go through it, n that end there) of counted patterns; beginnings of at most `deepest` symbols."""
    for symbols, n in counted:
        whole = deepest is None or len(symbols) <= deepest
        for k in range(len(symbols) if whole else deepest + 1):
            yield symbols[:k], n, 0
        if whole:
            yield symbols, n, n


class Node:
    __slots__ = ("ends", "next", "seen", "through")

    def __init__(self):
        self.seen, self.ends, self.next, self.through = 0, 0, {}, Counter()


class Automaton:
    """A probabilistic automaton over symbols, with a floor for what the sample never showed."""

    def __init__(self, samples: list[str], symbol: Callable[[int, str], str], alpha: float = 0.05, floor: float = 1e-3):
        counted, chars, paths = Counter(), Counter(), {}
        for s in samples:
            counted[pattern(symbol, s)] += 1
            chars.update((symbol(k, c), c) for k, c in enumerate(s))
        for path, n, ends in paths_of(counted.items()):
            had = paths.get(path, (0, 0))
            paths[path] = had[0] + n, had[1] + ends
        self.build(symbol, chars, paths, alpha, floor)

    @classmethod
    def of_counts(cls, symbol: Callable[[int, str], str], chars: Counter, paths: dict[str, tuple[int, int]], alpha: float = 0.05, floor: float = 1e-3) -> Automaton:
        """From counts over samples: of (symbol, character), and by beginning of the symbols how many go through and end."""
        found = cls.__new__(cls)
        found.build(symbol, chars, paths, alpha, floor)
        return found

    def build(self, symbol, chars: Counter, paths: dict[str, tuple[int, int]], alpha: float, floor: float) -> None:
        self.symbol, self.alpha, self.floor = symbol, alpha, floor
        total = Counter()
        for (k, _), n in chars.items():
            total[k] += n
        #: Log-probability of a character within its symbol, and of one that the sample never showed.
        self.within = {(k, c): math.log((n + 1) / (total[k] + max(symbol.size(k), 1))) for (k, c), n in chars.items()}
        self.never = {k: -math.log(n + max(symbol.size(k), 1)) for k, n in total.items()}
        states = self.infer(self.prefix_tree(paths))
        number = {id(q): k for k, q in enumerate(states)}
        #: By state: log-probabilities of the symbols seen, of any other, of the end; the next states; the likeliest one.
        self.tables = [self.table(q) for q in states]
        self.moves = [{k: number[id(q)] for k, q in state.next.items()} for state in states]
        self.likeliest = [moves[max(q.through, key=lambda k: (q.through[k], k))] if q.through else at for at, (q, moves) in enumerate(zip(states, self.moves, strict=True))]

    @staticmethod
    def prefix_tree(paths: dict[str, tuple[int, int]]) -> Node:
        """The tree of counted beginnings; a node is seen as often as its samples end there or go on in the tree."""
        nodes = {"": Node()}
        ordered = sorted(paths, key=lambda x: (len(x), x))
        for path in ordered:
            n, ends = paths[path]
            q = nodes.setdefault(path, Node())
            q.ends = ends
            if path:
                nodes[path[:-1]].through[path[-1]] += n
                nodes[path[:-1]].next[path[-1]] = q
        for q in nodes.values():
            q.seen = q.ends + sum(q.through.values())
        return nodes[""]

    def different(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        if not n1 or not n2:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(self, a: Node, b: Node) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a is b:
                continue
            if self.different(a.seen, a.ends, b.seen, b.ends):
                return False
            for k in a.through.keys() | b.through.keys():
                if self.different(a.seen, a.through[k], b.seen, b.through[k]):
                    return False
                if k in a.next and k in b.next:
                    todo.append((a.next[k], b.next[k]))
        return True

    @staticmethod
    def fold(a: Node, b: Node) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            a.seen += b.seen
            a.ends += b.ends
            a.through.update(b.through)
            for k, q in b.next.items():
                if k in a.next:
                    todo.append((a.next[k], q))
                else:
                    a.next[k] = q

    def infer(self, root: Node) -> list[Node]:
        red, known, at = [root], {id(root)}, 0
        while at < len(red):
            parent = red[at]
            blue = next((k for k in sorted(parent.next) if id(parent.next[k]) not in known), None)
            if blue is None:
                at += 1
                continue
            q = parent.next[blue]
            for r in red:
                if self.compatible(r, q):
                    parent.next[blue] = r
                    self.fold(r, q)
                    at = min(at, red.index(r))
                    break
            else:
                red.append(q)
                known.add(id(q))
        return red

    def walk(self, symbols: str):
        """(state, symbol) of each step, and the last state with no symbol."""
        q = 0
        for k in symbols:
            yield q, k
            move = self.moves[q].get(k)
            q = self.likeliest[q] if move is None else move
        yield q, ""

    def recount(self, counts: dict[tuple[int, str], int]) -> None:
        """Probabilities from the counts of all samples' steps, those beyond the counted beginnings included."""
        own = [Node() for _ in self.tables]
        for (q, k), n in counts.items():
            own[q].seen += n
            if k:
                own[q].through[k] += n
            else:
                own[q].ends += n
        self.tables = [self.table(q) for q in own]

    def table(self, q: Node) -> tuple[dict[str, float], float, float]:
        total = q.seen + 2 * self.floor
        return {k: math.log((n + self.floor) / total) for k, n in q.through.items()}, math.log(self.floor / total), math.log((q.ends + self.floor) / total)

    def log_likelihood(self, s: str) -> float:
        """Log-probability of a string and its end; where no transition exists, the walk goes on in the likeliest one."""
        q, total = 0, 0.0
        for at, c in enumerate(s):
            k = self.symbol(at, c)
            known, rare, _ = self.tables[q]
            total += known.get(k, rare)
            total += self.within.get((k, c)) or self.never.get(k, -5.0)
            move = self.moves[q].get(k)
            q = self.likeliest[q] if move is None else move
        return total + self.tables[q][2]
