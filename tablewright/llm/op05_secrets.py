"""Secret scan by one combined deterministic automaton.

The rules' regular expressions are parsed into one nondeterministic automaton,
made deterministic by subset construction over byte classes and minimised by
partition refinement. The result is one transition array; a single pass over the
bytes of a text runs all rules at once, whole, and tells, for each rule, where matches
end. The array is stepped for thousands of stretches of text side by side: text
is cut behind bytes after which the automaton is in its start state whatever came
before, so no match is ever cut. Where few stretches are left, they are longer than
the others and are stepped one after the other.

In the stretches in which a rule accepted, the rule's own minimal automaton, anchored at each place
where a match can begin, gives the spans: the leftmost match, as long as it goes, then
the next one behind it. A rule is a head and a run (its expression is head, then run); a second
anchored automaton, of the head, tells where the run begins. Matches whose run, or whole, is
shorter than the rule's least length are dropped. No regular-expression engine
takes part. Rules beyond the base three (private key
headers, access tokens with known prefixes) add spans; they take none away.

Each document is scanned on its own, whole: no key, so nothing can be hot. Nulls
and odd input: a null text is an empty one, with zero counts; ids may be null or
repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, share

_VALUE = "[A-Za-z0-9+/_.=-]"
_KEYS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: kind, head, run, is the run measured (else the whole), its least length. Base rules first.
RULES = [
    ("assign", rf"{_KEYS}[\"']?\x20*[:=]\x20*[\"']?", f"{_VALUE}+", True, 6),
    ("access", "AKIA", "[A-Z0-9]+", False, 20),
    ("hex", "", "[0-9a-f]{24,}", False, 24),  # runs of hex digits are whole ones, so the least length can be in the expression
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", False, 0),
    ("hub_token", "gh[pousr]_", "[A-Za-z0-9]+", False, 40),
    ("chat_token", "xox[abprs]-", "[A-Za-z0-9-]+", False, 20),
]
BASE = 3


# ---------------------------------------------------------------- compilation
def _parse(text: str):
    """Expression tree: ('set', bytes) | ('cat', [..]) | ('alt', [..]) | ('rep', x, least, most or None)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = text[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = text[at]
        at += 1
        if c == "x":
            at += 2
            return int(text[at - 2 : at], 16)
        return ord(c)

    def alternatives():
        nonlocal at
        out = [sequence()]
        while at < len(text) and text[at] == "|":
            at += 1
            out.append(sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    def sequence():
        nonlocal at
        out = []
        while at < len(text) and text[at] not in "|)":
            if text[at] == "(":
                at += 1
                x = alternatives()
                at += 1
            elif text[at] == "[":
                at += 1
                members = set()
                while text[at] != "]":
                    a = char()
                    if text[at] == "-" and text[at + 1] != "]":
                        at += 1
                        members.update(range(a, char() + 1))
                    else:
                        members.add(a)
                at += 1
                x = ("set", frozenset(members))
            else:
                x = ("set", frozenset([char()]))
            if at < len(text) and text[at] in "?*+{":
                if text[at] == "{":
                    end = text.index("}", at)
                    low, more, high = text[at + 1 : end].partition(",")
                    at = end
                    x = ("rep", x, int(low), int(high) if high else (None if more else int(low)))
                else:
                    x = ("rep", x, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[text[at]])
                at += 1
            out.append(x)
        return ("cat", out)

    return alternatives()


class Nfa:
    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, x, start: int) -> int:
        """Adds x behind start; gives the state after it."""
        if x[0] == "set":
            end = self.state()
            self.moves[start].append((x[1], end))
            return end
        if x[0] == "cat":
            for y in x[1]:
                start = self.build(y, start)
            return start
        if x[0] == "alt":
            end = self.state()
            for y in x[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.build(y, first)].append(end)
            return end
        _, y, least, most = x
        for _ in range(least):
            start = self.build(y, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start] += [loop, end]
            self.free[self.build(y, loop)] += [loop, end]
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.build(y, start)
            self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Automaton:
    """Minimal deterministic automaton of many rules, searching from every position, or anchored at one.

    classes: 256 byte classes; moves[state, class]: next state; accepts[state]: bit r is set where a match of rule r
    ends; state 0 starts. An anchored automaton has a state that nothing leads out of, `dead` (else -1).
    """

    def __init__(self, expressions: list[str], anchored: bool = False) -> None:
        nfa = Nfa()
        root, ends = nfa.state(), {}
        for r, e in enumerate(expressions):
            first = nfa.state()
            nfa.free[root].append(first)
            ends[nfa.build(_parse(e), first)] = r
        sets = {m for moves in nfa.moves for m, _ in moves}
        signature: dict[tuple, int] = {}
        ordered = sorted(sets, key=sorted)
        self.classes = np.array([signature.setdefault(tuple(b in s for s in ordered), len(signature)) for b in range(256)], np.uint8)
        sample = [int(np.flatnonzero(self.classes == c)[0]) for c in range(len(signature))]
        again = set() if anchored else {root}
        start = nfa.closed([root])
        number, todo, rows, accept = {start: 0}, deque([start]), [], []
        while todo:  # subset construction; unless anchored, the start set is part of every set, so a match may begin anywhere
            now = todo.popleft()
            row = []
            for b in sample:
                new = nfa.closed({t for s in now for m, t in nfa.moves[s] if b in m} | again)
                if new not in number:
                    number[new] = len(number)
                    todo.append(new)
                row.append(number[new])
            rows.append(row)
            accept.append(sum(1 << r for r in {ends[s] for s in now if s in ends}))
        moves, accepts = np.array(rows), np.array(accept)
        part = np.unique(accepts, return_inverse=True)[1]
        while True:  # refinement: states stay together while all their moves lead to the same parts
            keys = np.column_stack((part, part[moves]))
            new = np.unique(keys, axis=0, return_inverse=True)[1].ravel()
            if new.max() == part.max():
                break
            part = new
        first = np.unique(part, return_index=True)[1]
        order = np.argsort(first, kind="stable")  # the start state keeps number 0
        name = np.empty(len(order), np.int64)
        name[order] = np.arange(len(order))
        part = name[part]
        first = first[order]
        self.n_classes = len(sample)
        self.n_states = len(first)
        self.moves = part[moves[first]].astype(np.int32)
        self.accepts = accepts[first].astype(np.uint8)
        self.resets = (self.moves == 0).all(axis=0)[self.classes]  # bytes that lead to the start from everywhere
        stuck = np.flatnonzero((self.moves == np.arange(self.n_states)[:, None]).all(axis=1) & (self.accepts == 0))
        self.dead = int(stuck[0]) if anchored and len(stuck) else -1
        self.steps = (self.moves * self.n_classes).ravel()  # next state, as the start of its row
        self.table, self.bits = self.steps.tolist(), np.repeat(self.accepts, self.n_classes)
        self.said = self.bits.tolist()

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rules that accept somewhere in data[starts[i]:ends[i]], as bits; stretches step side by side while there are many."""
        order = np.argsort(starts - ends, kind="stable")  # longest first
        at, sizes = starts[order], (ends - starts)[order]
        cls = self.classes[data]
        state = np.zeros(len(at), np.int32)
        seen = np.zeros(len(at), np.uint8)
        few = int(sizes[_FEW]) if len(sizes) > _FEW else 0  # from here on at most _FEW are left
        live = np.searchsorted(-sizes, -np.arange(few), side="left")  # stretches longer than i
        for i, n in enumerate(live.tolist()):
            state = state[:n]
            state += cls[at[:n] + i]
            state = self.steps.take(state)
            seen[:n] |= self.bits.take(state)
        table, said = self.table, self.said
        for k in range(min(_FEW, len(at))):
            now, bits = int(state[k]), int(seen[k])
            for c in cls[at[k] + few : at[k] + sizes[k]].tobytes():
                now = table[now + c]
                bits |= said[now]
            seen[k] = bits
        out = np.empty(len(at), np.uint8)
        out[order] = seen
        return out

    def longest(self, cls: bytes, at: int, end: int) -> int:
        """Anchored: the end of the longest match from `at`, -1 if there is none. cls: the classes of the bytes."""
        table, said, dead = self.table, self.said, self.dead * self.n_classes
        now, best = 0, at if self.accepts[0] else -1
        for p in range(at, end):
            now = table[now + cls[p]]
            if now == dead:
                break
            if said[now]:
                best = p + 1
        return best

    def openings(self, cls: np.ndarray) -> list[int]:
        """Anchored: the places from which the automaton isn't dead after three steps (or what is left of them)."""
        padded = np.concatenate((cls, np.zeros(2, cls.dtype)))
        state = np.zeros(len(cls), np.int32)
        alive = np.ones(len(cls), bool)
        for k in range(3):
            state = self.steps.take(state + padded[k : k + len(cls)])
            # behind the end nothing is ruled out
            alive &= (state != self.dead * self.n_classes) | (np.arange(len(cls)) + k >= len(cls))
        return np.flatnonzero(alive).tolist()


class Rule:
    """One rule's spans in a stretch: leftmost matches, as long as they go, none inside another."""

    def __init__(self, kind: str, head: str, run: str, measured: bool, least: int) -> None:
        self.least = least
        self.whole = Automaton([head + run], anchored=True)
        self.head = Automaton([head], anchored=True) if measured else None

    def spans(self, data: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
        """Byte places in data."""
        view = data[lo:hi]
        cls = self.whole.classes[view]
        text, head = cls.tobytes(), self.head.classes[view].tobytes() if self.head else b""
        out, at = [], 0
        for p in self.whole.openings(cls):
            if p >= at:
                end = self.whole.longest(text, p, len(text))
                if end > p:
                    at = end  # a match that is too short is passed by like any other
                    if end - (self.head.longest(head, p, end) if self.head else p) >= self.least:
                        out.append((lo + p, lo + end))
        return out


_FEW = 12
_STRETCH = 192


def _stretches(data: np.ndarray, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut behind reset bytes into stretches of about _STRETCH bytes, longer only where no reset byte comes."""
    safe = np.flatnonzero(resets[data[:-1]] & ((data[1:] & 0xC0) != 0x80)) + 1  # never inside a character
    goal = np.arange(_STRETCH, len(data), _STRETCH)
    k = np.searchsorted(safe, goal)
    cuts = np.unique(safe[k[k < len(safe)]])
    cuts = cuts[cuts < len(data)]
    return np.concatenate(([0], cuts)).astype(np.int64), np.concatenate((cuts, [len(data)])).astype(np.int64)


class Scanner:
    def __init__(self, rules=RULES) -> None:
        self.rules, self.exact = rules, [Rule(*r) for r in rules]
        self.automaton = Automaton([head + run for _, head, run, _, _ in rules])

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text, (start, rule, end) in code points, by start and then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        view = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # a line end resets every rule
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        starts, ends = _stretches(view, self.automaton.resets)
        hits = self.automaton.scan(view, starts, ends)
        some = np.flatnonzero(hits)
        if not len(some):
            return out
        points = np.zeros(len(view) + 1, np.int64)  # code points before each byte
        np.cumsum((view & 0xC0) != 0x80, out=points[1:])
        for i in some.tolist():
            for r, rule in enumerate(self.exact):
                if hits[i] >> r & 1:  # a stretch can hold the ends of several texts, but no match goes beyond a line end
                    for a, b in rule.spans(view, int(starts[i]), int(ends[i])):
                        t = int(np.searchsorted(first, a, side="right")) - 1
                        out[t].append((int(points[a] - points[first[t]]), r, int(points[b] - points[first[t]])))
        for x in out:
            x.sort()
        return out


def _digest(shared):
    def run(batches):
        scanner = shared()
        kinds = [r[0] for r in scanner.rules]
        for b in batches:
            texts = byte_texts(b.column(1))
            sizes = [len(t) for t in texts]
            found: list = []
            at = 0
            while at < len(texts):
                end, total = at, 0
                while end < len(texts) and (end == at or total + sizes[end] <= 4_000_000):
                    total += sizes[end]
                    end += 1
                found += scanner.spans(texts[at:end])
                at = end
            said = [[f"{kinds[r]}:{s}:{e}" for s, r, e in x] for x in found]
            base = [",".join(y for y, (_, r, _) in zip(ys, x) if r < BASE) for ys, x in zip(said, found)]
            cols = [b.column(0).cast(pa.int64())]
            cols += [pa.array([sum(r == k for _, r, _ in x) for x in found], pa.int64()) for k in range(BASE)]
            cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([",".join(x) for x in said], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = share(docs.sparkSession, Scanner(rules))  # a few thousand states, whatever the documents are
    return rows.mapInArrow(_digest(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan_secrets(table(spark, sf_dir, "documents"))
