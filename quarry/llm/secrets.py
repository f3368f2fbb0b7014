"""Secret scans with one minimal deterministic automaton over the bytes of a text.

Rule regexes are parsed, turned into one nondeterministic automaton, made
deterministic by subset construction, minimised by partition refinement, and
laid out as one transition array over byte classes. One pass over a text's
bytes runs all rules at once and says which can match. For those, a pass of
the reversed automaton marks where matches can begin, and the rule's own
automaton gives the longest match from the leftmost such place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames, textkit

# A bounded count in a rule multiplies the states of the combined automaton, so
# least lengths are checked on what was found, except for runs of hex digits.
# The rules, in the order in which spans that start together are listed.
# (kind, regex, least length of the last group or None, least length of the match)
RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 0),
    ("access", r"AKIA[A-Z0-9]+", None, 20),
    ("hex", r"[0-9a-f]{24,}", None, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", None, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", None, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", None, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", None, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", None, 36),
    ("url_password", r"[a-z][a-z0-9+]+://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$%*-]+@", None, 0),
)
BASE_KINDS = ("assign", "access", "hex")


# --- regex -> syntax tree: ("set", bytes) | ("cat", [..]) | ("or", [..]) | ("rep", node, least, most or None)
class _Parser:
    """ASCII regexes: literals, escapes, classes, groups, |, ?, *, + and {m,n}."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        node = self.choice()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return node

    def choice(self):
        arms = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            arms.append(self.sequence())
        return arms[0] if len(arms) == 1 else ("or", arms)

    def sequence(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            node = self.atom()
            while self.i < len(self.p) and self.p[self.i] in "?*+{":
                c = self.p[self.i]
                self.i += 1
                if c == "{":
                    end = self.p.index("}", self.i)
                    lo, _, hi = self.p[self.i : end].partition(",")
                    exact = "," not in self.p[self.i : end]
                    self.i = end + 1
                    node = ("rep", node, int(lo), int(lo) if exact else int(hi) if hi else None)
                else:
                    node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            parts.append(node)
        return ("cat", parts)

    def escape(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            node = self.choice()
            if self.p[self.i : self.i + 1] != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return node
        if c == "[":
            negate = self.p[self.i] == "^"
            self.i += negate
            found: set[int] = set()
            while self.p[self.i] != "]":
                lo = self.member()
                hi = lo
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    hi = self.member()
                found |= set(range(lo, hi + 1))
            self.i += 1
            return ("set", frozenset(set(range(256)) - found if negate else found))
        if c == ".":
            return ("set", frozenset(set(range(256)) - {10}))
        return ("set", frozenset({self.escape() if c == "\\" else ord(c)}))

    def member(self) -> int:
        c = self.p[self.i]
        self.i += 1
        return self.escape() if c == "\\" else ord(c)


def reverse(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    parts = [reverse(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Builds ``node`` from ``start``; the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in node[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(x, own)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start] += [loop]
            self.empty[loop].append(end)
            self.empty[self.add(inner, loop)].append(loop)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """``table[state * width + classes[byte]]`` is the next state, premultiplied by width; state 0 begins.

    Accepting states are numbered last, from ``accept`` on; ``mask`` has the
    rules that end in each state (by state number).
    """

    classes: bytes
    width: int
    table: list[int]
    accept: int
    mask: list[int]
    dead: int


def build(nodes: list, anywhere: bool, once: bool = False) -> Automaton:
    """The minimal automaton of some syntax trees.

    ``anywhere``: matches may begin at any byte. ``once``: it need only tell
    that a rule has matched, so what is under way for a rule that has is left;
    without this, loops of all rules multiply in the combined automaton.
    """
    nfa = _Nfa()
    root, ends, owned = nfa.state(), {}, {}
    for k, node in enumerate(nodes):
        start = nfa.state()
        nfa.empty[root].append(start)
        end = nfa.add(node, start)
        ends[end], owned[end] = k, frozenset(range(start, len(nfa.empty))) - {end}
    sets = sorted({s for m in nfa.moves for s, _ in m}, key=sorted)
    signature: dict[tuple, int] = {}
    classes = bytes(signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256))
    width = len(signature)
    sample = [classes.index(c) for c in range(width)]

    def closed(states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        if once:
            for e in owned.keys() & seen:
                seen -= owned[e]
        return frozenset(seen)

    first = closed([root])
    number, order, step = {first: 0}, [first], []
    for own in order:
        row = []
        for b in sample:
            to = {x for s in own for chars, x in nfa.moves[s] if b in chars}
            to = closed(to) | first if anywhere else closed(to)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        step.append(row)
    mask = [sum(1 << k for e, k in ends.items() if e in s) for s in order]
    # Minimise: refine the partition by accepted rules until no class splits.
    part = {m: i for i, m in enumerate(dict.fromkeys(mask))}
    block = [part[m] for m in mask]
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((block[i], *(block[t] for t in step[i])), len(keys)) for i in range(len(order))]
        if len(keys) == len(set(block)):
            break
        block = new
    members: dict[int, int] = {}
    for i, b in enumerate(block):
        members.setdefault(b, i)
    ranked = sorted(members, key=lambda b: (mask[members[b]] != 0, b != block[0], b))
    place = {b: i for i, b in enumerate(ranked)}
    table = [place[block[t]] * width for b in ranked for t in step[members[b]]]
    masks = [mask[members[b]] for b in ranked]
    dead = next((i * width for i, b in enumerate(ranked) if not masks[i] and all(table[i * width + c] == i * width for c in range(width)) and (i or not anywhere)), -1)
    if mask[0]:
        raise ValueError("a rule matches the empty text")
    accept = next((i for i, m in enumerate(masks) if m), len(masks)) * width
    return Automaton(classes, width, table, accept, masks, dead)


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        trees = [_Parser(r[1]).parse() for r in rules]
        self.all = build(trees, True, once=True)
        self.own = [build([t], False) for t in trees]
        self.back = [build([reverse(t)], True) for t in trees]
        self.group = [re.compile(r[1].encode()) if r[2] else None for r in rules]

    def possible(self, data: bytes) -> int:
        """The rules that match somewhere in ``data``, as bits: one pass over the bytes."""
        a = self.all
        table, accept, width, mask, state, found = a.table, a.accept, a.width, a.mask, 0, 0
        for c in data.translate(a.classes):
            state = table[state + c]
            if state >= accept:
                found |= mask[state // width]
        return found

    def matches(self, k: int, data: bytes) -> list[tuple[int, int]]:
        """Leftmost, longest, non-overlapping matches of rule ``k``, as byte ranges."""
        back, own = self.back[k], self.own[k]
        starts, state = [], 0
        coded = data.translate(back.classes)
        for i in range(len(coded) - 1, -1, -1):
            state = back.table[state + coded[i]]
            if state >= back.accept:
                starts.append(i)
        coded, out, upto = data.translate(own.classes), [], 0
        for s in reversed(starts):
            if s < upto:
                continue
            state, end, i = 0, s, s
            while i < len(coded):
                state = own.table[state + coded[i]]
                i += 1
                if state >= own.accept:
                    end = i
                elif state == own.dead:
                    break
            out.append((s, end))
            upto = end
        return out

    def scan(self, text: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in code points, by start and then rule. Matches shorter than the rule asks for are dropped after they are found."""
        found = self.possible(text)
        if not found:
            return []
        spans = []
        for k, (_, _, group, least) in enumerate(self.rules):
            if found >> k & 1:
                for s, e in self.matches(k, text):
                    if e - s >= least and (not group or self._group_size(k, text[s:e]) >= group):
                        spans.append((s, k, e))
        if spans and not text.isascii():
            char = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
            spans = [(int(char[s]), k, int(char[e])) for s, k, e in spans]
        return [(k, s, e) for s, k, e in sorted(spans)]

    def _group_size(self, k: int, matched: bytes) -> int:
        m = self.group[k].fullmatch(matched)
        return len(m[m.re.groups]) if m else 0


@lru_cache(maxsize=8)
def scanner(rules=RULES) -> Scanner:
    return Scanner(rules)


def scan(df: DataFrame, keep: list[str], text: str = "text", rules=RULES) -> DataFrame:
    """``keep`` of each row beside ``secrets``: array<struct<kind, start, end>> in code points, end exclusive.

    Rows come out one for one, equal rows alike; a null or empty text has no
    secrets. Spans of different kinds may overlap, those of one kind don't.
    """
    out = "secrets array<struct<kind: string, start: int, end: int>>"
    kinds = [r[0] for r in rules]
    shared = df.sparkSession.sparkContext.broadcast(scanner(rules))  # of a size that the rules fix

    def run(batch: pa.RecordBatch) -> dict:
        s, found = shared.value, []
        for _, texts in textkit.text_slices(batch, text):
            found += [[{"kind": kinds[k], "start": a, "end": b} for k, a, b in s.scan(t)] for t in texts]
        return {"secrets": pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))}

    return frames.arrow_map(df.select(*dict.fromkeys([*keep, text])), run, keep, out)


def redact(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The same rows and columns, each secret in ``text`` replaced by ``[kind]``; overlapping spans become one, named by the first."""
    names = df.columns
    kinds = [r[0] for r in rules]
    shared = df.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batch: pa.RecordBatch) -> dict:
        s, out = shared.value, []
        valid = batch.column(batch.schema.get_field_index(text)).is_valid().to_pylist()
        for at, texts in textkit.text_slices(batch, text):
            for i, t in enumerate(texts):
                spans = s.scan(t)
                if not valid[at + i] or not spans:
                    out.append(t.decode() if valid[at + i] else None)
                    continue
                whole, made, upto = t.decode(), [], 0
                for k, a, b in spans:
                    if a >= upto:
                        made += [whole[upto:a], f"[{kinds[k]}]"]
                    upto = max(upto, b)
                out.append("".join([*made, whole[upto:]]))
        return {"__clean": pa.array(out, pa.string())}

    made = frames.arrow_map(df, run, [c for c in names], "__clean string")
    return made.withColumn(text, made["__clean"]).drop("__clean").select(*names)
