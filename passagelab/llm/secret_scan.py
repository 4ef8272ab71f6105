"""Secret scans by one deterministic automaton for all rules.

Rules are regular expressions over bytes (a small dialect: literals, classes, groups, `|`, `?`,
`*`, `+`, `{m}`, `{m,}`, `{m,n}`). They are parsed to one non-deterministic automaton, made
deterministic by subset construction over classes of equivalent bytes, and minimised by partition
refinement. The result is plain transition arrays.

Three automata come from the same rules: `search` (all rules, a match may begin anywhere) finds in one pass
over a text's bytes where some rule first ends; `back` (one for each rule, reversed) leads from such an
end to the leftmost beginning; `ahead` (one for each rule, anchored) leads from there to the
longest end. Matches of one rule are leftmost and do not overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelab.llm.common import map_batches

Tree = tuple
EMPTY: Tree = ("cat", ())


# ---- rules to trees ---------------------------------------------------------------------------------


class Parser:
    """Parses the dialect. Characters above one byte are not allowed; `any_case` folds ASCII letters."""

    def __init__(self, pattern: str, any_case: bool = False):
        self.text, self.at, self.any_case = pattern.encode("latin-1"), 0, any_case

    def parse(self) -> Tree:
        tree = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at:]!r}")
        return tree

    def peek(self) -> bytes:
        return self.text[self.at : self.at + 1]

    def take(self) -> int:
        if self.at >= len(self.text):
            raise ValueError("the pattern ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> Tree:
        found = [self.sequence()]
        while self.peek() == b"|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("or", tuple(found))

    def sequence(self) -> Tree:
        parts = []
        while self.peek() not in (b"", b"|", b")"):
            parts.append(self.repeated())
        return ("cat", tuple(parts))

    def repeated(self) -> Tree:
        tree = self.single()
        while (sign := self.peek()) in (b"?", b"*", b"+", b"{") and sign:
            self.take()
            if sign == b"{":
                end = self.text.index(b"}", self.at)
                low, comma, high = self.text[self.at : end].partition(b",")
                self.at = end + 1
                least, most = int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {b"?": (0, 1), b"*": (0, None), b"+": (1, None)}[sign]
            tree = repeat(tree, least, most)
        return tree

    def single(self) -> Tree:
        c = self.take()
        if c == ord("("):
            if self.text[self.at : self.at + 2] == b"?:":
                self.at += 2
            tree = self.alternatives()
            if self.take() != ord(")"):
                raise ValueError("a group is not closed")
            return tree
        if c == ord("["):
            return self.in_brackets()
        if c == ord("."):
            return ("set", frozenset(range(256)) - {10})
        if c == ord("\\"):
            return self.fold({self.escaped()})
        return self.fold({c})

    def escaped(self) -> int:
        c = self.take()
        if c == ord("x"):
            return int(bytes((self.take(), self.take())), 16)
        if chr(c).isalnum():
            raise ValueError(f"\\{chr(c)} is not supported")
        return c

    def in_brackets(self) -> Tree:
        inverse = self.peek() == b"^"
        self.at += inverse
        found: set[int] = set()
        first = True
        while (c := self.take()) != ord("]") or first:
            first = False
            low = self.escaped() if c == ord("\\") else c
            high = low
            if self.peek() == b"-" and self.text[self.at + 1 : self.at + 2] not in (b"]", b""):
                self.take()
                c = self.take()
                high = self.escaped() if c == ord("\\") else c
            found.update(range(low, high + 1))
        tree = self.fold(found)
        return ("set", frozenset(range(256)) - tree[1]) if inverse else tree

    def fold(self, found: set[int]) -> Tree:
        if self.any_case:
            found = found | {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return ("set", frozenset(found))


def repeat(tree: Tree, least: int, most: int | None) -> Tree:
    head = (tree,) * least
    if most is None:
        return ("cat", (*head, ("star", tree)))
    tail: Tree = EMPTY
    for _ in range(most - least):
        tail = ("or", (EMPTY, ("cat", (tree, tail))))
    return ("cat", (*head, tail))


def reversed_tree(tree: Tree) -> Tree:
    kind, inner = tree
    if kind == "cat":
        return (kind, tuple(reversed_tree(t) for t in reversed(inner)))
    if kind == "or":
        return (kind, tuple(map(reversed_tree, inner)))
    return (kind, reversed_tree(inner)) if kind == "star" else tree


# ---- trees to automata ---------------------------------------------------------------------------


class Nfa:
    """Empty moves and moves on sets of bytes; `accepts` names the rule of an end state."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: Tree, start: int) -> int:
        kind, inner = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((inner, end))
            return end
        if kind == "cat":
            for part in inner:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "or":
            for part in inner:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(part, begin)].append(end)
            return end
        loop = self.state()
        self.empty[start].append(loop)
        self.empty[self.add(inner, loop)].append(loop)
        self.empty[loop].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """rows[state][byte] is the next state; ends[state] are the rules that end there; `dead` never ends."""

    rows: tuple
    ends: tuple
    start: int
    dead: int | None


def compile_automaton(trees: dict[int, Tree], anywhere: bool) -> Automaton:
    """anywhere: matches may begin at any byte, and only their first ends count, so nothing leads on from an end."""
    nfa = Nfa()
    first = nfa.state()
    if anywhere:
        nfa.moves[first].append((frozenset(range(256)), first))
    for rule, tree in trees.items():
        begin = nfa.state()
        nfa.empty[first].append(begin)
        nfa.accepts[nfa.add(tree, begin)] = rule
    ending = {s for s in range(len(nfa.empty)) if anywhere and not nfa.accepts.keys().isdisjoint(nfa.closure({s}))}
    alike = byte_classes({chars for moves in nfa.moves for chars, _ in moves})
    members: dict[int, int] = {}
    for byte, k in enumerate(alike):
        members.setdefault(k, byte)
    letters = [members[k] for k in range(len(members))]

    start = nfa.closure({first})
    names, order, table = {start: 0}, [start], []
    for states in order:  # grows as new sets of states are met
        row = []
        for byte in letters:
            target = nfa.closure({t for s in states - ending for chars, t in nfa.moves[s] if byte in chars})
            if target not in names:
                names[target] = len(order)
                order.append(target)
            row.append(names[target])
        table.append(row)
    ends = [frozenset(nfa.accepts[s] for s in states if s in nfa.accepts) for states in order]
    return minimised(table, ends, alike)


def byte_classes(sets: set[frozenset]) -> list[int]:
    """For each byte the number of its class: bytes of one class lie in the same sets."""
    names: dict[tuple, int] = {}
    sets = sorted(sets, key=sorted)
    return [names.setdefault(tuple(b in chars for chars in sets), len(names)) for b in range(256)]


def minimised(table: list[list[int]], ends: list[frozenset], alike: list[int]) -> Automaton:
    """Refines the partition by ends until no block's members lead to different blocks."""
    names: dict = {}
    block = [names.setdefault(e, len(names)) for e in ends]
    while True:
        names = {}
        finer = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(table)]
        if len(names) == len(set(block)):
            break
        block = finer
    count = max(block) + 1
    sample = [block.index(b) for b in range(count)]
    rows = tuple(tuple(block[table[s][alike[byte]]] for byte in range(256)) for s in sample)
    out = tuple(tuple(sorted(ends[s])) for s in sample)
    dead = next((b for b in range(count) if not out[b] and set(rows[b]) == {b}), None)
    return Automaton(rows, out, block[0], dead)


# ---- rules and scanning ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """kind: what a span is called. keep: says of a match's bytes whether it counts; others are dropped after
    they have taken their place among the matches of the rule. base: one of the three rules of the contract."""

    kind: str
    pattern: str
    any_case: bool = False
    keep: Callable[[bytes], bool] = field(default=lambda found: True)
    base: bool = False


_ASSIGNED = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def long_value(found: bytes) -> bool:
    return len(_ASSIGNED.fullmatch(found)[1]) >= 12


def at_least(n: int) -> Callable[[bytes], bool]:
    return lambda found: len(found) >= n


def long_parts(found: bytes) -> bool:
    return all(len(part) >= 11 for part in found.split(b".")[:2]) and len(found.split(b".")[2]) >= 8


#: Lengths are left to `keep` where a run may hold another beginning of its rule: counting them would multiply the states.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, long_value, True),
    Rule("access", r"AKIA[A-Z0-9]+", keep=at_least(18), base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),  # runs: shorter ones hold no match
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", keep=long_parts),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", keep=at_least(40)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", keep=at_least(15)),
    Rule("url_login", r"[a-z][a-z]+://[A-Za-z0-9._-]+:[^\x00-\x20/@:]+@"),
)


class Scanner:
    """All rules' automata."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = {k: Parser(r.pattern, r.any_case).parse() for k, r in enumerate(rules)}
        self.search = compile_automaton(trees, True)
        self.ahead = [compile_automaton({0: t}, False) for t in trees.values()]
        self.back = [compile_automaton({0: reversed_tree(t)}, False) for t in trees.values()]
        if any(a.ends[a.start] for a in self.ahead):
            raise ValueError("a rule matches nothing at all")
        # states that end a rule come last, so that one comparison finds them
        order = sorted(range(len(self.search.rows)), key=lambda s: bool(self.search.ends[s]))
        to = {s: k for k, s in enumerate(order)}
        self.rows = [[to[t] for t in self.search.rows[s]] for s in order]
        self.ends = [self.search.ends[s] for s in order]
        self.first_end = sum(not e for e in self.ends)
        self.start = to[self.search.start]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes of all matches, whether they count or not, by rule and place."""
        rows, state, first_end = self.rows, self.start, self.first_end
        free = [0] * len(self.rules)  # where the next match of a rule may begin
        found = []
        for at, byte in enumerate(data, 1):
            state = rows[state][byte]
            if state >= first_end:
                for rule in self.ends[state]:
                    if at > free[rule]:
                        start = self._begin(data, rule, at, free[rule])
                        if start is not None:
                            free[rule] = self._end(data, rule, start)
                            found.append((start, free[rule], rule))
        return found

    def _begin(self, data: bytes, rule: int, at: int, least: int) -> int | None:
        """The leftmost beginning, not before `least`, of a match that ends at `at`."""
        automaton = self.back[rule]
        state, best = automaton.start, None
        for k in range(at - 1, least - 1, -1):
            state = automaton.rows[state][data[k]]
            if state == automaton.dead:
                break
            if automaton.ends[state]:
                best = k
        return best

    def _end(self, data: bytes, rule: int, start: int) -> int:
        """The longest end of a match that begins at `start`."""
        automaton = self.ahead[rule]
        state, best = automaton.start, start
        for k in range(start, len(data)):
            state = automaton.rows[state][data[k]]
            if state == automaton.dead:
                break
            if automaton.ends[state]:
                best = k + 1
        return best

    def scan(self, text: str | None) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) in code points of the matches that count, by start and then by the rules' order."""
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        found = sorted((a, k, b) for a, b, k in self.spans(data) if self.rules[k].keep(data[a:b]))
        if len(data) == len(text):
            return [(a, b, self.rules[k]) for a, k, b in found]
        out, byte, point = [], 0, 0
        for a, k, b in found:
            point += len(data[byte:a].decode("utf-8", "surrogatepass"))
            byte = a
            out.append((point, point + len(data[a:b].decode("utf-8", "surrogatepass")), self.rules[k]))
        return out


_scanners: dict[int, Scanner] = {}


def scanner() -> Scanner:
    """The scanner for RULES, compiled once in each Python process."""
    if 0 not in _scanners:
        _scanners[0] = Scanner()
    return _scanners[0]


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, end, kind, base, text>>) of each row, in code points, end exclusive.

    Null and empty texts have no spans. Every row gives one row, repeated and null ids too; an empty table
    gives none; other columns are ignored.
    """
    schema = "id long, spans array<struct<start: long, end: long, kind: string, base: boolean, text: string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                rows.append([{"start": a, "end": b, "kind": r.kind, "base": r.base, "text": text[a:b]} for a, b, r in scan(text)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "spans"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(chosen, run, schema)


def span_list(spans: str, base: bool = False):
    """kind:start:end of an array of spans, comma-joined, as a column."""
    chosen = f"filter({spans}, s -> s.base)" if base else spans
    return F.expr(f"array_join(transform({chosen}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of the three base kinds, the digest of their spans, and all spans."""
    found = spans_of(docs)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(span_list("spans", True).cast("binary"), 256).alias("base_sha256"), span_list("spans").alias("spans"))


def fingerprint_of(secret: str) -> str:
    """A digest under which a found secret may be reported without being shown."""
    return hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()[:16]
