"""Secret scan with one combined deterministic automaton over bytes.

Every rule is a regular expression of a prefix, a run of body characters and a least number of them. All rules are compiled
together: parsed into a nondeterministic automaton, made deterministic by subset construction, minimised by partition
refinement, and laid out as one transition array over classes of equivalent bytes.

Two automata are built that way. The *start finder* reads a text from its end and is in an accepting state exactly at the
places where some rule can match; one pass over the bytes serves all rules. The *matcher* runs forward from such a place, for
all rules at once, as long as any of them can go on. Leftmost matches that do not overlap within a rule follow from these.

The pass is done in lockstep over many lines: bytes that take every state back to the start (for the default rules the line
feed) cut texts into independent segments, and one NumPy step advances all segments of an Arrow batch by a byte. When only
a few long segments are left they are finished in a plain loop, so one very long line costs no more per byte than many short
ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigspark.llm.common import per_batch, texts


@dataclass(frozen=True)
class Rule:
    """``prefix`` then as many ``body`` characters as there are; matches with fewer than ``least`` of them are consumed but
    not reported. Classes, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}`` and ``\\xHH`` are understood; all ASCII."""

    kind: str
    prefix: str
    body: str
    least: int
    any_case: bool = False  # letters of the prefix


#: The first three are the rules whose spans are compared, in their order; the others are added.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
    Rule("git", "(gh[pousr]_|glpat-)", "[A-Za-z0-9_-]", 20),
    Rule("chat", "xox[abeoprs]-", "[A-Za-z0-9-]", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\x2eeyJ[A-Za-z0-9_-]+\x2e", "[A-Za-z0-9_-]", 8),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY", "-", 5),
)
BASE = 3


# --- regular expressions: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)


def parse(pattern: str, any_case: bool = False) -> tuple:
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def character() -> int:
        nonlocal at
        if pattern.startswith("\\x", at):
            at += 4
            return int(pattern[at - 2 : at], 16)
        if pattern[at] == "\\":
            at += 1
        at += 1
        return ord(pattern[at - 1])

    def both(codes: Iterable[int]) -> tuple:
        codes = set(codes)
        if any_case:
            codes |= {c ^ 32 for c in codes if chr(c & ~32).isalpha() and c < 128}
        return ("set", frozenset(codes))

    def atom() -> tuple:
        nonlocal at
        if peek() == "(":
            at += 1
            inner = alternatives()
            at += 1
            return inner
        if peek() == "[":
            at += 1
            codes: set[int] = set()
            while peek() != "]":
                low = character()
                high = low
                if peek() == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = character()
                codes |= set(range(low, high + 1))
            at += 1
            return both(codes)
        return both([character()])

    def repeated() -> tuple:
        nonlocal at
        part = atom()
        while peek() and peek() in "?*+{":
            sign = peek()
            at += 1
            if sign == "{":
                close = pattern.index("}", at)
                low, comma, high = pattern[at:close].partition(",")
                at = close + 1
                part = ("rep", part, int(low), int(high) if high else None if comma else int(low))
            else:
                part = ("rep", part, int(sign == "+"), 1 if sign == "?" else None)
        return part

    def sequence() -> tuple:
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def alternatives() -> tuple:
        nonlocal at
        parts = [sequence()]
        while peek() == "|":
            at += 1
            parts.append(sequence())
        return ("alt", parts)

    return alternatives()


def backwards(node: tuple) -> tuple:
    if node[0] == "cat":
        return ("cat", [backwards(p) for p in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [backwards(p) for p in node[1]])
    if node[0] == "rep":
        return ("rep", backwards(node[1]), node[2], node[3])
    return node


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node: tuple, start: int) -> int:
        """Appends ``node`` after ``start``; returns its end state."""
        if node[0] == "set":
            here, end = self.state(), self.state()
            self.empty[start].append(here)
            self.moves[here] = (node[1], end)
            return end
        if node[0] == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if node[0] == "alt":
            end = self.state()
            for part in node[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``table[state * n_classes + classes[byte]]`` is the next state; ``accept[state]`` the bits of what ends there.

    State 0 is the start. ``dead`` is the state that nothing leaves, or -1.
    """

    classes: np.ndarray
    n_classes: int
    table: np.ndarray
    accept: np.ndarray
    dead: int


def compile_automaton(patterns: list[tuple[tuple, int]], anywhere: bool) -> Automaton:
    """One minimal automaton for (expression, accepting bit) pairs; ``anywhere`` lets a match start at every byte."""
    nfa = _Nfa()
    start = nfa.state()
    accepting: dict[int, int] = {}
    for node, bit in patterns:
        first = nfa.state()
        nfa.empty[start].append(first)
        end = nfa.add(node, first)
        accepting[end] = accepting.get(end, 0) | 1 << bit
    # bytes that no expression tells apart share a class
    kinds: dict[tuple, int] = {}
    sets = list({m[0] for m in nfa.moves if m})
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], dtype=np.int64)
    sample = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]

    def closed(states: Iterable[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(s for s in found if nfa.moves[s] or s in accepting)

    closure = {s: closed([s]) for s in {start, *(m[1] for m in nfa.moves if m)}}
    restart = closure[start] if anywhere else frozenset()
    numbers = {closure[start]: 0}
    todo, rows, bits = [closure[start]], [], []
    for current in todo:  # subset construction; todo grows
        bits.append(sum({accepting[s] for s in current if s in accepting}) if len(
            {accepting[s] for s in current if s in accepting}) < 2 else int(np.bitwise_or.reduce(
                [accepting[s] for s in current if s in accepting])))
        row = []
        for byte in sample:
            target = set(restart)
            for s in current:
                move = nfa.moves[s]
                if move and byte in move[0]:
                    target |= closure[move[1]]
            target = frozenset(target)
            if target not in numbers:
                numbers[target] = len(numbers)
                todo.append(target)
            row.append(numbers[target])
        rows.append(row)
    table, accept = np.array(rows, dtype=np.int64), np.array(bits, dtype=np.int64)
    # minimisation: split blocks of states until all their moves lead to the same blocks
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1, dtype=np.int64)
    firsts: list[int] = []
    for s, b in enumerate(block):  # blocks numbered by first state, so the start stays 0
        if order[b] < 0:
            order[b] = len(firsts)
            firsts.append(s)
    table, accept = order[block[table[firsts]]], accept[firsts]
    stuck = np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & (accept == 0))
    return Automaton(classes, len(kinds), table.ravel(), accept, int(stuck[0]) if len(stuck) else -1)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    starts: Automaton
    match: Automaton
    cuts: np.ndarray  # bytes after which the start finder is back at its start


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once on the driver; the arrays go to the tasks with the job."""
    starts, match = [], []
    for k, rule in enumerate(rules):
        prefix, body = parse(rule.prefix, rule.any_case), parse(rule.body)
        # without a prefix a match is a whole run of body characters, and only runs that are long enough matter
        scan = ("cat", [prefix, body]) if rule.prefix else ("rep", body, rule.least, rule.least)
        starts.append((backwards(scan), k))
        match.append((("cat", [prefix, ("rep", body, 1, None)]), 2 * k))
        match.append((("cat", [prefix, ("rep", body, rule.least, None)]), 2 * k + 1))
    finder = compile_automaton(starts, anywhere=True)
    by_class = finder.table.reshape(-1, finder.n_classes)
    cuts = (by_class == 0).all(0)[finder.classes]
    return Scanner(rules, finder, compile_automaton(match, anywhere=False), cuts)


def find_starts(data: np.ndarray, limits: np.ndarray, scanner: Scanner, few: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(places where a rule can match, bits of these rules), ascending. ``limits`` are the ends of the texts in ``data``."""
    finder = scanner.starts
    # a segment ends after a cutting byte or a text
    ends = np.unique(np.concatenate([np.flatnonzero(scanner.cuts[data]) + 1, limits])).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    order = np.argsort(begins - ends, kind="stable")
    length = (ends - begins)[order]
    place = ends[order] - 1
    state = np.zeros(len(order), dtype=np.int32)
    codes = finder.classes.astype(np.uint8)[data]
    table = (finder.table * finder.n_classes).astype(np.int32)  # states as row offsets
    accept = np.repeat(finder.accept, finder.n_classes).astype(np.int32)
    # how many segments are still running after each number of steps
    running = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left").tolist()
    found, bits = [], []
    active, step = len(order), 0
    for active in running:
        if active <= few:
            break
        at = place[:active] - step
        now = table.take(state[:active] + codes.take(at))
        state[:active] = now
        hit = accept.take(now)
        if hit.any():
            some = np.flatnonzero(hit)
            found.append(at[some])
            bits.append(hit[some].astype(np.int64))
        step += 1
    if active <= few:
        moves, kinds = table.tolist(), accept.tolist()
        tail_at, tail_bits = [], []
        for i in range(active):
            s, end = int(state[i]), int(place[i]) - step
            at = end
            for code in codes[end + 1 - (int(length[i]) - step) : end + 1][::-1].tolist():
                s = moves[s + code]
                if kinds[s]:
                    tail_at.append(at)
                    tail_bits.append(kinds[s])
                at -= 1
        found.append(np.array(tail_at, dtype=np.int64))
        bits.append(np.array(tail_bits, dtype=np.int64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, bits = np.concatenate(found), np.concatenate(bits)
    order = np.argsort(found, kind="stable")
    return found[order], bits[order]


def spans(batch: list[str], scanner: Scanner) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) of every match in every text, in code points, by start and then by rule."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in batch]
    limits = np.cumsum([len(e) for e in encoded])
    whole = b"".join(encoded)
    data = np.frombuffer(whole, dtype=np.uint8)
    out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    if not len(data):
        return out
    places, bits = find_starts(data, limits[limits > 0], scanner)
    owner = np.searchsorted(limits, places, side="right")
    match = scanner.match
    table, accept, classes, wide = match.table.tolist(), match.accept.tolist(), match.classes.tolist(), match.n_classes
    free: list[int] = []
    current = -1
    for place, bit, text in zip(places.tolist(), bits.tolist(), owner.tolist()):
        if text != current:
            current, free, limit = text, [0] * len(scanner.rules), int(limits[text])
        wanted = [k for k in range(len(free)) if bit >> k & 1 and free[k] <= place]
        if not wanted:
            continue
        state, at, last = 0, place, {}
        while at < limit:
            state = table[state * wide + classes[whole[at]]]
            if state == match.dead:
                break
            at += 1
            if accept[state]:
                for k in wanted:
                    if accept[state] >> 2 * k & 1:
                        last[k] = (at, accept[state] >> 2 * k + 1 & 1)
        for k in wanted:
            if k in last:
                free[k] = last[k][0]
                if last[k][1]:
                    out[text].append((place, k, last[k][0]))
    for i, found in enumerate(out):
        if found:
            base = int(limits[i]) - len(encoded[i])
            if batch[i].isascii():
                out[i] = sorted((s - base, k, e - base) for s, k, e in found)
            else:
                before = np.cumsum((np.frombuffer(encoded[i], np.uint8) & 0xC0) != 0x80)
                points = np.concatenate([[0], before])
                out[i] = sorted((int(points[s - base]), k, int(points[e - base])) for s, k, e in found)
    return out


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id and ``found``, an array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans. Repeated rows are scanned each; other columns are ignored.
    """
    scanner = compile_rules(rules)
    kind = documents.schema["doc_id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            [{"kind": scanner.rules[k].kind, "start": s, "end": e} for s, k, e in found]
            for found in spans(texts(batch.column("text")), scanner)
        ]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, struct)], ["doc_id", "found"])

    return documents.select("doc_id", "text").mapInArrow(
        per_batch(run), f"doc_id {kind}, found array<struct<kind string, start long, end long>>"
    )


def secrets_query(documents: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(documents)

    def joined(condition) -> object:
        part = F.filter("found", condition)
        return F.array_join(F.transform(part, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str) -> object:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = [rule.kind for rule in RULES[:BASE]]
    return found.select(
        "doc_id",
        *[number(kind) for kind in base],
        F.sha2(joined(lambda x: x["kind"].isin(*base)), 256).alias("base_sha256"),
        joined(lambda x: F.lit(True)).alias("spans"),
    )


def reference_digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
