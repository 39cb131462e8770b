"""Secrets in texts: base patterns, and formats learned from what they find.

The base patterns label credentials. From a bounded sample of each kind a prefix tree is
built over classes of characters, and its statistically compatible states are merged into
a probabilistic automaton (two states are compatible if their frequencies of ending and
of each next class, and those of their successors, differ by less than Hoeffding's bound).
An automaton of ordinary long words is learned the same way. Every candidate, a long run
of credential characters, is scored by the likelihood of its format under the automata;
those far likelier as a credential than as a word are secrets, too, whether or not a base
pattern matches a part of them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mapped, sliced, written

#: The base patterns, in the order in which kinds are listed, and their least lengths.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs of 16 or more
KINDS = ("assign", "access", "hex", "format")
LEAST = {"assign": 12, "access": 18}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PER_KIND = 500  # credentials of each kind, and ordinary words, to learn from, at most
ALPHA = 0.01  # of Hoeffding's bound
UNSEEN = 1e-4  # probability of a class that a state never saw
MARGIN = 16.0  # nats by which a credential's likelihood exceeds a word's
FLOOR = -1.6  # nats per character that a credential's likelihood has at least
MEMO_FORMATS = 200_000

_CLASSES = str.maketrans(
    {c: "d" for c in "0123456789"}
    | {c: "h" for c in "abcdef"}
    | {c: "l" for c in "ghijklmnopqrstuvwxyz"}
    | {c: "H" for c in "ABCDEF"}
    | {c: "L" for c in "GHIJKLMNOPQRSTUVWXYZ"}
)
ALPHABET = "dhlHL+/_=-."


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, secret start) of the base matches: leftmost, not overlapping within a kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            found.append((m.start(), 0, m.end(), m.start(2)))
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def covered(spans: list[tuple[int, int]], wanted: list[tuple[int, int]], whole: bool) -> list[bool]:
    """For each of the (start, end) of ``wanted``, which follow each other: whether one of ``spans`` (sorted by start)
    meets it, or holds it as a whole. One sweep over both."""
    out, i, ends = [], 0, -1
    for start, end in wanted:
        # The farthest end of the spans that start in time: at the start at the latest, or before the end.
        while i < len(spans) and (spans[i][0] <= start if whole else spans[i][0] < end):
            ends = max(ends, spans[i][1])
            i += 1
        out.append(ends >= end if whole else ends > start)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of (start, kind, end), by start and then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def format_of(candidate: str) -> str:
    return candidate.translate(_CLASSES)


@dataclass
class State:
    n: int = 0
    ends: int = 0
    arcs: dict[str, int] = field(default_factory=dict)
    passed: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton over character classes, merged from a prefix tree."""

    def __init__(self, formats: list[str], alpha: float = ALPHA):
        self.states = [State()]
        self.alpha = alpha
        for f in formats:
            at = 0
            for c in f:
                state = self.states[at]
                state.n += 1
                state.passed[c] = state.passed.get(c, 0) + 1
                if c not in state.arcs:
                    state.arcs[c] = len(self.states)
                    self.states.append(State())
                at = state.arcs[c]
            self.states[at].n += 1
            self.states[at].ends += 1
        self._merge()

    def _near(self, a: int, n: int, b: int, m: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(a / n - b / m) < bound

    def _compatible(self, a: int, b: int) -> bool:
        """Whether two states, and what follows them, may be one."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.states[a], self.states[b]
            if not x.n or not y.n:
                continue
            if not self._near(x.ends, x.n, y.ends, y.n):
                return False
            for c in {*x.passed, *y.passed}:
                if not self._near(x.passed.get(c, 0), x.n, y.passed.get(c, 0), y.n):
                    return False
            todo += [(x.arcs[c], y.arcs[c]) for c in x.arcs if c in y.arcs and x.arcs[c] != y.arcs[c]]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a tree to a state and those that follow it."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            x, y = self.states[a], self.states[b]
            x.n += y.n
            x.ends += y.ends
            for c, count in y.passed.items():
                x.passed[c] = x.passed.get(c, 0) + count
            for c, after in y.arcs.items():
                if c in x.arcs:
                    todo.append((x.arcs[c], after))
                else:
                    x.arcs[c] = after

    def _merge(self) -> None:
        """Red states are settled; each other successor of one is merged into the first compatible, or settled."""
        red, open_arcs = [0], [(0, c) for c in sorted(self.states[0].arcs)]
        settled = {0}
        while open_arcs:
            # The most frequent first: its counts tell most.
            open_arcs.sort(key=lambda x: (self.states[self.states[x[0]].arcs[x[1]]].n, -x[0], x[1]))
            source, c = open_arcs.pop()
            blue = self.states[source].arcs[c]
            if blue in settled:
                continue
            target = next((r for r in red if self._compatible(r, blue)), None)
            if target is None:
                settled.add(blue)
                red.append(blue)
                open_arcs += [(blue, d) for d in sorted(self.states[blue].arcs)]
            else:
                self.states[source].arcs[c] = target
                self._fold(target, blue)
                open_arcs = [(r, d) for r in red for d in sorted(self.states[r].arcs) if self.states[r].arcs[d] not in settled]
        order = {r: i for i, r in enumerate(red)}
        kept = [self.states[r] for r in red]
        for state in kept:
            state.arcs = {c: order[t] for c, t in state.arcs.items()}
        self.states = kept

    def log_likelihood(self, format: str) -> float:
        """Log probability of a format: classes never seen in a state have a small one, and lead to the start."""
        total, at = 0.0, 0
        for c in format:
            state = self.states[at]
            count = state.passed.get(c, 0)
            total += math.log(count / state.n * (1 - UNSEEN * len(ALPHABET)) + UNSEEN) if state.n else math.log(UNSEEN)
            at = state.arcs.get(c, 0)
        state = self.states[at]
        return total + math.log(max(state.ends / state.n if state.n else 0.0, UNSEEN))


@dataclass
class Formats:
    """Automata of the kinds of credentials, and of ordinary words."""

    credentials: list[Automaton]
    words: Automaton | None

    def margin(self, format: str) -> float:
        """Log of how much likelier a format is as a credential than as a word; -inf if it is likely as neither."""
        if not self.credentials or self.words is None:
            return -math.inf
        best = max(a.log_likelihood(format) for a in self.credentials)
        return best - self.words.log_likelihood(format) if best >= FLOOR * len(format) else -math.inf


def learn(docs: DataFrame, per_kind: int = PER_KIND) -> Formats:
    """Automata from at most ``per_kind`` distinct credentials of each kind and as many other candidates.

    All texts are searched; of each kind the values with the smallest hashes are taken, so the
    sample that goes to the driver is bounded and the same on every run.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task passes on its smallest hashes only: no others can be among the smallest of all.
        seen: list[dict[str, bytes]] = [{} for _ in KINDS]
        for _, texts in batches(rows):
            for text in filter(None, texts):
                spans = base_spans(text)
                for _, kind, end, secret in spans:
                    seen[kind].setdefault(text[secret:end], b"")
                candidates = [m.span() for m in CANDIDATE.finditer(text)]
                met = covered([(s, e) for s, _, e, _ in spans], candidates, whole=False)
                for (start, end), known in zip(candidates, met, strict=True):
                    if not known:
                        seen[3].setdefault(text[start:end], b"")
            for kind, found in enumerate(seen):
                if len(found) > 4 * per_kind:
                    seen[kind] = dict.fromkeys(sorted(found, key=_rank)[:per_kind], b"")
        out = [(k, v, _rank(v)) for k, found in enumerate(seen) for v in sorted(found, key=_rank)[:per_kind]]
        kinds, values, ranks = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(values, pa.string()), pa.array(ranks, pa.string())], names=["kind", "value", "rank"]
        )

    texts = docs.select(F.lit(0).alias("doc_id"), "text")
    # Written, so that the texts are searched once for all kinds; a task gives four bounded samples.
    found = written(mapped(texts, run, "kind int, value string, rank string"), "credentials").distinct()
    taken = [found.where(F.col("kind") == k).orderBy("rank", "value").limit(per_kind) for k in range(len(KINDS))]
    sample = taken[0].union(taken[1]).union(taken[2]).union(taken[3]).toArrow()
    values: list[list[str]] = [[] for _ in KINDS]
    for kind, value in zip(sample["kind"].to_pylist(), sample["value"].to_pylist(), strict=True):
        values[kind].append(value)
    made = [Automaton([format_of(v) for v in sorted(own)]) if own else None for own in values]
    return Formats([a for a in made[:3] if a], made[3])


def _rank(value: str) -> str:
    return hashlib.md5(value.encode()).hexdigest()


class Scanner:
    """Finds spans; remembers how formats score."""

    def __init__(self, formats: Formats, margin: float = MARGIN):
        self.formats, self.margin = formats, margin
        self.memo: dict[str, bool] = {}

    def _secret(self, candidate: str) -> bool:
        key = format_of(candidate)
        if key not in self.memo:
            if len(self.memo) >= MEMO_FORMATS:
                self.memo = {}
            self.memo[key] = self.formats.margin(key) >= self.margin
        return self.memo[key]

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans) of a text, each (start, kind, end)."""
        if not text:
            return [], []
        base = [(s, k, e) for s, k, e, _ in base_spans(text)]
        candidates = [m.span() for m in CANDIDATE.finditer(text)]
        known = covered([(s, e) for s, _, e in base], candidates, whole=True)
        secret = [self._secret(text[s:e]) for s, e in candidates]
        # What a base span holds as a whole is told already.
        return base, base + [(s, 3, e) for (s, e), told, yes in zip(candidates, known, secret, strict=True) if yes and not told]


def scan(docs: DataFrame, formats: Formats | None = None, margin: float = MARGIN) -> DataFrame:
    """Secrets of every document of (doc_id, text, ...): counts of base matches, and all spans.

    Without ``formats`` they are learned from the documents themselves. Returns a row per row:
    doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as text), spans (all spans
    as kind:start:end in code points, by start). NULL and empty texts have none; repeated rows are
    repeated; other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats or learn(docs))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, margin)
        for doc_ids, texts in batches(rows):
            found = [scanner.spans(t) for t in texts]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([joined(spans) for _, spans in found], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    columns = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return mapped(docs.select(F.col("doc_id").cast("bigint"), "text"), run, columns)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """A text with each span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, formats: Formats, margin: float = MARGIN) -> DataFrame:
    """``docs``, all rows and columns, with secrets masked in ``text``, and ``n_chars`` (if there) the new length."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, margin)
        for batch in sliced(rows, text_at):
            old = batch.column(text_at).to_pylist()
            new = [masked(t, s) if t and (s := scanner.spans(t)[1]) else t for t in old]
            columns = list(batch.columns)
            columns[text_at] = pa.array(new, pa.string())
            if chars_at is not None:
                sizes = batch.column(chars_at).to_pylist()
                sizes = [len(b) if a != b else n for a, b, n in zip(old, new, sizes, strict=True)]
                columns[chars_at] = pa.array(sizes, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return mapped(docs, run, docs.schema)
