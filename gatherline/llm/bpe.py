"""Byte-pair encoding and decoding by a token automaton.

The merges are compiled, one after another, into a deterministic automaton over
tokens. It starts as one state with a loop for every byte. A merge (u, v) -> w is a
gadget: a path q -u-> p -v-> r becomes q -w-> r, and u now leads to a copy of p that
lacks v. What an arc leads to depends on its label only, so the automaton is three
tables: the state a token leads to, the class of tokens that the same states allow,
and which state allows which class. It accepts exactly the token sequences that the
merges produce; every text has one of them.

A pre-split word is encoded by transitions over its bytes: each prefix has exactly one
accepted tokenization, so one state per position is enough, and position k follows
from position j if a token spells the bytes between and the state at j allows it.
Many words take these steps together as numpy columns. Decoding emits the labels of
the arcs. Words repeat, so a bounded memo keeps the arcs of words already encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, kept, mapped, release_memory

MEMO_UNITS = 300_000
VECTOR_BYTES = 96  # longer words take their steps one by one
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


#: Letters (L) and numbers (N) that Unicode 16.0 added; Python's own table may be older.
UNICODE_16 = [
    ("L", 0x1C89, 0x1C8A), ("L", 0xA7CB, 0xA7CD), ("L", 0xA7DA, 0xA7DC), ("L", 0x105C0, 0x105F3),
    ("N", 0x10D40, 0x10D49), ("L", 0x10D4A, 0x10D65), ("L", 0x10D6F, 0x10D85), ("L", 0x10EC2, 0x10EC4),
    ("L", 0x11380, 0x11389), ("L", 0x1138B, 0x1138B), ("L", 0x1138E, 0x1138E), ("L", 0x11390, 0x113B5),
    ("L", 0x113B7, 0x113B7), ("L", 0x113D1, 0x113D1), ("L", 0x113D3, 0x113D3), ("N", 0x116D0, 0x116E3),
    ("L", 0x11BC0, 0x11BE0), ("N", 0x11BF0, 0x11BF9), ("L", 0x13460, 0x143FA), ("L", 0x16100, 0x1611D),
    ("N", 0x16130, 0x16139), ("L", 0x16D40, 0x16D6C), ("N", 0x16D70, 0x16D79), ("L", 0x18CFF, 0x18CFF),
    ("N", 0x1CCF0, 0x1CCF9), ("L", 0x1E5D0, 0x1E5ED), ("L", 0x1E5F0, 0x1E5F0), ("N", 0x1E5F1, 0x1E5FA),
]


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: symbol -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _runs(codes: list[int]) -> str:
    """A regular-expression class body of sorted code points."""
    out, start, last = [], None, None
    for c in [*codes, None]:
        if start is not None and c != last + 1:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
        if c is not None and start is None:
            start = c
        last = c
    return "".join(out)


def splitter() -> re.Pattern:
    """The byte-level word pattern, with letters and numbers by Unicode category."""
    kinds: dict[str, list[int]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        if (kind := unicodedata.category(chr(c))[0]) in kinds:
            kinds[kind].append(c)
    for kind, first, last in UNICODE_16:
        kinds[kind] = sorted({*kinds[kind], *range(first, last + 1)})
    letter, number = _runs(kinds["L"]), _runs(kinds["N"])
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


def _widened(bits: np.ndarray, rows: int, columns: int, more_rows: int, more_bytes: int) -> np.ndarray:
    """``bits`` with room for more rows or bytes; only what is in use is copied."""
    out = np.zeros((len(bits) + more_rows, bits.shape[1] + more_bytes), np.uint8)
    out[:rows, : -(-columns // 8)] = bits[:rows, : -(-columns // 8)]
    return out


class Automaton:
    """The compiled merges. ``Automaton.load(path)`` reads a byte-level BPE vocabulary file."""

    def __init__(self, labels: list[bytes | None], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = labels, special
        self._compile(merges)

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, added = stored["model"], stored["added_tokens"]
        kept = [stored["normalizer"], model.get("dropout"), model.get("unk_token"), model.get("end_of_word_suffix")]
        pre = stored["pre_tokenizer"]
        if model["type"] != "BPE" or any(kept) or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens with stripping or word rules are not supported")
        symbols, vocab = byte_symbols(), model["vocab"]
        special = {a["content"]: a["id"] for a in added}
        labels: list[bytes | None] = [None] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            labels[i] = bytes(symbols[c] for c in token)
        for token, i in special.items():
            labels[i] = token.encode()
        merges = []
        for pair in model["merges"]:
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        return cls(labels, merges, special)

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        n = len(self.labels)
        made, reserved = {w for _, _, w in merges}, set(self.special.values())
        state, group = np.zeros(n, np.int32), np.zeros(n, np.int32)  # class 0: tokens that never occur
        for t, label in enumerate(self.labels):
            if t not in made and t not in reserved and label is not None and len(label) == 1:
                group[t] = 1
        # A bit per state and class, first bit high; rows and columns are added as they are needed.
        allowed = np.zeros((1 << 12, 1 << 9), np.uint8)
        allowed[0, 0] = 1 << 6  # class 1 in state 0
        in_state, in_group = [0] * (len(merges) + 2), [0] * (len(merges) + 3)
        in_state[0] = 1 + int((group == 1).sum())  # the start is in state 0, too
        in_group[1] = int((group == 1).sum())
        n_states, n_groups = 1, 2
        state_of, group_of = state.tolist(), group.tolist()
        for u, v, w in merges:
            c = group_of[v]
            if not group_of[u] or not c or not allowed[state_of[u], c >> 3] >> (7 - (c & 7)) & 1:
                continue  # v never follows u here, so w never occurs
            r = state_of[w] = state_of[v]
            in_state[r] += 1
            p = state_of[u]
            if n_states == len(allowed):
                allowed = _widened(allowed, n_states, n_groups, 1 << 12, 0)
            if n_groups == allowed.shape[1] * 8:
                allowed = _widened(allowed, n_states, n_groups, 0, 1 << 9)
            if in_state[p] > 1:  # u leads to a copy of its own
                allowed[n_states] = allowed[p]
                in_state[p] -= 1
                state_of[u], in_state[n_states] = n_states, 1
                n_states += 1
            if in_group[c] > 1:
                bits = allowed[:n_states, c >> 3] >> (7 - (c & 7)) & 1
                allowed[:n_states, n_groups >> 3] |= bits << (7 - (n_groups & 7))
                in_group[c] -= 1
                group_of[v], in_group[n_groups] = n_groups, 1
                n_groups += 1
            g = group_of[v]
            allowed[state_of[u], g >> 3] &= ~(1 << (7 - (g & 7))) & 255
            group_of[w] = group_of[u]
            in_group[group_of[w]] += 1
        self.state_of, self.group_of = np.array(state_of, np.int32), np.array(group_of, np.int32)
        self.allowed = allowed[:n_states, : -(-n_groups // 8)].copy()

    def spell(self) -> None:
        """Tables of the transitions over bytes: a trie of the labels of tokens that occur."""
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for t, label in enumerate(self.labels):
            if label is None or not self.group_of[t]:
                continue
            node = 0
            for b in label:
                if (after := children[node].get(b)) is None:
                    after = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = after
            ends[node] = t
        self.trie = np.zeros((len(children), 256), np.int32)  # 0: no such token
        for node, arcs in enumerate(children):
            for b, after in arcs.items():
                self.trie[node, b] = after
        self.ends = np.array(ends, np.int32)
        self.first = np.full(256, -1, np.int32)
        self.memo: dict[str, bytes] = {}
        self.split = splitter()
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _together(self, spelled: list[bytes]) -> list[bytes]:
        """Arcs of words of up to ``VECTOR_BYTES`` bytes, all words in step."""
        size = np.array([len(w) for w in spelled])
        n, most = len(spelled), int(size.max())
        text = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in spelled), np.uint8).reshape(n, most).T
        state, back, arc = (np.zeros((most + 1, n), np.int32) for _ in range(3))
        trie, ends = self.trie.reshape(-1), self.ends
        for j in range(most):
            at = np.flatnonzero(size > j)
            node = np.zeros(len(at), np.int32)
            for k in range(j, most):
                node = trie[node * 256 + text[k, at]]
                live = np.flatnonzero((node > 0) & (size[at] > k))
                if not len(live):
                    break
                at, node = at[live], node[live]
                token = ends[node]
                group = self.group_of[token]
                ok = np.flatnonzero((token >= 0) & (self.allowed[state[j, at], group >> 3] >> (7 - (group & 7)) & 1 > 0))
                here, token = at[ok], token[ok]
                state[k + 1, here], back[k + 1, here], arc[k + 1, here] = self.state_of[token], j, token
        out, filled, at, where = np.zeros((n, most), "<u4"), np.full(n, most), np.arange(n), size.copy()
        while len(at):
            filled[at] -= 1
            out[at, filled[at]] = arc[where[at], at]
            where[at] = back[where[at], at]
            at = at[where[at] > 0]
        whole, row = out.tobytes(), 4 * most
        return [whole[i * row + 4 * f : (i + 1) * row] for i, f in enumerate(filled.tolist())]

    def _alone(self, word: bytes) -> bytes:
        """The same steps for one long word."""
        trie, ends = memoryview(self.trie.reshape(-1)), memoryview(self.ends)
        state, back, arc = ([0] * (len(word) + 1) for _ in range(3))
        state_of, group_of, allowed = memoryview(self.state_of), memoryview(self.group_of), self.allowed
        for j in range(len(word)):
            node, here = 0, allowed[state[j]].tobytes()
            for k in range(j, len(word)):
                if not (node := trie[node * 256 + word[k]]):
                    break
                if (t := ends[node]) >= 0 and here[(g := group_of[t]) >> 3] >> (7 - (g & 7)) & 1:
                    state[k + 1], back[k + 1], arc[k + 1] = state_of[t], j, t
        out, k = [], len(word)
        while k:
            out.append(arc[k])
            k = back[k]
        return np.array(out[::-1], "<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The arcs of distinct pre-split words."""
        new = sorted(((w, w.encode()) for w in words), key=lambda x: len(x[1]))
        short = 0
        while short < len(new) and len(new[short][1]) <= VECTOR_BYTES:
            short += 1
        out: dict[str, bytes] = {}
        for i in range(0, short, 8192):
            part = new[i : min(i + 8192, short)]
            out.update(zip((w for w, _ in part), self._together([b for _, b in part]), strict=True))
        out.update((w, self._alone(b)) for w, b in new[short:])
        return out

    def _remember(self, units: set[str]) -> None:
        """Put the arcs of every unit, with the space before it, in the memo; None if it can't stand alone."""
        new = units.difference(self.memo)
        if len(self.memo) + len(new) > MEMO_UNITS:
            self.memo, new = {}, units
        findall = self.split.findall
        split = {u: findall(" " + u) if u and not u[0].isspace() and not u[-1].isspace() else None for u in new}
        arcs = self._words(list({w for words in split.values() if words for w in words}))
        self.memo.update(
            (u, None if words is None else arcs[words[0]] if len(words) == 1 else b"".join([arcs[w] for w in words]))
            for u, words in split.items()
        )

    def _whole(self, text: str) -> bytes:
        """Arcs of a text split by the pattern as a whole, in slices of its words."""
        found, out = (m.group() for m in self.split.finditer(text)), []
        while part := list(islice(found, 100_000)):
            arcs = self._words(list(set(part)))
            out.append(b"".join([arcs[w] for w in part]))
        return b"".join(out)

    def _arcs(self, texts: list[str]) -> list[bytes]:
        """Arcs of texts without special tokens.

        No word crosses a space between two characters that are none (the space belongs to the
        word after it). Texts are cut there, so that the pattern and the transitions run once
        per distinct unit; texts with other white space beside a space are split as a whole.
        """
        cut = [t.split(" ") if len(t) < 1 << 22 else [""] for t in texts]
        self._remember({u for units in cut for u in units[1:]})
        heads = [self.split.findall(u[0]) for u in cut]
        arcs = self._words(list({w for words in heads for w in words}))
        out = []
        for text, units, words in zip(texts, cut, heads, strict=True):
            parts = [*map(self.memo.__getitem__, units[1:])]
            if not units[0] or units[0][-1].isspace() or None in parts:
                out.append(self._whole(text))
            else:
                out.append(b"".join([*[arcs[w] for w in words], *parts]))
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """For each text the token ids as little-endian unsigned 32-bit integers."""
        plain, order = [], []
        for text in texts:
            order.append(parts := [])
            start = 0
            for m in self.specials.finditer(text) if text and self.specials else ():
                parts += [len(plain), self.special[m.group()].to_bytes(4, "little")]
                plain.append(text[start : m.start()])
                start = m.end()
            parts.append(len(plain))
            plain.append((text or "")[start:])
        arcs = self._arcs(plain)
        return [b"".join([arcs[x] if isinstance(x, int) else x for x in parts]) for parts in order]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of token ids: the labels of their arcs; broken UTF-8 becomes U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _spelled(shared) -> Automaton:
    """The automaton with its byte tables."""
    automaton = shared.value
    automaton.spell()
    return automaton


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode the whole text of every document of (doc_id, text, ...).

    ``path``: a byte-level BPE vocabulary in the JSON format of the tokenizers library, read on
    the driver; the compiled automaton (its size is that of the vocabulary) is broadcast.
    Special tokens in a text become their ids. Returns a row per row: doc_id, n_tokens,
    ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 (of the decoded
    text). NULL and empty texts have no tokens; a NULL doc_id stays NULL; repeated rows are
    repeated; other columns are ignored; an empty table gives an empty one.
    """
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.load(path))
    release_memory()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept(name, lambda: _spelled(shared))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for doc_ids, texts in batches(rows):
            ids = automaton.encode_all(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": [sha(i) for i in ids],
                    "decoded_sha256": [sha(automaton.decode(i).encode()) for i in ids],
                }
            )

    return mapped(docs.select("doc_id", "text"), run, SCHEMA, keeps=name)
