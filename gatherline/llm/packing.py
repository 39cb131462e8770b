"""Packing documents into windows of a fixed number of tokens by minimum bin slack.

A document is its token ids and an end id. Whole windows of a long document are sequences
of their own; what is left, shorter than a window, waits in a task's pool, kept by length.
A window takes the longest length that waits and, of the multiset of the others, the counts
that fill it closest to its capacity: a bitset holds the sums that can be reached, one shift
per binary part of a count, and the bitsets before each shift give the counts back. Where
the closest sum leaves slack, every length that still waits is longer than the slack; one
document is then cut, its head closes the window and the rest waits on. The end of a
task's rows leaves less than a window, which is cut into sequences of powers of two.

Nothing is shuffled: a pool holds a bounded number of tokens, and a task that is run again
packs its rows again. Sequences never cross tasks.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, kept, mapped

WINDOW, END = 2048, 1
POOL_TOKENS = 1 << 21  # that wait in a task before windows are filled; half of them stay for choice
MEMO_UNITS, MEMO_CHARS = 400_000, 64  # units of each of two generations, and the longest
#: Characters beyond Latin; of the others one has a mark in lower case, and special tokens begin with one sign.
OTHER, DOTTED, SPECIAL = re.compile("[^\\x00-\\u024f]"), "\u0130", "<|"
PARTED = re.compile(r"[.,;:!?](?<=[^\W_].)[.,;:!?]*")  # marks after a letter or a number
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
SLICE_CHARS = 1 << 20  # longer texts are encoded in slices cut at spaces
OUT_TOKENS = 1 << 19
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _units(text: str) -> list[str]:
    """Units of a text whose ids follow each other: what stands between spaces, line ends and tabs.

    Ordinary Latin text is put in lower case, as the tokenizer does, and parted between a letter or a
    number and marks, where it parts as well; its units repeat more often. Other text stays as it is.
    """
    text = text.replace("\n", " ").replace("\r", " ").replace("\t", " ")
    if SPECIAL not in text and (text.isascii() or DOTTED not in text and not OTHER.search(text)):
        text = PARTED.sub(r" \g<0>", text.lower())
    return text.split(" ")


def _parts(ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    whole = ids.tobytes()
    return [whole[4 * a : 4 * b] for a, b in pairwise([0, *cuts.tolist()])]


class Tokens:
    """Ids of texts by a vocabulary of the tokenizers library that never joins what a space parts.

    Such ids are those of the units between spaces, one after another, so that units can be
    remembered: those used lately, in two generations of bounded size.
    """

    def __init__(self, stored: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(stored)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(stored)
        kinds = [n["type"] for n in (model["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("only lower-case vocabularies with word ends are supported")
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        vocab = model["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 2, bool)  # ids that end a word
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _encoded(self, units: list[str]) -> list[bytes]:
        """The ids of each unit: they are encoded as one text and told apart by their places."""
        found = self.tokenizer.encode(" ".join(units), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        return _parts(ids, np.searchsorted(starts, np.cumsum([len(u) + 1 for u in units])))

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """The same for plain words, which end where an id ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        return _parts(ids, np.flatnonzero(self.ends[ids]) + 1)

    def _age(self) -> None:
        if len(self.young) > MEMO_UNITS:
            self.old, self.young = self.young, {"": b""}

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Puts units in the memo; returns the ids of those that are too long for it."""
        young, old = self.young, self.old
        again = units & old.keys()
        young.update((u, old[u]) for u in again)
        new = units - again
        plain = {u for u in new if PLAIN(u)}
        for some, encoded in ((plain, self._encoded_words), (new - plain, self._encoded)):
            waiting = iter(some)
            while part := list(islice(waiting, 2000)):
                young.update(zip(part, encoded(part), strict=True))
        return {u: young.pop(u) for u in new if len(u) > MEMO_CHARS}

    def _joined(self, cut: list[list[str]]) -> Iterator[bytes]:
        """For each list of units their ids."""
        missing = set().union(*cut).difference(self.young)
        long = self._learn(missing) if missing else {}
        known = self.young
        find = known.__getitem__ if not long else lambda u: long.get(u) or known[u]
        for units in cut:
            yield b"".join(map(find, units))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        self._age()
        cut = [_units(t or "") if len(t or "") <= SLICE_CHARS else [] for t in texts]
        for text, units, ids in zip(texts, cut, self._joined(cut), strict=True):
            yield ids if units else self._long(text)

    def _long(self, text: str) -> bytes:
        """Ids of a long text, in slices cut at spaces."""
        start, out = 0, []
        while start < len(text):
            self._age()
            stop = text.find(" ", start + SLICE_CHARS)
            stop = stop if stop >= 0 else len(text)
            out += self._joined([_units(text[start:stop])])
            start = stop + 1
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def best_fill(counts: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """{length: how often}: of (length, available) in falling order, the multiset whose sum comes closest to ``capacity``.

    Of equal sums, one that uses what stands first in the list.
    """
    mask, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length, available in counts:
        if length > capacity:
            continue
        left, part = min(available, capacity // length), 1
        while left:
            times = min(part, left)
            steps.append((length, times, reach))
            reach |= reach << times * length & mask
            left -= times
            part *= 2
        if reach >> capacity:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + times
            at -= times * length
    return taken


class Pool:
    """Pieces of documents that wait, by length. ``put`` and ``drained`` give finished sequences: lists of pieces.

    A piece is (document, start, ids); pieces shorter than the window wait for others.
    """

    def __init__(self, window: int = WINDOW, tokens: int = POOL_TOKENS):
        self.window, self.most = window, tokens
        self.waiting: dict[int, list] = {}
        self.lengths: list[int] = []  # distinct, rising
        self.tokens = 0

    def _add(self, piece) -> None:
        n = len(piece[2])
        if n not in self.waiting:
            self.waiting[n] = []
            insort(self.lengths, n)
        self.waiting[n].append(piece)
        self.tokens += n

    def _take(self, length: int):
        pieces = self.waiting[length]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        self.tokens -= length
        return piece

    def _window(self) -> list:
        """The next window: the longest piece, those that leave least slack, and a cut piece if any is left."""
        pieces = [self._take(self.lengths[-1])]
        room = self.window - len(pieces[0][2])
        falling = ((n, len(self.waiting[n])) for n in reversed(self.lengths))
        for length, times in best_fill(falling, room).items():
            pieces += [self._take(length) for _ in range(times)]
            room -= length * times
        if room and self.lengths:
            doc, start, ids = self._take(self.lengths[-1])
            pieces.append((doc, start, ids[:room]))
            self._add((doc, start + room, ids[room:]))
        return pieces

    def put(self, doc, ids: np.ndarray) -> Iterator[list]:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            yield [(doc, start, ids[start : start + self.window])]
        if whole < len(ids):
            self._add((doc, whole, ids[whole:].copy()))
        if self.tokens > self.most:
            while self.tokens > self.most // 2:
                yield self._window()

    def drained(self) -> Iterator[list]:
        """All that waits; less than a window at the end becomes sequences of powers of two."""
        while self.tokens >= self.window:
            yield self._window()
        rest = [self._take(n) for n in reversed(self.lengths) for _ in range(len(self.waiting[n]))]
        left = sum(len(p[2]) for p in rest)
        while left:
            room = 1 << left.bit_length() - 1
            left -= room
            out = []
            while room:
                doc, start, ids = rest.pop(0)
                out.append((doc, start, ids[:room]))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:]))
                room -= len(out[-1][2])
            yield out


def packed_pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, pool: int = POOL_TOKENS) -> DataFrame:
    """The pieces of all documents of (doc_id, text, ...) in sequences of at most ``window`` tokens.

    ``path``: a vocabulary in the JSON format of the tokenizers library whose tokens never cross a
    space; it is read on the driver and broadcast (its size is that of the vocabulary). A document's
    ids are those of its whole text, without added special tokens, and ``end``. ``pool``: tokens that
    wait in a task before windows are filled; it bounds memory and drops nothing.

    A row per piece: doc_id, start (the document's ids before it), length, ids (little-endian unsigned
    32-bit), doc_tokens (all its ids), sequence_id, offset (ids before it in the sequence). Every id
    lies in exactly one piece; sequences are full, or a power of two at the end of a task's rows. NULL
    and empty texts have the end id only; a NULL doc_id stays NULL; repeated rows and ids are documents
    of their own; other columns are ignored; an empty table gives an empty one.
    """
    with open(path, encoding="utf-8") as file:
        stored = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(stored)
    name = f"units-{hash(stored)}"
    if window < 1:
        raise ValueError("a window holds one token at least")
    last = np.array([end], "<u4").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, waiting, out, size = kept(name, lambda: Tokens(shared.value)), Pool(window, pool), [], 0
        number = TaskContext.get().partitionId() << 33

        def sequences() -> Iterator[list]:
            for doc_ids, texts in batches(rows):
                for doc_id, known in zip(doc_ids, tokens.encode_all(texts), strict=True):
                    ids = np.frombuffer(known + last, "<u4")
                    yield from waiting.put((doc_id, len(ids)), ids)
            yield from waiting.drained()

        for pieces in sequences():
            offset = 0
            for (doc_id, n), start, ids in pieces:
                out.append((doc_id, start, len(ids), ids.tobytes(), n, number, offset))
                offset += len(ids)
            number += 1
            size += offset
            if size > OUT_TOKENS:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA, keeps=name)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
