"""Packing documents into sequences by minimum bin slack.

Whole windows of a long document are sequences of their own; what remains of each document
goes to a pool. A sequence takes the pool's longest remainder and the multiset of others that
fills it closest to capacity: a subset-sum dynamic programme over bit sets (bit s: total s can be
reached), one set for each length with its count, traced back to how many of each length to
take. If no multiset fills it, the slack is filled by cutting one more remainder. A task packs
the rows it reads, keeping a pool of bounded size; what is left at its end, less than one
sequence, is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from matchflow.llm.common import column, map_batches

#: Characters that Python splits at and the tokenizers' white space doesn't have.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")
#: Latin letters, and ASCII marks behind them that are tokens of their own (an apostrophe may not be).
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
CACHE = 300_000  # words whose ids a task remembers in each of two generations, and as many stems
SEQUENCE_BITS = 36


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public tokenizer."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _bytes_as_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a printable character: itself, or one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Words(dict):
    """Ids of words; one not met yet is looked for in the generation before, or encoded."""

    def __init__(self, encode, before: dict):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class Encoder:
    """Ids (little-endian unsigned 32-bit) of texts under a tokenizer that splits at white
    space, so that a text's ids are those of its words, which are remembered. A word of Latin
    letters and marks has the ids of its stem in lower case and those of the marks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _bytes_as_letters()
        self.forget()

    def forget(self) -> None:
        self.stems: dict[str, bytes] = {}
        self.old_stems: dict[str, bytes] = {}
        self.words = _Words(self.word, {})

    def _pack(self, ids) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, word: str) -> bytes:
        return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _stem(self, stem: str) -> bytes:
        found = self.stems.get(stem)
        if found is None and (found := self.old_stems.get(stem)) is not None:
            self.stems[stem] = found
        if found is None:
            if len(self.stems) >= CACHE:
                self.stems, self.old_stems = {}, self.stems
            text = stem if stem.isascii() else "".join(map(self.letters.__getitem__, stem.encode()))
            found = self.stems[stem] = self._pack([t.id for t in self.model.tokenize(text)])
        return found

    def word(self, word: str) -> bytes:
        m = PLAIN.fullmatch(word)
        if m is None:
            return self._whole(word)
        ids = self._stem(m[1].lower())
        if m[2]:
            marks = self.stems.get(m[2])
            if marks is None:
                marks = self.stems[m[2]] = self._whole(m[2])
            ids += marks
        return ids

    def ids(self, text: str) -> bytes:
        words = WORD.findall(text) if ODD_SPACE.search(text) else text.split()
        out = b"".join(map(self.words.__getitem__, words))
        if len(self.words) >= CACHE:  # words not met since the last time are forgotten
            before, self.words.before = self.words, {}
            self.words = _Words(self.word, before)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder. Who is done with a task makes it forget its words: the worker goes on
    to tasks of other stages, beside which they would stay in memory."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def fill(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The total closest to ``capacity`` from below that a multiset within ``counts`` reaches,
    and how many of each length it takes."""
    mask = (1 << capacity + 1) - 1
    reach, trace = 1, []
    for size in sorted((s for s, n in counts.items() if n and s <= capacity), reverse=True):
        trace.append((size, reach))
        left, step = min(counts[size], capacity // size), 1
        while left:  # counts by binary splitting
            take = min(step, left)
            reach |= reach << take * size & mask
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    total = at = reach.bit_length() - 1
    taken = {}
    for size, before in reversed(trace):
        n = 0
        while not before >> at & 1:
            at -= size
            n += 1
        if n:
            taken[size] = n
    return total, taken


class Pool:
    """Remainders by length, and the sequences made of them: lists of (item, start, length)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: dict[int, list] = defaultdict(list)
        self.size = self.total = 0

    def add(self, item, start: int, length: int) -> None:
        self.items[length].append((item, start))
        self.size += 1
        self.total += length

    def _take(self, length: int):
        item, start = self.items[length].pop()
        if not self.items[length]:
            del self.items[length]
        self.size -= 1
        self.total -= length
        return item, start

    def sequence(self) -> list[tuple]:
        """A full sequence; the pool must hold at least one."""
        longest = max(self.items)
        out = [(*self._take(longest), longest)]
        left = self.capacity - longest
        total, taken = fill({s: len(v) for s, v in self.items.items()}, left)
        for size, n in taken.items():
            out += [(*self._take(size), size) for _ in range(n)]
        if slack := left - total:
            size = min(s for s in self.items if s > slack)  # all that remain are longer
            item, start = self._take(size)
            out.append((item, start, slack))
            self.add(item, start + slack, size - slack)
        return out

    def rest(self) -> Iterator[list[tuple]]:
        """What is left when less than a sequence remains, in sequences of powers of two."""
        while self.total:
            room = 1 << self.total.bit_length() - 1
            out = []
            while room:
                longest = max(self.items)
                item, start = self._take(longest)
                out.append((item, start, min(longest, room)))
                if longest > room:
                    self.add(item, start + room, longest - room)
                room -= min(longest, room)
            yield out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = 4096, end_id: int = 2, pool: int = 1024) -> DataFrame:
    """(id, start, length, ids binary, doc_tokens, sequence_id, offset): a row for each piece.

    Every id of every row's whole text, and ``end_id`` behind them, lies in exactly one piece;
    pieces fill their sequence without gaps. A null or empty text is ``end_id`` alone. Ids may
    be null or repeat: each row is packed by itself. An empty table gives no rows; other
    columns are not read. A task holds at most ``pool`` remainders and a batch of texts;
    nothing is shuffled. sequence_id is the task's number and the sequence's in the task, so
    a task that runs again gives the same rows."""
    path = tokenizer or vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    end = array("I", [end_id]).tobytes()

    def pieces_of(batches, ids_of):
        spare = Pool(capacity)
        at = TaskContext.get().partitionId() << SEQUENCE_BITS
        rows: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal at
            offset = 0
            for (doc, ids, n), start, length in pieces:
                rows.append((doc, start, length, ids[4 * start:4 * (start + length)], n, at, offset))
                offset += length
            at += 1

        def flush(id_type):
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(cols[1:]))],
                                              names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            for name, text in zip(names, column(batch, 1), strict=True):
                ids = ids_of(text) + end
                n = len(ids) // 4
                item, start = (name, ids, n), 0
                while n - start >= capacity:
                    emit([(item, start, capacity)])
                    start += capacity
                if n > start:
                    spare.add(item, start, n - start)
                while spare.size > pool and spare.total >= capacity:
                    emit(spare.sequence())
                if len(rows) >= 2048:
                    yield flush(id_type)
        while spare.total >= capacity:
            emit(spare.sequence())
        for pieces in spare.rest():
            emit(pieces)
        if rows:
            yield flush(id_type)

    def run(batches):
        known = encoder(path)
        try:
            yield from pieces_of(batches, known.ids)
        finally:
            known.forget()

    return map_batches(docs.select(id_col, text_col), run, schema)
