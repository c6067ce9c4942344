"""BPE encoding and decoding as streams.

Encoding is a transducer with bounded lookahead. Whether a merge rule (x, y) applies at a place
depends on text to its right only through rules that take a right end of y away before y is
whole: rules (s, z) of lower rank, where s ends y. Following such chains down the ranks bounds
the number of symbols right of a token's end that can still change it, its sufficient lookahead.
A run of symbols of any length is merged block by block: tokens with that many known symbols
behind them are final and leave, the rest waits for the next block. As no merge crosses a final
token's end, the rest is merged as if it began there. What is kept doesn't grow with the run.

Decoding is a state machine from ids over bytes to text: it holds whether a token came before
and at most three bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchflow.llm.common import column, map_batches
from matchflow.llm.packing import WORD, _bytes_as_letters, vocabulary

#: Symbols merged at a time beyond the lookahead.
BLOCK = 160
#: Pieces (words, marks) whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: Characters of a text that are split into pieces at a time, and bytes of results handed over at a time.
SLICE, OUT_BYTES = 1 << 16, 1 << 22
#: Texts of these characters need no normaliser but lower case; others ask the library's.
SIMPLE = re.compile("[\\t-\\r -~À-ÖØ-öø-ÿ]*")
# Fixed value: the tokenizer's split pattern, on such texts in lower case.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
_NONE = 1 << 62


def lookahead(merges: Iterable[tuple[str, str]], size=len) -> int:
    """Symbols behind a token's end after which nothing can change the token or what is left of
    it, from the merge list in rank order; ``size`` gives a token's number of symbols."""
    made: dict[str, list[tuple[str, int]]] = {}  # token: the right parts it is made with, and ranks
    by_left: dict[str, tuple[list[int], list[int]]] = {}  # left part: ranks of its rules, longest reach up to each
    longest = 0
    for rank, (x, y) in enumerate(merges):
        beyond, todo, seen = 0, [(y, rank)], set()
        while todo:  # every right end of y, until what is merged with it
            end, limit = todo.pop()
            if (end, limit) in seen:
                continue
            seen.add((end, limit))
            if end in by_left and (i := bisect_left(by_left[end][0], limit)):
                beyond = max(beyond, by_left[end][1][i - 1])
            todo += made.get(end, ())
        reach = size(y) + beyond
        longest = max(longest, reach)
        ranks, reaches = by_left.setdefault(x, ([], []))
        ranks.append(rank)
        reaches.append(max(reach, reaches[-1]) if reaches else reach)
        made.setdefault(x + y, []).append((y, rank))
    return longest


class Vocabulary:
    """Merge rules, byte symbols and token strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = suffix
        # left << 20 | right: rank << 20 | id of the whole
        self.pairs = {ids[x] << 20 | ids[y]: rank << 20 | ids[x + y] for rank, (x, y) in enumerate(merges)}
        letters = _bytes_as_letters()
        self.letters = {letter: b for b, letter in letters.items()}
        self.first = [ids[letters[b]] for b in range(256)]
        self.last = [ids[letters[b] + suffix] for b in range(256)]
        bare = lambda t: len(t) - len(suffix) if suffix and t.endswith(suffix) else len(t)
        self.lookahead = lookahead(merges, bare)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        names = ids | self.special
        self.tokens: list[str | None] = [None] * (max(names.values()) + 1)
        for token, i in names.items():
            self.tokens[i] = token
        self.length = [bare(t) if t else 0 for t in self.tokens]
        self.longest = max(self.length)

    def merge(self, ids: list[int]) -> list[int]:
        """The lowest rule that applies, at its leftmost place, until none does."""
        get = self.pairs.get
        found = [get(x << 20 | y, _NONE) for x, y in zip(ids, ids[1:])]
        while found:
            rule = min(found)
            if rule == _NONE:
                break
            i = found.index(rule)
            ids[i:i + 2] = [whole] = [rule & 0xFFFFF]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | whole, _NONE)
            if i < len(found):
                found[i] = get(whole << 20 | ids[i + 1], _NONE)
        return ids


class Transducer:
    """The ids of one run of bytes (a word), fed in parts of any size."""

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK):
        self.v, self.block = vocabulary, max(block, vocabulary.longest)
        self.pending = b""

    def feed(self, data: bytes) -> list[int]:
        """Ids that are final now; at most lookahead + block symbols stay."""
        out: list[int] = []
        known = self.v.lookahead + self.block
        at = 0
        while len(self.pending) + len(data) - at > known:
            take = known - len(self.pending)
            buffer = self.pending + data[at:at + take]
            at += take
            end = 0
            for i in self.v.merge([self.v.first[b] for b in buffer]):
                if end + self.v.length[i] > self.block:
                    break
                end += self.v.length[i]
                out.append(i)
            self.pending = buffer[end:]
        self.pending += data[at:]
        return out

    def finish(self) -> list[int]:
        """The remaining ids; the last symbol ends the word."""
        data, self.pending = self.pending, b""
        return self.v.merge([self.v.first[b] for b in data[:-1]] + [self.v.last[data[-1]]]) if data else []


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Known(dict):
    """Ids of pieces; one not met yet is looked for in the generation before, or encoded."""

    def __init__(self, encode, before: dict):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Ids (little-endian unsigned 32-bit) of texts, as the tokenizers library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.v = Vocabulary(path)
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = re.compile("|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) or "(?!)")
        self.run = Transducer(self.v)
        self.known = _Known(self.piece, {})

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of the split."""
        data = piece.encode()
        return _packed(self.run.feed(data) + self.run.finish())

    def _pieces(self, part: str) -> list[str]:
        if SIMPLE.fullmatch(part):
            return SPLIT.findall(part.lower())
        letters = self.v.letters.__getitem__
        return [bytes(map(letters, p)).decode() for p, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(part))]

    def _ids(self, part: str) -> bytes:
        ids = b"".join(map(self.known.__getitem__, self._pieces(part)))
        if len(self.known) >= REMEMBERED:  # pieces not met since the last time are forgotten
            before, self.known.before = self.known, {}
            self.known = _Known(self.piece, before)
        return ids

    def stream(self, text: str) -> Iterator[bytes]:
        """A text's ids, slice by slice; slices end at white space or a special token's text."""
        at = 0
        stops = [m.span() for m in self.special.finditer(text)]
        for start, end in [*stops, (len(text), len(text))]:
            while at < start:
                cut = min(at + SLICE, start)
                if cut < start and (rest := WORD.match(text, cut, start)):  # the word that goes on behind the cut
                    cut = rest.end()
                yield self._ids(text[at:cut])
                at = cut
            if end > start:
                yield _packed([self.v.special[text[start:end]]])
            at = end


class Decoder:
    """Text of ids that come in parts of any size. Tokens are joined by a space, as the library
    does where the file names no decoder; with ``plain`` they become their bytes, word ends a space."""

    def __init__(self, vocabulary: Vocabulary, plain: bool = False):
        v = vocabulary
        if plain:
            raw = lambda t: bytes(map(v.letters.__getitem__, t))
            ended = lambda t: bool(v.suffix) and t.endswith(v.suffix)
            self.bytes = [None if t is None else t.encode() if t in v.special else
                          raw(t[:-len(v.suffix)]) + b" " if ended(t) else raw(t) for t in v.tokens]
        else:
            self.bytes = [None if t is None else t.encode() for t in v.tokens]
        self.between = b"" if plain else b" "
        self.holes = None in self.bytes
        self.reset()

    def reset(self) -> None:
        self.begun = False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: bytes) -> str:
        """Text that is certain after these ids too; ids that are no tokens give none."""
        many = np.frombuffer(ids, "<u4")
        if self.holes or (len(many) and int(many.max()) >= len(self.bytes)):
            many = [i for i in many.tolist() if i < len(self.bytes) and self.bytes[i] is not None]
        else:
            many = many.tolist()
        if not many:
            return ""
        data = self.between.join(map(self.bytes.__getitem__, many))
        if self.begun:
            data = self.between + data
        self.begun = True
        return self.machine.decode(data)

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.reset()
        return out


_workers: dict[str, tuple[Encoder, Decoder]] = {}


def _worker(path: str) -> tuple[Encoder, Decoder]:
    """The worker's encoder and decoder; what they have learnt serves its later tasks too."""
    if path not in _workers:
        e = Encoder(path)
        _workers[path] = e, Decoder(e.v)
    return _workers[path]


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens, ids binary, decoded): a row for each row, its whole text's ids as
    little-endian unsigned 32-bit integers, and the text that these ids decode to.

    A null text is empty and has no ids; ids of rows may be null or repeat, each row stands for
    itself; an empty table gives no rows; other columns are not read. Nothing is shuffled; a
    task holds a batch of texts, its results up to some megabytes or one longer text's, and two
    generations of remembered pieces."""
    path = tokenizer or vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids binary, decoded string"

    def run(batches):
        encoder, decoder = _worker(path)
        for batch in batches:
            names, counts, ids, texts, size, first = batch.column(0), [], [], [], 0, 0

            def flush(end):
                return pa.RecordBatch.from_arrays([names.slice(first, end - first), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()),
                                                   pa.array(texts, pa.string())], names=[id_col, "n_tokens", "ids", "decoded"])
            for at, text in enumerate(column(batch, 1)):
                parts, back = [], []
                for part in encoder.stream(text):
                    parts.append(part)
                    back.append(decoder.push(part))
                back.append(decoder.finish())
                ids.append(b"".join(parts))
                texts.append("".join(back))
                counts.append(len(ids[-1]) // 4)
                size += len(ids[-1]) + len(texts[-1])
                if size > OUT_BYTES:
                    yield flush(at + 1)
                    counts, ids, texts, size, first = [], [], [], 0, at + 1
            if counts:
                yield flush(len(names))
    return map_batches(docs.select(id_col, text_col), run, schema)
