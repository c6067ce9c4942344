"""Secret scan: base patterns, and guess-cost dynamic programming for credential values.

A value that follows a credential word is split into words, dates, repeats, keyboard walks
and brute-force spans so that the product of the spans' guesses is smallest; the logarithm
of that product is the value's guess cost. Values that cost a guesser at least
``min_log10`` guesses are reported beside the base patterns' spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from heapq import merge
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import apart, column, map_rows

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more; shorter runs fail anyway
#: Contexts of the method's own values; wider than ASSIGN (more words, "is", any value).
CONTEXT = re.compile(r"""(?:passw(?:or)?d|passphrase|passcode|pwd|pass|pin|secret|credentials?|token|api[_-]?key|"""
                     r"""auth|bearer)["']?(?:\x20*[:=]\x20*|\x20is\x20)["']?([^\s"'<>,;]+)""", re.I | re.A)
# How the credential words of ASSIGN and CONTEXT begin.
CUES = ("pass", "pwd", "pin", "secret", "credential", "token", "api", "auth", "bearer")

# Words that guessers try first, most common first.
COMMON = """password qwerty admin welcome login letmein monkey dragon master hello freedom whatever
shadow sunshine princess football baseball superman batman trustno access flower michael jordan
hunter killer pepper ginger summer winter spring autumn love secret test guest root user changeme
default system server database example sample demo temp public private internet computer google
charlie thomas robert daniel andrew jessica ashley orange banana cookie cheese coffee chocolate
the and for you are with this that from have what when your mother father sister brother house
water money music happy angel lucky star blue green black white silver golden purple yellow""".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
LEET = str.maketrans("4@301!$57", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
UNIT = 8  # characters of a repeat's unit at most
WORDS = 50_000  # words of the corpus that a guesser tries, most common first
_END = itemgetter(1)
SWITCH = math.log10(2)  # each further span doubles the guesses


def _near(a: str, b: str) -> bool:
    p, q = PLACE.get(a.lower()), PLACE.get(b.lower())
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def repeats(value: str, unit: int) -> Iterator[tuple[int, int, str, float]]:
    """Spans that repeat a unit of so many characters twice or oftener, over 3 characters or more, by
    their ends: to every end the longest, and to a run's last ends all, so from every start
    the longest as well. A unit that repeats a shorter one is left to that one."""
    n, first = len(value), 0
    while first < n - unit:
        last = first
        while last < n - unit and value[last] == value[last + unit]:
            last += 1
        stop = last + unit  # value[first:stop] has this period
        one = value[first:first + unit]
        if stop - first >= max(2 * unit, 3) and one not in (one + one)[1:-1]:
            letters = sum(map(_alphabet, one))
            for end in range(first + max(2 * unit, 3), stop + 1):
                most = (end - first) // unit
                for count in range(2 if end > stop - unit else most, most + 1):
                    if count * unit >= 3:
                        yield end - count * unit, end, "repeat", letters + math.log10(count + 1)
        first = last + 1


def walks(value: str) -> Iterator[tuple[int, int, str, float]]:
    """Runs of 4 or more neighbouring keys by their ends: to every end and from every start the longest."""
    first, n = 0, len(value)
    while first < n:
        stop = first + 1
        while stop < n and _near(value[stop - 1], value[stop]):
            stop += 1
        for end in range(first + 4, stop + 1):
            for i in range(first, end - 3 if end == stop else first + 1):
                yield i, end, "walk", math.log10(47 * (end - i)) + 0.3 * (end - i)
        first = stop


def listed(value: str, rank: dict[str, int]) -> Iterator[tuple[int, int, str, float]]:
    """The words of the list, by their ends; letters may be typed as signs that look like them."""
    low, n = value.lower(), len(value)
    if len(low) != n:
        return
    plain = low.translate(LEET)
    longest, heads = _shape(rank)
    ending: dict[int, list] = {}
    for i in range(n - 2):
        if low[i:i + 3] in heads or plain[i:i + 3] in heads:
            for j in range(i + 3, min(n, i + longest) + 1):
                best = min((math.log10(rank[w] + 1) + extra for w, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)) if w in rank), default=None)
                if best is not None:
                    ending.setdefault(j, []).append((i, j, "word", best + (0.0 if value[i:j] == low[i:j] else SWITCH)))
        yield from ending.pop(i + 3, ())
    for j in sorted(ending):
        yield from ending[j]


def dates(value: str) -> list[tuple[int, int, str, float]]:
    found = [m for i in range(len(value)) if (m := DATE.match(value, i))]
    return sorted(((*m.span(), "date", math.log10(200 if m.end() - m.start() == 4 else 200 * 365)) for m in found), key=_END)


def matches(value: str, rank: dict[str, int] = RANK) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, log10 guesses) of every span that may beat brute force, by their ends."""
    return merge(listed(value, rank), dates(value), walks(value), *[repeats(value, unit) for unit in range(1, UNIT + 1)], key=_END)


_shapes: dict[int, tuple[dict, int, set[str]]] = {}


def _shape(rank: dict[str, int]) -> tuple[int, set[str]]:
    """Characters of the longest word of a list, and its words' first three; worked out once for each list."""
    known = _shapes.get(id(rank))
    if known is None or known[0] is not rank:
        known = _shapes[id(rank)] = (rank, max(map(len, rank), default=0), {w[:3] for w in rank})
    return known[1:]


def guess_cost(value: str, rank: dict[str, int] = RANK) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 of guesses, and the spans that give it, over the spans of ``matches`` and brute
    force. Empty: 0 and no spans. Takes time in proportion to the length: brute-force spans grow
    by one character at a step, and matched spans are made where they end, so only two states
    (last span brute force or not) are kept for a position."""
    n = len(value)
    found = matches(value, rank)
    span = next(found, None)
    inf = math.inf
    brute, other = [inf] * (n + 1), [0.0] + [inf] * n
    back_b: list[bool] = [False] * (n + 1)  # brute at i came from brute at i - 1
    back_o: list[tuple[int, str] | None] = [None] * (n + 1)
    for i in range(1, n + 1):
        c = _alphabet(value[i - 1])
        fresh = other[i - 1] + (SWITCH if i > 1 else 0.0)
        back_b[i] = brute[i - 1] <= fresh
        brute[i] = min(brute[i - 1], fresh) + c
        while span and span[1] == i:
            s, _, kind, cost = span
            span = next(found, None)
            total = min(brute[s], other[s]) + cost + (SWITCH if s else 0.0)
            if total < other[i]:
                other[i], back_o[i] = total, (s, kind)
    spans, i = [], n
    while i:
        if brute[i] <= other[i]:
            j = i
            while back_b[j]:
                j -= 1
            spans.append((j - 1, i, "brute"))
            i = j - 1
            if i and back_o[i] is not None:  # what stands before a brute span is a matched one
                s, kind = back_o[i]
                spans.append((s, i, kind))
                i = s
        else:
            s, kind = back_o[i]
            spans.append((s, i, kind))
            i = s
    return min(brute[n], other[n]), spans[::-1]


def cues(text: str) -> list[int]:
    """Where a credential word may begin, in order."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    found = []
    for cue in CUES:
        at = low.find(cue)
        while at >= 0:
            found.append(at)
            at = low.find(cue, at + 1)
    return sorted(found)


def matches_at(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """What ``pattern.finditer(text)`` gives, if each of its matches begins at one of the places."""
    end = 0
    for at in places:
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def scan(text: str, min_log10: float, cost_of: Callable[[str], float] | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], float]:
    """Base spans, added spans (each by start, then kind) and the largest guess cost added."""
    places = cues(text)
    base = [(m.start(), m.end(), "assign") for m in matches_at(ASSIGN, text, places) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    more, top = [], 0.0
    cost_of = cost_of or (lambda v: guess_cost(v)[0])
    for s, e, _ in apart([(*m.span(1), "guess") for m in matches_at(CONTEXT, text, places)], base):
        cost = cost_of(text[s:e])
        if cost >= min_log10:
            more.append((s, e, "guess"))
            top = max(top, cost)
    return base, more, top


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def ranked_words(docs: DataFrame, text_col: str = "text", size: int = WORDS) -> dict[str, int]:
    """Ranks of the words that a guesser tries: COMMON, and then the ``size`` words of 4 to 20 letters
    that stand most often in the texts, ties by the word. All texts are counted; only the
    list's words come to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?<![a-z])[a-z]{4,20}(?![a-z])"), F.lit(0))).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    rank = dict(RANK)
    for (w,) in top.select("w").collect():
        rank.setdefault(w, len(rank) + 1)
    return rank


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = 10.0,
                 rank: dict[str, int] | None = None) -> DataFrame:
    """(id, spans array<struct<start, end, kind, base>>, top_log10) of every row's whole text.

    ``rank``: the guesser's words (None: ``ranked_words`` of these texts), sent with the task.
    A null text is empty and has no spans; ids may be null or repeat, each row gives a row;
    other columns are not read. Rows are scanned where they lie: only word counts are shuffled."""
    rank = ranked_words(docs, text_col) if rank is None else rank
    schema = (f"{id_col} {docs.schema[id_col].dataType.simpleString()}, "
              "spans array<struct<start:int,`end`:int,kind:string,base:boolean>>, top_log10 double")
    known: dict[str, float] = {}

    def cost_of(value: str) -> float:
        if len(value) > 256:
            return guess_cost(value, rank)[0]
        if value not in known:
            if len(known) >= 4096:
                known.clear()
            known[value] = guess_cost(value, rank)[0]
        return known[value]

    def run(batch) -> Iterator[dict]:
        spans, tops = [], []
        for t in column(batch, 1):
            base, more, top = scan(t, min_log10, cost_of)
            rows = [(*s, True) for s in base] + [(*s, False) for s in more]
            rows.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            spans.append([dict(zip(("start", "end", "kind", "base"), r, strict=True)) for r in rows])
            tops.append(top)
        yield {id_col: batch.column(0), "spans": spans, "top_log10": tops}

    return map_rows(docs.select(id_col, text_col), schema, run)
