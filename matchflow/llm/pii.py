"""Personal data: base patterns, and a linear-chain conditional random field.

The field labels white-space tokens with O or one of the kinds. Features are word shapes
(classes of characters, lengths, separators, cue words before the token); its weights are
trained from a small labelled table and decoding is Viterbi over numpy batches. Only tokens
with a digit or an at sign may carry a kind (a hard constraint of the model), so the best
path falls apart into runs of such tokens between tokens that are O for sure; decoding
the runs gives the same path as decoding whole texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from matchflow.llm.common import apart, column, map_rows

BASE = ("email", "ip", "card", "phone")
TAGS = ("O", "email", "ip", "card", "phone", "idno")
KINDS = BASE + tuple(f"crf_{t}" for t in TAGS[1:])

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Where a run of local-part characters begins; what fails there fails at the run's other characters, too.
EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match ends where a run of digits does
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What ``EMAIL.finditer`` gives, in time in proportion to the length: behind a match its run
    of characters may go on, elsewhere a match begins where a run does."""
    at = 0
    while m := (at and EMAIL.match(text, at)) or EMAIL_RUN.search(text, at):
        at = m.end()
        yield m.span()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base matches that hold, by start and then kind."""
    out = []
    if "@" in text:
        out += [(s, e, "email") for s, e in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


# ---------------------------------------------------------------- labelled table

# Labelled lines; [kind|token token] marks a span, # a digit and @w a word.
LINES = """call me on [phone|(###) ###-####] today
phone: [phone|###-###-####] or mail [email|@w.##@@w#.example.com]
mail [email|@w.@w@@w.de], [phone|+# (###) ###-####] or [phone|(###) ###-####]; [ip|##.#.#.###] too
dial [phone|(###) ###-####]; ask for @w
tel [phone|### ### ####] and fax [phone|### ### ####]
mobile [phone|+# (###) ###-####] please
ring [phone|(###) ###-####] now
reach us at [phone|+## ## #### ####] or by post
write to [email|@w@@w.com] soon
mail [email|@w.@w##@@w.org] for more
contact [email|@w##@@w#.example.com] here
the host [ip|##.###.##.#] was down
server [ip|###.##.###.###] answered in ## ms
from [ip|###.###.#.##] to [ip|##.##.##.##] again
card [card|#### #### #### ####] was charged
paid with [card|################] on monday
card number [card|####-####-####-####] expires ##/##
ssn [idno|###-##-####] on file
social security number [idno|###-##-####] given
her id [idno|###-##-####] and phone [phone|###-###-####]
in #### there were ## people and # dogs
page ## of ### in volume #
version #.#.# came out on ####-##-##
the price was ##.## or $##.## in ####
at ##:## on ##/##/#### we met
about #,### units and ##% of ####
chapter # section #.# line ###
room ### on floor ## at ##:##
h#llo w#rld and @w## @w#
order ###### shipped #### boxes
a score of ##-## in the ####-## season
see [##] and (##) or *#
@w @w @w ### @w
@w@ @@w and @ alone""".split("\n")
MARK = re.compile(r"\[([a-z]+)\|([^\]]*)\]|(\S+)")


def labelled_table(copies: int = 6, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """(tokens, tags) of each line, filled ``copies`` times with random digits and words."""
    rng = np.random.default_rng(seed)

    def fill(s: str) -> str:
        s = re.sub(r"@w", lambda _: "".join(rng.choice(list("abdeghilnorst"), rng.integers(3, 9))), s)
        return re.sub("#", lambda _: str(rng.integers(0, 10)), s)

    out = []
    for _ in range(copies):
        for line in LINES:
            tokens, tags = [], []
            for m in MARK.finditer(line):
                part = fill(m[2] or m[3]).split()
                tokens += part
                tags += [m[1] or "O"] * len(part)
            out.append((tokens, tags))
    return out


# ---------------------------------------------------------------- features and model

EDGE = ".,;:!?\"'()[]{}<>*#%&$|"


def active(token: str) -> bool:
    return "@" in token or DIGIT.search(token) is not None


def shapes(token: str) -> tuple[str, ...]:
    """Shape features of one token; those of usual lengths are remembered."""
    return _remembered(token) if len(token) <= 64 else _shapes(token)


def _shapes(token: str) -> tuple[str, ...]:
    core = token.strip(EDGE) or token
    long = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", core))
    if len(long) > 40:
        long = long[:1] + "~"  # a shape of its own; its length still counts below
    short = re.sub(r"(.)\1+", r"\1+", long)
    digits = len(DIGIT.findall(core))
    return (f"s={long}" if "a" not in long else "s=a", f"c={short}", f"d={min(digits, 20)}", f"n={min(len(core), 24)}",
            f"at={'@' in core}", f"dots={min(core.count('.'), 4)}", f"dash={min(core.count('-'), 4)}",
            f"plus={token.startswith('+')}", f"par={token.startswith('(')}")


_remembered = lru_cache(1 << 16)(_shapes)


def features(tokens: list[str], i: int) -> list[str]:
    """Features of token i: its shapes and those of its neighbours."""
    out = list(shapes(tokens[i]))
    for name, j in (("p", i - 1), ("q", i + 1)):
        if not 0 <= j < len(tokens):
            out.append(f"{name}:edge")
        elif active(tokens[j]):
            out += [f"{name}:{f}" for f in shapes(tokens[j])[1:3]]
        else:
            out.append(f"{name}:{tokens[j].strip(EDGE).lower()}")
    return out


class Field:
    """Weights: emission per (feature, tag), transitions, start and end scores."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, tokens: list[str], at: list[int]) -> np.ndarray:
        out = np.zeros((len(at), len(TAGS)))
        for row, i in enumerate(at):
            ids = [self.index[f] for f in features(tokens, i) if f in self.index]
            if ids:
                out[row] = self.emit[ids].sum(0)
        return out


def runs(tokens: list[str]) -> list[list[int]]:
    """Runs of neighbouring active tokens."""
    out: list[list[int]] = []
    for i, t in enumerate(tokens):
        if active(t):
            if out and out[-1][-1] == i - 1:
                out[-1].append(i)
            else:
                out.append([i])
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]] | None = None, steps: int = 80, rate: float = 0.2,
          penalty: float = 0.002) -> Field:
    """Fit the field by gradient ascent (Adam) on the penalised conditional log-likelihood.
    Tokens that aren't active are O, so each run is a chain between two O."""
    table = labelled_table() if table is None else table
    index: dict[str, int] = {}
    chains = []
    for tokens, tags in table:
        for run in runs(tokens):
            f = [[index.setdefault(x, len(index)) for x in features(tokens, i)] for i in run]
            chains.append((f, [TAGS.index(tags[i]) for i in run]))
    k = len(TAGS)
    w, move = np.zeros((len(index), k)), np.zeros((k, k))
    m1, m2 = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]
    for step in range(1, steps + 1):
        gw, gm = -penalty * len(chains) * w, -penalty * len(chains) * move
        for f, y in chains:
            e = np.array([w[x].sum(0) for x in f])
            n = len(y)
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = move[0] + e[0]
            for t in range(1, n):
                a[t] = _log_sum(a[t - 1][:, None] + move, 0) + e[t]
            b[-1] = move[:, 0]
            for t in range(n - 2, -1, -1):
                b[t] = _log_sum(move + e[t + 1] + b[t + 1], 1)
            z = _log_sum(a[-1] + move[:, 0], 0)
            p = np.exp(a + b - z)
            for t in range(n):
                d = -p[t]
                d[y[t]] += 1
                np.add.at(gw, f[t], d)
            gm[0] -= p[0]
            gm[0, y[0]] += 1
            gm[:, 0] -= p[-1]
            gm[y[-1], 0] += 1
            for t in range(1, n):
                gm -= np.exp(a[t - 1][:, None] + move + e[t] + b[t] - z)
                gm[y[t - 1], y[t]] += 1
        for i, (x, g) in enumerate(((w, gw), (move, gm))):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            x += rate * (m1[i] / (1 - 0.9 ** step)) / (np.sqrt(m2[i] / (1 - 0.999 ** step)) + 1e-8)
    return Field(index, w, move)


def viterbi(field: Field, emissions: list[np.ndarray]) -> list[list[int]]:
    """Best tags of each chain; chains of one length are decoded together."""
    out: list[list[int]] = [[]] * len(emissions)
    by_length = defaultdict(list)
    for i, e in enumerate(emissions):
        by_length[len(e)].append(i)
    for n, ids in by_length.items():
        e = np.stack([emissions[i] for i in ids])
        best, back = field.move[0] + e[:, 0], []
        for t in range(1, n):
            step = best[:, :, None] + field.move
            back.append(step.argmax(1))
            best = step.max(1) + e[:, t]
        last = (best + field.move[:, 0]).argmax(1)
        paths = [last]
        for prior in reversed(back):
            paths.append(prior[np.arange(len(ids)), paths[-1]])
        for row, i in enumerate(ids):
            out[i] = [int(p[row]) for p in reversed(paths)]
    return out


def crf_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans (code points, edge punctuation cut off) that the field finds in each text."""
    emissions, where = [], []
    for k, text in enumerate(texts):
        if "@" not in text and not DIGIT.search(text):
            continue
        ms = list(re.finditer(r"\S+", text))
        tokens = [m[0] for m in ms]
        for run in runs(tokens):
            emissions.append(field.scores(tokens, run))
            where.append((k, [ms[i].span() for i in run]))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (k, spans), path in zip(where, viterbi(field, emissions), strict=True):
        i = 0
        while i < len(path):
            j = i
            while j + 1 < len(path) and path[j + 1] == path[i]:
                j += 1
            if path[i]:
                s, e = spans[i][0], spans[j][1]
                while s < e and texts[k][s] in EDGE and texts[k][s] != "(":
                    s += 1
                while e > s and texts[k][e - 1] in EDGE:
                    e -= 1
                if s < e:
                    out[k].append((s, e, f"crf_{TAGS[path[i]]}"))
            i = j + 1
    return out


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(id, spans array<struct<start, end, kind, base>>) of every row's whole text.

    The field is trained on the driver from the labelled table (a few hundred lines) and sent
    with the task. Its spans are added where they overlap no base span. A null text is empty;
    ids may be null or repeat, each row gives a row; other columns are not read."""
    field = train() if field is None else field
    schema = (f"{id_col} {docs.schema[id_col].dataType.simpleString()}, "
              "spans array<struct<start:int,`end`:int,kind:string,base:boolean>>")

    def run(batch) -> Iterator[dict]:
        texts = column(batch, 1)
        spans = []
        for text, more in zip(texts, crf_spans(field, texts), strict=True):
            base = base_spans(text)
            rows = [(*s, True) for s in base]
            rows += [(*s, False) for s in apart(more, base)]
            rows.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            spans.append([dict(zip(("start", "end", "kind", "base"), r, strict=True)) for r in rows])
        yield {id_col: batch.column(0), "spans": spans}

    return map_rows(docs.select(id_col, text_col), schema, run)
