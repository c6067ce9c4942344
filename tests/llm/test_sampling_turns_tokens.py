"""Importance resampling, conversation repair and streamed BPE against brute force and the library."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.llm import bpe, resample, turns
from matchflow.llm.packing import vocabulary
from matchflow.llm.queries import QUERIES
from tests.conftest import SF_SMALL

EXTRA = ("id", "n", "score", "rank", "weight", "run", "place", "segment", "eligible", "h", "c", "t", "r", "x", "again", "_kind", "_copy", "_id", "ids", "decoded", "n_words")
LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
DOCS = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (5, "twin text of five words and more " * 5), (5, "twin text of five words and more " * 5),
        (6, "twin text of five words and more " * 5), (7, LONG), (8, "a"), (8, "b"), (9, "é" * 3000 + "9" * 700), (None, "x y " * 30)]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit(1) for c in EXTRA})


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- importance resampling ---------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_grams(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, items):
    """(doc_id, n_features, weight, score, rank) as sorted lists."""
    grams = [(i, *brute_grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, g in grams for b in g), Counter(b for x in items for b in brute_grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for i, n, g in grams:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, g))
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((k for k, r in enumerate(rows) if r[4] >= 20), key=lambda k: (-rows[k][3], rows[k][0] is not None, rows[k][0], k))
    rank = {k: at + 1 for at, k in enumerate(order[:5 * len(order) // 100])}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(rows)), key=str)


def got_resample(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_crcs_of_word_runs():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abé9") for _ in range(rng.choice((1, 2, 7, 300, 70_000 if not d else 3)))) for _ in range(rng.randint(1, 9))) for d in range(8)]
    import pyarrow as pa
    got = defaultdict(Counter)
    for first, _, bucket, row in resample._grams(pa.array(texts)):
        for b, d in zip(bucket.tolist(), row.tolist()):
            got[first + d][b] += 1
    for d, text in enumerate(texts):
        assert got[d] == Counter(brute_grams(text)[1])


def test_resampling_equals_brute_force(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = brute_resample(docs, items)
    assert got_resample(QUERIES["op11_importance_resampling"](spark, SF_SMALL)) == want
    monkeypatch.setattr(resample, "BLOCK_WORDS", 7)  # blocks and samples only change cost
    monkeypatch.setattr(resample, "SAMPLES", 5)
    assert got_resample(QUERIES["op11_importance_resampling"](spark, SF_SMALL)) == want


def test_resampling_of_odd_and_empty_tables(spark, odd, none):
    target = spark.createDataFrame([("twin text of words",), (None,)], "text string")
    assert got_resample(resample.resample(odd, target)) == brute_resample(DOCS, ["twin text of words", None])
    assert resample.resample(none, target).count() == 0
    assert got_resample(resample.resample(odd, target.where("false"))) == brute_resample(DOCS, [])


def test_ranks_are_exact_where_one_row_is_most_of_all(spark):
    """Most rows are one row many times; segments cut through them."""
    rows = [(i, "same words " * 10) for i in [7] * 900 + list(range(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = resample.resample(docs, docs.limit(0), percent=40).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 401))
    assert [(-r.score, r.doc_id) for r in out] == sorted((-r.score, r.doc_id) for r in out)
    scored = spark.range(1000).select(F.lit(3).alias("id"), F.lit(9).alias("score"), F.lit(True).alias("eligible"))
    segments = resample.ranked(scored.repartition(5), 1000, 8, 1000)
    assert sorted(r["rank"] for r in segments.collect()) == list(range(1, 1001))


# --- conversations -----------------------------------------------------------------------------


def brute_repair(rows):
    """Dijkstra over (turn, state of the grammar), ordered by (cost, audit): no tables, no bands."""
    faults, seen = [], set()
    for _, role, text in rows:
        visible = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in ("", "a"):
            break
        done.add((i, state))
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for n in nexts:
            name = {"u": "user", "a": "assistant"}.get(n)
            if name:
                heapq.heappush(heap, (cost + 2, audit + "I", i, n, (*out, f"{name}:")))
            if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if rows[i][1][:1] == n:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, n, (*out, f"{rows[i][1]}:{rows[i][2]}")))
                elif name:
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, n, (*out, f"{name}:{rows[i][2]}")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
    counts = Counter(faults)
    places = [r[0] for r in rows if r[0] is not None]
    gaps = max(places) - min(places) + 1 - len(set(places)) if places else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_conversations(table):
    out, ids = defaultdict(list), set()
    for conv, turn, role, text in table:
        name = lambda v: " " if v is None else str(v)
        ids.add(conv)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else name(role), name(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: brute_repair(sorted(out[c], key=order)) for c in ids}


def got_conversations(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_conversations_equal_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_conversations(QUERIES["op12_turn_alignment"](spark, "/root/testdata/sf0.01")) == brute_conversations(table)


def test_odd_conversations_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "u2"]
    texts = ["A.", "B", "", " \n", None, "Really? ", "x!\t"]
    table = [(c, rng.choice((None, *range(9))), rng.choice(roles), rng.choice(texts)) for c in (None, *range(150)) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in EXTRA if c != "n"}).repartition(3)
    want = brute_conversations(table)
    assert got_conversations(turns.repair_damaged(df)) == want
    assert turns.repair_damaged(df.where("false")).count() == 0
    assert turns.repair(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_of_turns_give_the_same_repair(block, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", block)
    turns.align.cache_clear()
    rng = random.Random(block)
    for _ in range(200):
        rows = [(i, rng.choice(("user", "assistant", "system", "tool")), rng.choice(("A.", f"{i}!", "cut", ""))) for i in range(rng.randint(1, 12))]
        r, seen = turns.Repair(), set()
        for _, role, text in rows:
            r.add(role, text, "x" if not text or (role, text) in seen else "-" if text[-1] in ".!?" else "t")
            seen.add((role, text))
        assert r.done() == brute_repair(rows)[5:]
    turns.align.cache_clear()


def test_a_long_conversation_is_repaired_in_blocks(spark):
    rows = [(1, i, ("user", "assistant")[(i + i // 50) % 2], f"Turn {i % 700}" + "." * (i % 3 > 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = turns.repair(df).first()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == brute_repair([x[1:] for x in rows])


# --- BPE ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(vocabulary())


def mine(encoder, text):
    return list(array("I", b"".join(encoder.stream(text))))


def test_stream_equals_library(library, encoder):
    rng = random.Random(3)
    letters = "abc 'stvermlld09.,!-É éßÀıİΣς́ \u0085\x1c\x1f​᠎　﻿<|endoftext|>東京\U0001f600K²①\n\t\r\x00\x7fǅ"
    back = bpe.Decoder(encoder.v)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        text += rng.choice(("", "", "<|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>"))
        want = library.encode(text, add_special_tokens=False).ids
        assert mine(encoder, text) == want
        parts = array("I", want).tobytes()
        cut = 4 * rng.randint(0, len(want))
        assert back.push(parts[:cut]) + back.push(parts[cut:]) + back.finish() == library.decode(want, skip_special_tokens=False)


def test_long_runs_are_emitted_within_the_lookahead(library, encoder):
    rng = random.Random(4)
    tokens = [t.removesuffix("</w>") for t in sorted(library.get_vocab()) if t.removesuffix("</w>").isalpha() and t.isascii()]
    for text in ("a" * 5000, "ab" * 3000, "!?" * 2000, "é" * 2500, "thethethe" * 700, "東" * 1500, *("".join(rng.choice(tokens) for _ in range(500)) for _ in range(8))):
        text = text.lower()
        assert mine(encoder, text) == library.encode(text, add_special_tokens=False).ids
        run, out, most = bpe.Transducer(encoder.v), [], 0
        data = text.encode()
        for at in range(0, len(data), 97):
            out += run.feed(data[at:at + 97])
            most = max(most, len(run.pending))
        assert most <= encoder.v.lookahead + run.block and out + run.finish() == library.encode(text, add_special_tokens=False).ids


def test_lookahead_is_enough_and_needed():
    """All texts over a small vocabulary: tokens with that much known text behind them never
    change, whatever follows, and with one symbol less some do."""
    merges = [("b", "c"), ("a", "bc"), ("a", "b"), ("c", "a"), ("ab", "ca"), ("b", "b")]
    rules = {m: r for r, m in enumerate(merges)}

    def encode(text):
        out = list(text)
        while True:
            found = min(((rules[p], i) for i, p in enumerate(zip(out, out[1:])) if p in rules), default=None)
            if found is None:
                return out
            out[found[1]:found[1] + 2] = ["".join(out[found[1]:found[1] + 2])]

    import itertools
    ahead = bpe.lookahead(merges)
    broken = set()
    for text in map("".join, itertools.product("abc", repeat=7)):
        whole = encode(text)
        for known in range(1, 7):
            end = 0
            for k, token in enumerate(encode(text[:known])):
                end += len(token)
                if whole[k:k + 1] != [token]:
                    broken.add(known - end)
                    break
    assert broken and max(broken) < ahead <= 7


def test_round_trip_of_odd_tables(spark, odd, none, library):
    got = bpe.round_trip(odd).collect()
    want = []
    for i, text in DOCS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), array("I", ids).tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert bpe.round_trip(none).count() == 0


def test_plain_decoding_gives_the_text_back(encoder):
    back = bpe.Decoder(encoder.v, plain=True)
    text = "naïve words , 1 2 東 京 école"
    data = b"".join(encoder.stream(text))
    pieces = [back.push(data[at:at + 4]) for at in range(0, len(data), 4)]
    assert "".join(pieces) + back.finish() == text + " " and len(pieces) > 7
    assert back.push(array("I", [4_000_000]).tobytes()) == ""


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op13_bpe_stream"](spark, SF_SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
