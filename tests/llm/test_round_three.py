"""Byte-level BPE, spelling variants and conversation repair against the library and brute force."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import bytebpe, spelling, turns
from tickloom.llm.interned import Interned
from tickloom.llm.queries import tokenizer_file

RANKS = tokenizer_file("byte_bpe_50k.tiktoken")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# 11


@functools.cache
def library(path=RANKS):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    rng = random.Random(1)
    some = [*"aabcdest'''  \n\t\r.,!?-_0123½²éçßñ漢字かな😀 　\u0085\x1c", "ć", " the", " and", "'re", "'ll", "'ve", "'s", " '"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*texts, "", "'", "''s", "x'", "x'r", "x're", "'l", "a'sup", " 's", "\n's", "  'd", "<|endoftext|>", "a" * 30_000, "-" * 500, " " * 1000, "=\n" * 200, "anunbrokenword" * 300]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_library(name):
    texts = odd_texts(4000)
    got = []
    for _, ids, bounds in bytebpe.codec(tokenizer_file(name)).texts(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in itertools.pairwise(bounds.tolist())]
    assert got == [library(tokenizer_file(name)).encode_ordinary(t) for t in texts]


def test_codec_goes_on_when_its_store_is_emptied(monkeypatch):
    monkeypatch.setattr(bytebpe, "KEEP", 10)
    c, texts = bytebpe.Codec(RANKS), odd_texts(200)
    for _ in range(2):
        for i, ids, bounds in c.texts(pa.array(texts)):
            assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds.tolist())] == [library().encode_ordinary(t) for t in texts[i : i + len(bounds) - 1]]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64)
    assert sorted(bytebpe.PerfectHash(keys).find(keys).tolist()) == list(range(5000))


def test_interned_keeps_colliding_strings_apart(monkeypatch):
    from tickloom.llm import interned

    real = interned.words
    monkeypatch.setattr(interned, "words", lambda *a: (real(*a)[0], np.zeros(len(a[1]), np.uint64)))
    x, raw = Interned(), b"oneonetwotwothree" + b"x" * 40
    start, end = np.array([0, 3, 6, 9, 12, 17]), np.array([3, 6, 9, 12, 17, 57])
    rows, fresh = x.rows(np.frombuffer(raw, np.uint8), start, end)
    assert rows.tolist() == [0, 0, 1, 1, 2, 3] and fresh.tolist() == [0, 2, 4, 5]


def test_encode_decode_round_trip(spark):
    texts = [*odd_texts(100), None]
    docs = frame(spark, texts).repartition(3)
    ids = bytebpe.encode(docs, RANKS)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bytebpe.decode(ids, RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bytebpe.digests(docs, RANKS).collect():
        text = texts[r["doc_id"]] or ""
        want = library().encode_ordinary(text)
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# 12


def plain_variants(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = sorted(w for w, c in n.items() if len(w) >= 5 and c >= 3)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, Counter()
    for w in words:
        others = [v for v in words if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def variants(docs):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs).collect())


def spelled(rng, n):
    stems = ["maison", "école", "straße", "aaaab", "banana", "àéîõü", "x×y÷z", "abcde" * 13, "abcdefgh" * 8, "q" * 70]
    letters = "abcéß×z"
    out = []
    for _ in range(n):
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[i : i + (kind != 0)] = [] if kind == 1 else [rng.choice(letters)]
        out.append("".join(w))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in spelled(rng, 200))) for i in range(60)] + [(None, "Maison maison, maison"), (None, None), (5, "")] + [(7, "ecole ecole ecole")] * 2
    got = variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    want = plain_variants(docs)
    assert got == want
    assert any(len(w[0]) > 64 and w[4] for w in want) and any(w[1] and w[2] != w[1] for w in want)


def test_variants_over_small_batches_and_flushes(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, " ".join(spelled(rng, 50))) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert variants(spark.createDataFrame(docs, "doc_id long, text string")) == plain_variants(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    c, seen = spelling.RunCounter(), Counter()
    for i in range(3):
        buf = np.frombuffer(b"maison maisons " * 3, np.uint8)
        c.block(buf, np.array([0, len(buf)]), [str(i)])
        for b in c.batches():
            seen.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    assert seen["maison"] == 9 and seen["maisons"] == 9


def test_a_very_long_word_has_near_words(spark):
    w = "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))
    docs = [(0, f"{w} {w} {w} {w} {w} {w} {w[:-1]} {w[:-1]} {w[:-1]}")]
    got = variants(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [(len(x[0]), x[3], x[4], x[1] == w) for x in sorted(got, key=lambda x: -len(x[0]))] == [(20_000, 6, 1, False), (19_999, 3, 1, True)]


# 13


def plain_structure(rows):
    """Damage and faults by definition, the repair by trying every edit of every row with insertions between."""
    got = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        if k:
            got[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for c, own in got.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kind = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\f\r")
            kind.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turn = {t for t, *_ in own if t is not None}
        gaps = max(turn) - min(turn) + 1 - len(turn) if turn else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))

        def edits(own=own, kind=kind):
            ins = [(3, "I", "user:"), (3, "I", "assistant:")]
            gap = [[], *([x] for x in ins), *(list(x) for x in itertools.product(ins, ins))]
            each = []
            for (_, role, text), k in zip(own, kind, strict=True):
                more = 3 * (k == "truncated")
                mine = [(4, "D", None)]
                if k not in ("blank", "duplicate"):
                    mine += [(more, "K", f"{role}:{text}"), (more + 3, "R", f"user:{text}"), (more + 3, "R", f"assistant:{text}")]
                each.append(mine)
            ways = {}
            for x in gap:
                keep(ways, x)
            for mine in each:
                new = {}
                for (cost, audit, lines), e, x in itertools.product(ways.values(), mine, gap):
                    keep(new, [e, *x], cost, audit, lines)
                ways = new
            return ways.values()

        def keep(ways, x, cost=0, audit="", lines=()):
            for e_cost, e, line in x:
                cost, audit, lines = cost + e_cost, audit + e, lines + ((line,) if line is not None else ())
            # a prefix that can still be completed, by what it leads to; the best of each kind
            shape = "".join(y[:1] for y in lines)
            if not re.fullmatch("s?(ua)*u?", shape):
                return
            to = (shape[-1:], len(shape) > 0)
            if to not in ways or (cost, audit) < ways[to][:2]:
                ways[to] = (cost, audit, lines)

        cost, audit, lines = min((w for w in edits() if re.fullmatch("(s?(ua)+)?", "".join(y[:1] for y in w[2]))), key=lambda w: w[:2])
        out.append((c, gaps, *(kind.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def talk(rng, convs, most):
    texts = ["Yes.", "No!", "Why?", "and then", "  ", "", "a longer one.\n", None, "tab.\t\x0b", "é…", "Yes."]
    rows = []
    for c in [*range(convs), None]:
        for t in range(rng.randrange(1, most)):
            if rng.random() < 0.9:
                rows.append((c, None if rng.random() < 0.05 else t + (5 if rng.random() < 0.05 else 0), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("span", [1, 5, 64])
def test_structure_equals_brute_force(spark, monkeypatch, span):
    rows = talk(random.Random(span), 60, 14)
    want = plain_structure(rows)
    got = {}
    for c, t, role, text in rows:
        got.setdefault(c, []).append((c, t, role, text))
    monkeypatch.setattr(turns, "SPAN", span)
    found = turns.structure(turns.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    assert sorted((tuple(r) for r in found), key=str) == want


def test_long_conversation_in_blocks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randrange(400)} {rng.choice(['.', ''])}") for t in range(3000)]
    found = turns.structure(turns.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [tuple(r) for r in found] == plain_structure(rows)


def test_least_audit_over_all_edits():
    """Cells against every sequence of edits of a few rows, not a dynamic programme."""
    rng = random.Random(11)
    for _ in range(150):
        rows = [(rng.choice(["s", "u", "a", "x"]), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randrange(1, 4))]
        best = None
        gaps = ["", "u", "a", "ua", "au"]
        options = [[("D", "", 4)] + ([] if f == "blank" else [(e, r, c + 3 * (f == "truncated")) for e, r, c in (("K", i, 0), ("R", "u", 3), ("R", "a", 3))]) for i, f in rows]
        for chosen in itertools.product(*options):
            for ins in itertools.product(gaps, repeat=len(rows) + 1):
                shape = ins[0] + "".join(c[1] + x for c, x in zip(chosen, ins[1:], strict=True))
                if re.fullmatch("(s?(ua)+)?", shape):
                    audit = "I" * len(ins[0]) + "".join(c[0] + "I" * len(x) for c, x in zip(chosen, ins[1:], strict=True))
                    key = (sum(c[2] for c in chosen) + 3 * sum(map(len, ins)), audit)
                    best = key if best is None else min(best, key)
        cell = turns.parse([turns.leaf(*r) for r in rows])
        assert min(cell[0, q] for q in turns.ENDS if (0, q) in cell) == best


def test_repaired_rows(spark):
    rows = talk(random.Random(3), 40, 12)
    hurt = turns.damaged(spark.createDataFrame(rows, SCHEMA))
    found = turns.structure(hurt)
    lines = {}
    for r in turns.repair(hurt, found).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


# edges


def test_edges(spark):
    schema = "doc_id long, text string, id string, n string, key string, word string, ids string, there string"
    x = ("x",) * 6
    rows = [(0, "abcde abcde abcde", *x), (0, "abcde abcde abcde", *x), (None, None, *(None,) * 6), (3, "", *x), (4, "long " * 60_000, *x)]
    docs = spark.createDataFrame(rows, schema)
    assert len(bytebpe.digests(docs, RANKS).collect()) == 5
    assert {r["word"]: r["n"] for r in spelling.variants(docs).collect()} == {"abcde": 6}
    none = spark.createDataFrame([], schema)
    assert bytebpe.digests(none, RANKS).collect() == [] and spelling.variants(none).collect() == []
    talks = spark.createDataFrame([(None, None, None, None, "x", "y", "z"), (1, 1, "user", "w " * 100_000, "x", "y", "z")], SCHEMA + ", fault string, there string, copy string")
    found = {r["conv_id"]: r for r in turns.structure(turns.damaged(talks)).collect()}
    assert set(found) == {None, 1}
    assert turns.structure(turns.damaged(talks.limit(0))).collect() == []
