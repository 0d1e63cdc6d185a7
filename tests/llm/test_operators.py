"""Operators against brute force, exact round trips and the libraries themselves."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import ann, licenses, mixing, neardup, packing, suffixdedup, tokencount, toxicity, vecdedup, webtext
from tickloom.llm.queries import tokenizer_file

WORDS = "the of and to in is that it was for on are as with his they at be this have from or one had by".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "ed", "er"]) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# 1


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
    return " ".join(w)


def brute_classes(texts, least=0.8):
    import pyarrow.compute as pc

    from tickloom.llm.flat import blocks

    sets = []
    for _, _, buf, off in blocks(pc.utf8_lower(pa.array(texts)), 1 << 40):
        h, n, b = neardup.shingles(buf, off)
        sets = [(h[b[i] : b[i + 1]], n[b[i] : b[i + 1]]) for i in range(len(texts))]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        new = list(low)
        for i in range(len(texts)):
            for j in range(i):
                if neardup.probability_jaccard(*sets[i], *sets[j]) >= least:
                    new[i] = new[j] = min(new[i], new[j])
        if new == low:
            return low
        low = new
    return low


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)  # so that the tiles of a large bucket are cut
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(6)]
    texts = list(base) + [base[0]] * 5 + [edited(rng, base[1], k) for k in (1, 1, 2, 2, 3, 3, 4, 5, 6, 8) * 3] + [prose(rng, 40) for _ in range(20)] + ["", "", "a b", "a b", "!!", "??"]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def joined(n, links):
    low = list(range(n))
    for _ in range(n):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_tiles_link_repetitive_texts():
    rng = np.random.default_rng(4)
    h = [np.sort(np.append(rng.integers(-(1 << 31), 1 << 31, 100), 7)).astype(np.int32) for _ in range(3)]
    weight = [np.where(x == 7, 996, 1) for x in h[:2]] + [None]
    assert neardup.probability_jaccard(h[0], weight[0], h[1], weight[1]) > 0.8
    assert neardup._tile_links(h, weight, np.arange(3), np.zeros(3, int), False, 0.8) == [(0, 1)]
    for _ in range(200):  # the links of a tile join what all exact similarities join
        h = [np.unique(rng.integers(0, 12, 10)).astype(np.int32) for _ in range(6)]
        weight = [rng.integers(1, 50, len(x)) for x in h]
        links = neardup._tile_links(h, weight, np.arange(6), np.zeros(6, int), False, 0.5)
        want = [(i, j) for i in range(6) for j in range(i + 1, 6) if neardup.probability_jaccard(h[i], weight[i], h[j], weight[j]) >= 0.5]
        assert set(links) <= set(want) and joined(6, links) == joined(6, want)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate((a[:240], rng.integers(1, 1 << 62, 60).astype(np.uint64)))
    x, y = rng.integers(1, 4, 300), rng.integers(1, 4, 300)
    h, n = np.concatenate((a, b)), np.concatenate((x, y)).astype(float)
    r = neardup.registers(h, n, np.array([0, 300, 600]), m=4096)
    ia, ib = np.argsort(a), np.argsort(b)
    want = neardup.probability_jaccard(a[ia], x[ia], b[ib], y[ib])
    assert abs((r[0] == r[1]).mean() - want) < 0.03
    p, q = dict(zip(a.tolist(), x.tolist(), strict=True)), dict(zip(b.tolist(), y.tolist(), strict=True))
    every = set(p) | set(q)
    slow = sum(1 / sum(max(p.get(e, 0) / p[d], q.get(e, 0) / q[d]) for e in every) for d in set(p) & set(q))
    assert math.isclose(want, slow, rel_tol=1e-9)


# 2 and 7


def strange(rng, n):
    parts = [" ", "  ", "\n", "a", "the", "é", "😀", "ing", "▁", "<s>", "don't", "'LL", "½", "ŉ", "日本", "\u0000", "İ", "1", "23", "...", "<|endoftext|>", " ", "\x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_counts_at_every_prefix():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.PrefixCounter(path)
    texts = ["", " ", "hello  world", "x" * 500, *strange(random.Random(1), 300)]
    for k, chars, tokens, rows in c.texts(pa.array(texts)):
        assert tokens[-1] == len(sp.encode(texts[k]))
        for budget in (0, 2, 7):
            assert c.within(chars, tokens, rows, budget) == max(i for i in range(len(texts[k]) + 1) if len(sp.encode(texts[k][:i])) <= budget)


def test_prefix_table(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = "One line of words.\nAnd another  one"
    r = tokencount.prefix_table(frame(spark, [text]), path).first()
    assert all(len(sp.encode(text[:n])) == t for n, t in zip(r["chars"], r["tokens"], strict=True))


def test_ids_are_the_library_s():
    e = packing.WordIds(tokenizer_file("word_bpe_49k.json"))
    texts = ["", "don't I'LL 'reve x!'s ''s", *strange(random.Random(2), 400)]
    for t, ids in zip(texts, e.encode(pa.array(texts)), strict=True):
        assert ids[:-1].tolist() == e.full.encode(t, add_special_tokens=False).ids
        assert ids[-1] == 1


def test_packing_is_a_partition_without_gaps(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([1, 5, 60, 300, 3000])) for _ in range(120)] + ["", None]
    df = frame(spark, texts).repartition(3)
    e = packing.WordIds(tokenizer_file("word_bpe_49k.json"))
    whole = {i: ids for i, ids in enumerate(e.encode(pa.array([t or "" for t in texts])))}
    rows = packing.pack(df, tokenizer_file("word_bpe_49k.json"), size=256, with_ids=True).collect()
    docs, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part.tolist()
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert r["doc_tokens"] == len(whole[r["doc_id"]])
    assert set(docs) == set(range(len(texts)))
    for i, d in docs.items():
        assert sum(r["length"] for r in d) == len(whole[i])
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert sum(r["length"] for r in rows) / (256 * len(windows)) > 0.9


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 500)
    order = np.lexsort((np.arange(500), -lengths))
    window, offset = packing.best_fit(lengths, order, 100)
    room: list[int] = []
    for i in order:
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
            assert 100 - offset[i] == min(fits)
        else:
            room.append(100 - lengths[i])
            assert offset[i] == 0
    assert len(room) == window.max() + 1


# 3

PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy {n}</div><header><h2>Site</h2></header><article><h1>Head {n} &amp; co</h1>{body}<div class="comments"><p>Nice {n}</p></div></article><aside>Side {n}</aside><form><p>Join</p></form><footer>&copy; host</footer></body></html>'


def test_main_text(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for n in range(30):
        paras = [prose(rng, 30) for _ in range(3)]
        rows.append((n, f"http://a.example/{n}", PAGE.format(n=n, body="".join(f"<p>{p[:20]}<b>{p[20:]}</b>\n<br>x&lt;{n}y" for p in paras))))
        want[n] = f"Head {n} & co " + " ".join(f"{p} x<{n}y" for p in paras)
    rows += [(100, None, None), (101, "", ""), (102, "http://b.example/", "just text <b>here"), (103, "http://c.example", "<body><main><p>One<p>Two</main>Out")]
    want |= {100: "", 101: "", 102: "just text here", 103: "One Two"}
    got = {r["page_id"]: r for r in webtext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: v["text"] for k, v in got.items()} == want
    assert all(v["n_chars"] == len(v["text"]) for v in got.values())


def test_template_text_is_no_slot(spark):
    rows = [(n, f"http://a.example/{n}", f"<html><body><div><p>Share this story</p><p>{prose(random.Random(n), 20)}</p></div></body></html>") for n in range(12)]
    got = [r["text"] for r in webtext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert not any("Share" in t for t in got) and all(len(t) > 40 for t in got)


# 4


def test_mix_meets_margins_and_rate(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 300)), rng.choice(["en", "en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, keep=0.5).toPandas()
    total = out.n_tokens.sum()
    assert abs((out.n_tokens * out.probability).sum() / total - 0.5) < 1e-6
    for m in ("source", "lang"):
        own = out.groupby(m).n_tokens.sum() / total
        goal = own**0.7 / (own**0.7).sum()
        have = (out.n_tokens * out.weight).groupby(out[m]).sum() / (out.n_tokens * out.weight).sum()
        assert (have - goal).abs().max() < 0.02
    assert abs((out.n_tokens * out.sampled).sum() / total - 0.5) < 0.08
    assert set(mixing.sample(df, keep=0.5).toPandas().doc_id) == set(out[out.sampled].doc_id)


# 5


def brute_segments(x):
    """All maximal scoring segments by definition: cut out the best, then go on to both sides."""
    if not x or max(x) <= 0:
        return []
    best = max(((sum(x[i : j + 1]), -(j - i), -i) for i in range(len(x)) for j in range(i, len(x))))
    i, j = -best[2], -best[2] - best[1]
    left, right = brute_segments(x[:i]), brute_segments(x[j + 1 :])
    return left + [(round(best[0], 6), i, j)] + [(s, a + j + 1, b + j + 1) for s, a, b in right]


def test_segments_are_all_the_maximal_ones():
    rng = random.Random(8)
    for _ in range(200):
        x = [rng.choice([2.0, 1.1, 3.3, -0.7, -0.7, -0.7, -0.7]) + (rng.random() * 0.01 if rng.random() < 0 else 0) for _ in range(rng.randrange(1, 14))]
        x = [v + 0.001 * k if v > 0 else v for k, v in enumerate(x)]
        at = np.array([i for i, v in enumerate(x) if v > 0], int)
        got = [(round(s, 6), i, j) for s, i, j in toxicity.segments(at, np.array([x[i] for i in at]), -0.7)]
        assert got == brute_segments(x)


def test_toxic_texts_are_found(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(30, 200)).split()
        toxic = i % 8 == 0
        for _ in range(rng.randrange(4, 8) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vileness", "wretch", "scoundrel"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 37 else 1 - int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    hit = [got[i]["predicted"] == int(i % 8 == 0) for i in range(900)]
    assert sum(hit) / len(hit) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert set(model.words) == {"vileness", "wretch", "scoundrel"}
    kept = {r["doc_id"] for r in toxicity.reject(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_without_labels_the_score_is_their_rate(spark):
    docs = frame(spark, ["a", None, ""])
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score(docs, none).collect()] == [0.0] * 3


# 6


def brute_removed(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                m[i : i + length] = [True] * length
        out.append(m)
    return out


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    monkeypatch.setattr(suffixdedup, "CHUNK", 50)
    rng = random.Random(10)
    passage, other = prose(rng, 40), prose(rng, 25)
    texts = [prose(rng, 60) + passage[: rng.randrange(60, 200)] + prose(rng, 30) for _ in range(25)] + [prose(rng, 20) + passage + other, other + prose(rng, 10), "abc" * 200, "é" * 150, "", "short", None, passage, passage]
    rows = suffixdedup.digest(frame(spark, texts), length=60, gram=12).collect()
    raw = [(t or "").encode() for t in texts]
    for r, m, b in zip(sorted(rows, key=lambda r: r["doc_id"]), brute_removed(raw, 60), raw, strict=True):
        kept = bytes(c for c, x in zip(b, m, strict=True) if not x)
        spans = sum(x and not (i and m[i - 1]) for i, x in enumerate(m))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(m), spans, hashlib.sha256(kept).hexdigest())
    left = {r["doc_id"]: r["text"] for r in suffixdedup.remove(frame(spark, texts), length=60, gram=12).collect()}
    for i, (m, b) in enumerate(zip(brute_removed(raw, 60), raw, strict=True)):
        want = None if texts[i] is None else bytes(c for c, x in zip(b, m, strict=True) if not x)
        assert left[i] == (want if want is None else want.decode())


def test_suffix_order():
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(40)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    s, n = np.arange(40) * 30, np.array([rng.randrange(5, 31) for _ in range(40)])
    group = np.array([i % 3 for i in range(40)])
    perm = suffixdedup.Sorter(buf).order(group, s, n)
    assert perm.tolist() == sorted(range(40), key=lambda i: (group[i], texts[i][: n[i]], i))


# 8


def test_base_phrases_and_labels(spark):
    texts = ["CC BY-NC and cc, by! All Rights\nReserved", "x Released under the MIT License. y", "Licensed under the Apache License, Version 2.0", "nothing under the license", "", None, "the GNU General Public License and General Public License", "released under the the MIT license" * 3]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = licenses.words_of(t or "")
        at = sorted(k for p, _ in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(at))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((at[0], at[-1]) if at else (None, None))
    assert got[0]["base_labels"] == "cc-by,reserved"
    assert (got[1]["labels"], got[2]["labels"], got[3]["labels"], got[6]["base_labels"]) == ("mit", "apache-2.0", "", "gpl")
    assert 0 < got[2]["score"] <= 1 and got[3]["score"] == 0


# 9 and 10


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2100, [0.0] * 24, 0), (2200, [float("nan")] * 24, 0), (2300, [1.0] * 3, 0), (100, x[100].tolist(), 0)]
    got = ann.nearest(vectors(spark, rows), sample=800).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hit += len(set(best) & set(g.vec_id))
        assert np.allclose(np.sort(g.score), g.sort_values("rank").score) and np.allclose(g.score, d[g.vec_id], rtol=1e-12)
        assert sorted(g["rank"]) == list(range(1, 11))
    assert got.query_id.nunique() == 15 and hit / 150 >= 0.9


def test_neighbours_in_a_hot_group_are_all_found(spark):
    rng = np.random.default_rng(16)
    x = rng.standard_normal((6000, 16)).astype(np.float32)
    x[1000:2500] = x[0]  # equal ones
    x[3000:4500] = x[1] + 1e-3 * rng.standard_normal((1500, 16))  # the codes can't tell these apart
    shuffled = rng.permutation(6000)
    df = vectors(spark, [(int(i), x[i].tolist(), 0) for i in shuffled]).coalesce(1)
    got = ann.nearest(df, every=500, sample=600).toPandas()
    assert got.query_id.nunique() == 12
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        assert g.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(6000), d))[:10].tolist()


def test_codes_approach_the_vectors():
    x = np.random.default_rng(13).standard_normal((600, 16))
    b = ann.Codebooks.fit(x, m=6, k=32, rounds=1)
    one, wide = ((b.decode(b.encode(x, w)) - x) ** 2 for w in (1, 8))
    assert wide.sum() < one.sum() < (x**2).sum()


@pytest.mark.parametrize("tile", [7, 2048])
def test_vector_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vecdedup, "TILE", tile)
    rng = np.random.default_rng(14)
    base = rng.standard_normal((40, 16))
    x = np.concatenate((base, base[0] + 0.15 * rng.standard_normal((30, 16)), base[1:5] + 0.3 * rng.standard_normal((4, 16)), base[7:8], base[7:8])).astype(np.float32)
    label = [i % 2 if i < 40 else 0 for i in range(len(x))]
    rows = [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, label, strict=True))] + [(900, None, 0), (901, x[0].tolist(), None), (902, [0.0] * 16, 0), (903, [float("inf")] * 16, 0)]
    got = {r["vec_id"]: r for r in vecdedup.duplicates(vectors(spark, rows)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    same = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(same, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([min([low[i], *low[same[i]]]) for i in range(len(x))])
    assert [got[i]["n_links"] for i in range(len(x))] == same.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == low.tolist()
    for i in (900, 901, 902, 903):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


@pytest.mark.parametrize("cosine", [0.999, 0.93, 0.8, 0.5, 0.0, -0.5, -1.0])
def test_bands_keep_the_chance_of_a_miss(cosine):
    agree = 1 - math.acos(cosine) / math.pi
    for largest in (1, 10**3, 3 * 10**6, 6 * 10**6, 12 * 10**6, 50 * 10**6, 10**9):
        width, bands = vecdedup.plan(largest, cosine)
        assert 0 < bands and width * bands <= vecdedup.BITS and (1 - agree**width) ** bands <= vecdedup.MISS
    assert (vecdedup.band_keys(np.ones((3, 8)), 0, 1) == 0).all()  # a band of no bits is one bucket


def test_estimates_are_unbiased():
    rng = np.random.default_rng(15)
    x = rng.standard_normal((400, 32))
    o, signs, factor = vecdedup.codes(x, vecdedup.rotation(32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    error = (signs @ o.T) / factor[:, None] - unit @ unit.T
    assert abs(error.mean()) < 2e-3 and error.std() < 0.05


# cases of shared ids, clashes and long unbroken texts


def test_vectors_that_share_an_id_are_rows_of_their_own(spark):
    data = [(1, [1.0, 0.0, 0.1], 0), (1, [1.0, 0.0, 0.11], 0), (2, [1.0, 0.0, 0.12], 0), (3, [0.0, 1.0, 0.0], 0)]
    got = vecdedup.duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_a_tile_whose_rows_differ_in_label_or_band_links_nothing_across():
    turn = vecdedup.rotation(4)
    x = np.array([[1.0, 0, 0, 0]] * 4)
    for band, tag in (([0, 0, 0, 0], ["a", "a", "b", "b"]), ([0, 0, 1, 1], ["a"] * 4)):
        batch = pa.RecordBatch.from_arrays(
            [pa.array([7] * 4), pa.array(band, pa.int32()), pa.array(tag), pa.array([False] * 4), pa.array([0] * 4, pa.int32()), pa.array([0, 1, 2, 3]), pa.array([1] * 4), pa.array(x.tolist())],
            names=["tile", "band", "tag", "across", "chunk", "id", "weight", "embedding"],
        )
        got = [r for b in vecdedup._tiles(turn, 4, 8, 0.93)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert [(0, 1, 0), (1, 1, 0)] == [r for r in got if r[0] < 2] and all(r[2] >= 2 for r in got if r[0] >= 2)


def test_labels_belong_to_a_row(spark):
    mit = "Released under the MIT License"
    data = [(1, "nothing at all here"), (None, "plain words only here"), (1, mit), (None, mit), (None, None)]
    got = licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["labels"]) for r in got) == [(0, 0, ""), (0, 4, ""), (0, 5, "mit"), (1, 4, ""), (1, 5, "mit")]


def test_a_clash_of_word_hashes_is_no_vote(spark, monkeypatch):
    """Where the first word hash makes all words equal, the second still tells them apart."""
    plain = licenses._words
    monkeypatch.setattr(licenses, "_words", lambda buf, off, base=licenses.BASE: (plain(buf, off)[0] * 0, plain(buf, off)[1]) if base == licenses.BASE else plain(buf, off, base))
    grams, _ = licenses._template_rows()
    assert len({g[2] for g in grams}) == 1 and len({g[3] for g in grams}) > 100


def brute_spans(text):
    """Diagonal voting in plain Python, over the words themselves."""
    words, out = licenses.words_of(text), set()
    for label, template in licenses.TEMPLATES:
        t = licenses.words_of(template)
        grams = collections.defaultdict(list)
        for i in range(len(t) - licenses.K + 1):
            grams[tuple(t[i : i + licenses.K])].append(i)
        votes = collections.defaultdict(list)
        for p in range(len(words) - licenses.K + 1):
            for i in grams.get(tuple(words[p : p + licenses.K]), ()):
                votes[p - i].append((p, i))
        spans, last = [], None
        for d in sorted(votes):
            if last is None or d - last > licenses.NEIGHBOURS:
                spans.append([])
            spans[-1] += votes[d]
            last = d
        for s in spans:
            covered = {i + j for _, i in s for j in range(licenses.K)}
            if len(covered) / len(t) >= (licenses.LONG_SHARE if len(t) >= licenses.LONG else licenses.SHORT_SHARE):
                out.add((label, min(p for p, _ in s), max(p for p, _ in s) + licenses.K - 1))
    return out


def test_spans_equal_plain_voting(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(1, 30))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(3)):  # a word put in, left out or changed
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
            parts += [" ".join(w), prose(rng, rng.randrange(1, 30))]
        texts.append(" ".join(parts))
    got = collections.defaultdict(set)
    for r in licenses.spans(frame(spark, texts)).collect():
        got[r["doc_id"]].add((r["label"], r["first_word"], r["last_word"]))
    assert [got[i] for i in range(len(texts))] == [brute_spans(t) for t in texts]


def test_neighbours_of_each_length_and_ties(spark):
    data = [(0, [1.0, 0.0]), (5, [2.0, 0.0]), (3, [0.0, 0.0001]), (4, [1.0, 1.0]), (2, [1.0, -1.0]), (100, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 1.0]), (200, [1.0] * 5)]
    got = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 2), (0, 2, 4), (0, 3, 5), (100, 1, 7)]


# 3, without the help of element names


def brute_template(pages):
    """Classes from whole occurrence vectors, root and fixed text, in plain Python."""
    tokens = [webtext._tokens(p) for p in pages]
    n = len(pages)
    vector = {t: tuple(x.get(t, [0])[0] for x in tokens) for t in set().union(*tokens)}
    groups = collections.defaultdict(list)
    for t, v in vector.items():
        k = sum(x > 0 for x in v)
        p, z = k / n, webtext.CERTAIN
        if k > 1 and (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) >= webtext.SHARE:
            groups[v].append(t)
    valid = [(v, ts) for v, ts in groups.items() if len(ts) > 1 and any(t[1] == 0 for t in ts)]
    chars = lambda t: sum(x[t][1] for x in tokens if t in x)
    whole, best = chars((0, 0)), (0, 0, 0)
    for v, ts in valid:
        for path, token in ts:
            facts = next(x[path, token] for x in tokens if (path, token) in x)
            k = sum(x > 0 for x in v)
            if token == 0 and path and max(v) == 1 and not facts[3] and whole and chars((path, 0)) >= webtext.HOLDS * whole * k / n:
                best = max(best, (facts[2], chars((path, 0)), path))
    return best[2], {t[1] for _, ts in valid for t in ts if t[1]}


def bare_page(rng, n, layout):
    """Menus, notices and footers that no name, class or element gives away."""
    links = "".join(f"<li><a href='/{w}'>{w}</a>" for w in rng.sample(WORDS, 5))
    body = "".join(f"<p>{prose(rng, rng.randrange(20, 60))}</p>" for _ in range(rng.randrange(2, 6)))
    if layout:
        return f"<html><body><table><tr><td>{links}</td><td><div class=x7><h1>Head {n}</h1>{body}<p>Read more on our site</p></div></td></tr></table></body></html>"
    return f"<html><body><div><ul>{links}</ul></div><div class='k3 z'><h1>Head {n}</h1>{body}<div>All texts here are free of charge</div></div><div>Written by {prose(rng, 2)}</div></body></html>"


def test_templates_equal_plain_classes(spark):
    rng = random.Random(8)
    rows = [(i, f"http://{host}.example/{i}", bare_page(rng, i, layout)) for host, n, layout in (("a", 40, 0), ("b", 30, 1), ("c", 5, 0), ("d", 2, 1), ("e", 1, 0)) for i in range(n)]
    rows += [(i, f"http://f.example/{i}", bare_page(rng, i, i % 3 == 0)) for i in range(60)]
    pages = spark.createDataFrame([(k, u, h) for k, (_, u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    hosts = collections.defaultdict(list)
    for _, url, page in rows:
        hosts[url.split("/")[2]].append(page)
    hosts["*"] = [p for _, _, p in rows]
    keyed = pages.selectExpr("split(url, '/')[2] AS host", "html")
    got = {r["host"]: (r["root"] or 0, set(r["fixed"] or ())) for r in webtext.templates(keyed).collect()}
    for host, own in hosts.items():
        root, fixed = brute_template(own)
        assert got[host] == (root, fixed if host != "*" else set()), host
    text = {r["page_id"]: r["text"] for r in webtext.extract(pages).collect()}
    for k, (_, url, page) in enumerate(rows):
        host = url.split("/")[2]
        roots = tuple(r for r in (got[host][0], got["*"][0]) if r)
        assert text[k] == webtext.main_text(page, roots, frozenset(got[host][1]))
        if host in ("a.example", "b.example", "c.example"):
            assert text[k].startswith("Head") and not any(x in text[k] for x in ("Read more", "free of charge", "Written by"))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content with-sidebar"><p>hello world article</p></div>', "hello world article"),
        ('<article><h2 id="form-and-function">Form</h2><p id="notice">And this</p></article>', "Form And this"),
        ('<h2 id="form-and-function">Form</h2><p id="notice">And this</p>', "Form And this"),
        ("<p>Let <math><mi>x</mi></math> be</p>", "Let x be"),
        ('<article><section id="discussion">We found</section></article>', "We found"),
        ('<main><p>a</p><div class="cookie-banner">b</div><div class="comment-list">c</div></main>', "a"),
        ("<form><main><p>in</p></main></form>", "in"),
        ("x < y and <b>z</b>", "x < y and z"),
        ("<p title=\"oops>a</p><p>b</p>", "a b"),
        ("a<!-- never ends", "a"),
        ("a<script>never ends", "a"),
        ("", ""),
    ],
)
def test_pieces_of_pages(page, text):
    assert webtext.main_text(page, (), frozenset()) == text


def test_pages_take_linear_time():
    import time

    for page in ("<a" + "b" * 1_000_000, "<a " * 300_000, "<div>" * 50_000 + "</x>" * 50_000, "<p><div>" + "<b>" * 30_000 + "<hr>" * 30_000, "<!" * 500_000, '<a x="' * 300_000):
        began = time.process_time()
        webtext.main_text(page, (), frozenset())
        webtext._tokens(page)
        assert time.process_time() - began < 10


def test_a_host_of_copies_keeps_its_text(spark):
    page = "<html><body><div><p>The one text of this host</p></div></body></html>"
    got = webtext.extract(spark.createDataFrame([(i, "http://a/", page) for i in range(9)], "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == ["The one text of this host"] * 9


# different texts of one id, and equal rows


def shared(spark):
    rng = random.Random(31)
    a, b = prose(rng, 120), prose(rng, 120)
    return a, b, [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose(rng, 90)), (4, prose(rng, 90))]


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, b, rows = shared(spark)
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert sorted(r["k"] for r in neardup.keep_one(docs).collect()) == [0, 1, 4, 5]


def test_one_text_stays_of_a_class_that_shares_its_id(spark):
    a, _, _ = shared(spark)
    rows = [(1, a, 0), (1, a + " more", 1), (1, a, 2), (2, a + " other", 3), (3, None, 4), (3, "", 5), (None, a, 6)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(3)).collect()
        ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept)
        assert ids == [-1, 1, 3]
        keys = {r["k"] for r in kept}
        assert seed == 0 or keys == last
        last = keys


def brute_shared(rows, least=0.8):
    low = brute_classes([t for _, t in rows], least)
    return [min(d for (d, _), c in zip(rows, low, strict=True) if c == own) for own in low]


def test_classes_with_shared_ids_equal_brute_force(spark):
    rng = random.Random(32)
    base = [prose(rng, 60) for _ in range(6)]
    rows = [(rng.randrange(12), edited(rng, rng.choice(base), rng.randrange(3))) for _ in range(50)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    want = sorted((d, c) for (d, _), c in zip(rows, brute_shared(rows), strict=True))
    assert sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect()) == want
    assert len(neardup.keep_one(docs).collect()) == len(set(brute_classes([t for _, t in rows])))


def test_many_equal_rows_are_cut_in_linear_time(spark):
    import time

    rng = random.Random(33)
    text, took = prose(rng, 400), []
    for n in (200, 5000):
        docs = spark.createDataFrame([(7, text)], "doc_id long, text string").crossJoin(spark.range(n)).select("doc_id", "text")
        began = time.time()
        out = suffixdedup.digest(docs).groupBy("n_removed", "n_bytes", "n_spans").count().collect()
        took.append(time.time() - began)
        assert [tuple(r) for r in out] == [(len(text), len(text), 1, n)]
    assert took[1] < 8 * took[0]
