"""Toxicity, mixing and the whole pipeline against plain Python versions, with nulls, empty and repeated rows, extra columns and empty tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tickloom.llm import mixing, neardup, packing, suffixdedup, tokencount, toxicity
from tickloom.llm.queries import tokenizer_file

from .test_operators import brute_classes, brute_removed, brute_segments, frame, prose

BAD = ["vileness", "wretch", "scoundrel"]


def words_of(text):
    return re.findall("[A-Za-z\u0080-\U0010ffff]+", (text or "").lower())


def spark_hash(label, salt):
    """xxhash64(label, salt) as Spark has it."""
    one = xxhash.xxh64(struct.pack("<q", label), seed=42).intdigest()
    two = xxhash.xxh64(struct.pack("<i", salt), seed=one).intdigest()
    return two - (1 << 64) if two >> 63 else two


class BruteToxicity:
    """The model by its definition: document counts in dictionaries, segments by exhaustive search."""

    def __init__(self, docs, labels):
        truth = {}
        for doc, toxic in labels:
            if doc is not None and toxic is not None and zlib.crc32(str(doc).encode()) % 5:
                truth[doc] = max(truth.get(doc, 0), toxic)
        own = [(t, truth[d], spark_hash(d, 7) % 4) for d, t in docs if d in truth]
        fit, rest = [x for x in own if x[2]], [x for x in own if not x[2]]
        toxic, clean = sum(x[1] for x in fit), sum(1 - x[1] for x in fit)
        self.words, self.weights = {}, None
        count = collections.defaultdict(lambda: [0, 0])
        for text, bad, _ in fit:
            for w in set(words_of(text)):
                count[w][1 - bad] += 1
        for w, (x, y) in count.items():
            if x >= toxicity.LEAST:
                prior = toxicity.PRIOR * (x + y)
                a, b = x + prior * toxic / (toxic + clean), y + prior * clean / (toxic + clean)
                odds = math.log(a / (toxic * (1 + toxicity.PRIOR))) - math.log(b / (clean * (1 + toxicity.PRIOR)))
                error = math.sqrt(1 / a + 1 / b)
                if odds - 2 * error > toxicity.LEAST_ODDS:
                    self.words[w] = odds - error
        segs = [self.sums(t) for t, _, _ in rest]
        best = [max(s, default=0.0) for s in segs]
        quiet = sorted(b for b, (_, bad, _) in zip(best, rest, strict=True) if not bad and b > 0)
        least = quiet[0] if quiet else 1.0
        self.scale = min(3.0, max(0.3, math.log(2) / max(float(np.median(quiet)) - least, 1e-3))) if quiet else 1.0
        self.log_k = math.log(max(len(quiet), 0.5) / max(sum(len(words_of(t)) for t, bad, _ in rest if not bad), 1)) + self.scale * least
        x = np.array([self.features(t) for t, _, _ in rest])
        self.weights = toxicity._logistic(x, np.array([bad for _, bad, _ in rest], float))

    def sums(self, text):
        return [s for s, _, _ in brute_segments([self.words.get(w, toxicity.DRIFT) for w in words_of(text)])]

    def features(self, text):
        n = len(words_of(text))
        base = self.log_k + math.log(max(n, 1))
        excess = [self.scale * s - base for s in self.sums(text)]
        strong = [e for e in excess if e > -math.log(toxicity.EXPECTED)]
        best = max(excess, default=-base if n else 0.0)
        return [1.0, max(-8.0, min(best, 40.0)), math.log1p(sum(strong)), math.log1p(len(strong))]

    def score(self, text):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights @ self.features(text))))))


def labelled(rng, n, mean=12):
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(3, 2 * mean)).split()
        toxic = i % 5 == 0
        for _ in range(rng.randrange(1, 5) if toxic else int(rng.random() < 0.05)):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) if rng.random() < 0.9 else rng.choice(BAD).upper())
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic) if rng.random() < 0.95 else 1 - int(toxic)))
    return docs, labels


def test_logistic_is_at_its_best():
    rng = np.random.default_rng(1)
    x = np.column_stack((np.ones(200), rng.standard_normal((200, 3))))
    y = (rng.random(200) < 1 / (1 + np.exp(-x @ [0.5, 2, -1, 0]))).astype(float)
    w = toxicity._logistic(x, y)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w))) - [0, *w[1:]]).max() < 1e-6


def test_scores_equal_plain_ones(spark):
    docs, labels = labelled(random.Random(21), 600)
    docs += [(600, None), (601, ""), (602, "WRETCH wretch scoundrel"), (None, "wretch vileness"), (0, docs[0][1])]
    labels += [(None, 1), (3, None), (5, 1), (5, 0)]
    brute = BruteToxicity(docs, labels)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    assert model.words == pytest.approx(brute.words) and set(BAD) == set(model.words)
    assert (model.scale, model.log_k) == pytest.approx((brute.scale, brute.log_k)) and model.weights == pytest.approx(tuple(brute.weights), abs=1e-4)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["score"]) for r in toxicity.score(d, model).collect())
    want = sorted((i if i is not None else -1, brute.score(t)) for i, t in docs)
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-4)  # the plain sums have six decimals


def topic(text):
    n, words = len(text), len(text.split(" "))
    if not n:
        return "empty"
    if words < 50:
        return "notes"
    if 10 * sum(c in "#$%&*+/<=>@[]^_{|}~" for c in text) > n:
        return "marked"
    return "listing" if (text.count("\n") + 1) * 12 > words else "prose"


def brute_mix(rows, keep=0.5):
    """(doc_id, text, lang, source) -> probability and fate of each row, by plain raking in numpy until the margins agree."""
    cells = collections.Counter()
    keyed = []
    for doc, text, lang, source in rows:
        text = text or ""
        key = (source if source is not None else "(none)", lang if lang is not None else "(none)", topic(text))
        n = text.count(" ") + 1 if text else 0
        cells[key] += n
        keyed.append((doc, key, n))
    keys = list(cells)
    t = np.array([cells[k] for k in keys], float)
    total, w = t.sum(), np.ones(len(keys))
    margins = []
    for i in range(3):
        own = collections.Counter()
        for k, x in zip(keys, t, strict=True):
            own[k[i]] += x
        p = {v: x**mixing.FLATTEN for v, x in own.items() if x > 0}
        margins.append({v: x / sum(p.values()) for v, x in p.items()})
    for _ in range(100_000):
        error = 0.0
        for i, goal in enumerate(margins):
            have = collections.Counter()
            for k, x in zip(keys, t * w, strict=True):
                have[k[i]] += x
            error = max([error, *(abs(1 - have[v] / (g * total)) for v, g in goal.items())])
            w = np.array([y * (goal[k[i]] * total / have[k[i]] if k[i] in goal and have[k[i]] > 0 else 1) for k, y in zip(keys, w, strict=True)])
        if error <= mixing.TOLERANCE:
            break
    w *= total / (t * w).sum()
    low, high = 0.0, 1 / w[t > 0].min()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (t * np.minimum(1, mid * w)).sum() < keep * total else (low, mid)
    p = dict(zip(keys, np.minimum(1, low * w), strict=True))
    out = []
    for doc, key, n in keyed:
        u = int(hashlib.md5(f"mix:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16) / 2**32
        out.append((p[key] if n else 0.0, n > 0 and u < p[key]))
    return out


def mixed(rng, n):
    return [(i if i % 50 else None, rng.choice(["", None, prose(rng, 10), prose(rng, 80), "\n".join(["a b c"] * 40), "### ++ " * 60]) if i % 3 else prose(rng, rng.randrange(1, 200)), rng.choice(["en", "en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 4}") for i in range(n)]


def test_mix_equals_plain_raking(spark):
    rows = mixed(random.Random(22), 700)
    out = mixing.mix(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, k long").select("doc_id", "text", "lang", "source"))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["source"], r["n_tokens"], round(r["probability"], 6), r["sampled"]) for r in out.collect())
    want = sorted((d if d is not None else -1, s, (t or "").count(" ") + 1 if t else 0, round(p, 6), f) for (d, t, _, s), (p, f) in zip(rows, brute_mix(rows), strict=True))
    assert got == want and out.first()["residual"] <= mixing.TOLERANCE


def plain_rake(cells, goals, rounds=300_000):
    """Weights of (a, x) -> tokens by raking alone, without any stop but agreement."""
    keys, t = list(cells), np.array(list(cells.values()), float)
    w, index = np.ones(len(keys)), [[sorted(g).index(k[i]) for k in keys] for i, g in enumerate(goals)]
    aim = [np.array([g[v] for v in sorted(g)]) * t.sum() for g in goals]
    for _ in range(rounds):
        error = 0.0
        for at, goal in zip(index, aim, strict=True):
            f = goal / np.bincount(at, t * w, len(goal))
            error, w = max(error, np.abs(1 - 1 / f).max()), w * f[at]
        if error <= mixing.TOLERANCE:
            break
    return dict(zip(keys, w, strict=True)), error


@pytest.mark.parametrize("case", ["tied", "chain"])
def test_slow_raking_reaches_the_targets(spark, case):
    if case == "tied":
        cells, goals = {("a", "x"): 1_000_000, ("a", "y"): 100, ("b", "x"): 100, ("b", "y"): 1_000_000}, ({"a": 0.6, "b": 0.4}, {"x": 0.5, "y": 0.5})
    else:
        rng = random.Random(4)
        cells = {(f"s{i}", f"l{j}"): rng.randrange(1, 9) * (100_000 if i == j else 1_000 if abs(i - j) == 1 else 1) for i in range(6) for j in range(6)}
        goals = ({f"s{i}": (i + 1) / 21 for i in range(6)}, {f"l{i}": (6 - i) / 21 for i in range(6)})
    check_raked(spark, cells, goals, mixing.ROUNDS, mixing.TOLERANCE)


def test_targets_that_need_a_zero_are_approached(spark):
    cells, goals = {("a", "x"): 5, ("a", "y"): 5, ("b", "y"): 5}, ({"a": 0.5, "b": 0.5}, {"x": 0.5, "y": 0.5})
    check_raked(spark, cells, goals, 40, 0.02)


def check_raked(spark, cells, goals, rounds, most):
    frame = spark.createDataFrame([(*k, n) for k, n in cells.items()], "s string, l string, tokens long")
    fitted, error = mixing.rake(frame, {m: spark.createDataFrame(sorted(g.items()), f"{m} string, target double") for m, g in zip("sl", goals, strict=True)}, rounds=rounds)
    got = {(r["s"], r["l"]): r["weight"] for r in fitted.collect()}
    total = sum(cells.values())
    for i, goal in enumerate(goals):
        for v, aim in goal.items():
            assert abs(sum(cells[k] * w for k, w in got.items() if k[i] == v) / total / aim - 1) < 3 * most
    assert error <= most
    if most <= mixing.TOLERANCE:
        want, rest = plain_rake(cells, goals)
        scale = sum(cells[k] * want[k] for k in cells) / total
        assert rest <= 1e-6 and all(abs(got[k] * scale / want[k] - 1) < 1e-5 for k in cells)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plans_of_raking_do_not_grow_with_its_margins(spark, monkeypatch):
    plans, write = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, tag: (plans.append(plan_of(df)), write(df, tag))[1])
    cells = spark.createDataFrame([(a, b, c, 1 + len(a + b + c)) for a in ("p", "qq") for b in ("r", "ss") for c in ("t", "uuu")], "source string, lang string, topic string, tokens long")
    mixing.rake(cells, {m: mixing.targets(cells, m) for m in mixing.MARGINS})
    assert max(p.count("Join") for p in plans) == 1


def test_pairs_meet_their_sets_once_a_side(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "src long, dst long")
    sets = spark.createDataFrame([(i, [10, 20, 30 + (i == 3) + 2 * (i == 5)], [1, 1, 1]) for i in range(1, 6)], "doc_id long, sh array<long>, n array<int>")
    got = neardup._verify(pairs, sets, 0.8)
    assert plan_of(got).count("Join") == 6
    assert {(r["src"], r["dst"]): r["same"] for r in got.collect()} == {(1, 2): True, (1, 3): False, (4, 5): False}


def test_values_without_target_keep_their_share(spark):
    cells = spark.createDataFrame([("a", "x", 50), ("b", "x", 20), ("c", "y", 30), ("d", "y", 0)], "s string, l string, tokens long")
    goals = {"s": spark.createDataFrame([("a", 0.2), ("b", 0.2), ("nowhere", 0.6)], "s string, target double")}
    got = {r["s"]: r["tokens"] * r["weight"] for r in mixing.rake(cells, goals)[0].collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 35, "b": 35, "c": 30, "d": 0}
    zero = {"s": spark.createDataFrame([("a", 0.0), ("b", 0.5), ("c", 0.5)], "s string, target double")}
    got = {r["s"]: r["tokens"] * r["weight"] for r in mixing.rake(cells, zero)[0].collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 0, "b": 25, "c": 25, "d": 0}


def test_targets_that_cannot_be_met_end_raking(spark):
    rows = [(i, prose(random.Random(i), 60), "en" if i % 2 else "de", "x" if i % 2 else "y") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goals = {"source": spark.createDataFrame([("x", 0.9), ("y", 0.1)], "source string, target double"), "lang": spark.createDataFrame([("en", 0.1), ("de", 0.9)], "lang string, target double")}
    assert mixing.mix(df, goals=goals).first()["residual"] > 1


def test_every_probability_may_be_one(spark):
    rows = [(i, prose(random.Random(i), 60), "en", "x") for i in range(20)]
    assert mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep=1.0).where("sampled").count() == 20


def tables(spark, where, docs, labels, schema):
    spark.createDataFrame(docs, schema).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def brute_run(docs, labels):
    """The five stages over (doc_id, text, lang, source) in plain Python: what reaches the last one."""
    model = BruteToxicity([(d, t) for d, t, *_ in docs], [(d, t) for d, _, t in labels])
    docs = [r for r in docs if model.score(r[1]) < 0.5]
    docs.sort(key=lambda r: (r[0] is None, r[0] or 0))
    with_id = [r for r in docs if r[0] is not None]
    low = brute_classes([r[1] or "" for r in with_id])
    docs = [r for i, r in enumerate(with_id) if low[i] == i] + [r for r in docs if r[0] is None]
    cut = []
    raw = [(r[1] or "").encode() for r in docs]
    for r, b, gone in zip(docs, raw, brute_removed(raw, 200), strict=True):
        cut.append((r[0], None if r[1] is None else bytes(c for c, x in zip(b, gone, strict=True) if not x).decode(errors="ignore"), *r[2:]))
    return [r for r, (_, stays) in zip(cut, brute_mix(cut), strict=True) if stays]


def test_run_equals_plain_stages(spark, tmp_path):
    rng = random.Random(23)
    toxic, labels = labelled(rng, 260, mean=14)
    passage = prose(rng, 60)
    docs = [(i, t, rng.choice(["en", "de"]), f"s{i % 3}") for i, t in toxic]
    docs += [(300 + i, prose(rng, 90) + passage + prose(rng, 40), "en", "hot") for i in range(12)]
    docs += [(400 + i, docs[-1][1], "en", "hot") for i in range(5)] + [(410, prose(rng, 90) + passage + prose(rng, 40) + " end", None, None)]
    docs += [(500, None, "en", None), (501, "", None, "s1"), (502, "", "en", "s1"), (None, "a text without an id " * 3, None, None), (503, "İstanbul é 😀 " * 30, "tr", "s2")]
    rows = [(*r, None if r[0] is None else 7, "x", r[0], "y") for r in docs]
    where = tables(spark, tmp_path, rows, [(d, 1, t) for d, t in labels], "doc_id long, text string, lang string, source string, n_chars long, key string, sequence_id long, row string")
    out = corpus_pipeline.run(spark, where).toPandas()
    want = brute_run(docs, [(d, 1, t) for d, t in labels])
    e = packing.WordIds(tokenizer_file("word_bpe_49k.json")).full
    ids = collections.Counter()
    for doc, text, *_ in want:
        ids[(doc, *e.encode(text or "", add_special_tokens=False).ids, 1)] += 1
    got = collections.Counter()
    for (doc, _), part in out.fillna({"doc_id": -1}).groupby(["doc_id", "doc_tokens"], dropna=False):
        part = part.sort_values("start")
        assert part.start.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() == part.doc_tokens.iloc[0]
        assert [zlib.crc32(np.array(x, "<u4")) for x in part.ids] == part.ids_crc32.tolist()
        got[(None if doc == -1 else int(doc), *(int(t) for x in part.ids for t in x))] += 1
    assert got == ids
    for _, window in out.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert window.offset.tolist() == [0, *window.length.cumsum().tolist()[:-1]] and window.length.sum() <= 2048


def test_run_over_empty_tables_and_without_n_chars(spark, tmp_path):
    where = tables(spark, tmp_path, [], [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, where).count() == 0
    docs = spark.createDataFrame([(1, "some text of a few words", "en", "a", 3)], "doc_id long, text string, lang string, source string, other int")
    assert corpus_pipeline.cut_repeats(spark, docs, where).first()["other"] == 3
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, where).columns == docs.columns


LONG = {"letters": "ab" * 60_000, "signs": "#" * 60_000, "foreign": "漢字" * 30_000, "line": "x y\n" * 30_000}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_unbroken_texts(spark, name):
    text = LONG[name]
    docs = frame(spark, [text, "short one", text])
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    counts = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs, tokenizer_file("piece_bpe_32k.model")).collect()}
    assert counts == {i: len(sp.encode(t)) for i, t in enumerate([text, "short one", text])}
    assert [r["class_id"] for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1, 0]
    left = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in suffixdedup.digest(docs).collect()}
    assert left == {0: 0, 1: 9, 2: 0}
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).count() == 3
    assert packing.pack(docs, tokenizer_file("word_bpe_49k.json")).where("length > 2048").count() == 0


def test_packing_does_not_depend_on_partitions(spark):
    docs = frame(spark, [prose(random.Random(i), 1 + i * 7 % 900) for i in range(400)])
    fill = []
    for parts in (1, 60):
        out = packing.pack(docs.repartition(parts), tokenizer_file("word_bpe_49k.json"), with_ids=True).toPandas()
        fill.append(out.length.sum() / (2048 * out.sequence_id.nunique()))
        assert all(zlib.crc32(np.array(i, "<u4")) == c for i, c in zip(out.ids, out.ids_crc32, strict=True))
    assert min(fill) > 0.97 and abs(fill[0] - fill[1]) < 0.01
