"""Toxic passages by maximum-scoring segments.

``fit`` learns a log-odds for each word from labelled documents, with a
Dirichlet prior at the word's overall rate and shrunk by its standard error;
other words have a small negative score. A linear-time scan (Ruzzo and Tompa)
finds all maximal scoring segments of a whole text. Their sums follow an
extreme-value law in clean texts, whose parameters are fitted, so a segment's
expected number by chance in a text of n words is known; segments where it is
small are the toxic passages, and a logistic curve over them gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, text_or_empty
from .flat import Known, blocks, per_text, prefix, runs, span_hash

#: The bounded sample: labelled rows that are learnt from.
FIT_ROWS = 30_000
#: Mass of the Dirichlet prior as a share of the sample; least toxic documents of a word of the model, and its least log-odds two standard errors down; score of any other word.
PRIOR, LEAST, LEAST_ODDS, DRIFT = 0.1, 3, math.log(3), -0.1
#: Highest score of a model that has not seen both classes: it predicts nothing.
UNSURE = 0.49
#: A passage is significant if fewer than so many are expected by chance.
EXPECTED = 0.05


def _letters() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = 1
    return t


LETTER = _letters()


@dataclass
class Model:
    """What ``fit`` learns; its words are those of a bounded sample that stand in enough of its toxic documents."""

    words: dict[str, float] = field(default_factory=dict)
    rate: float = 0.0
    scale: float = 1.0  # lambda and ln K of the extreme-value law
    log_k: float = 0.0
    weights: tuple[float, ...] = ()


class Scanner:
    """Scores of the words of a block by hash."""

    def __init__(self, words: dict[str, float]):
        self.known, self.value = Known(), np.array([*words.values(), 0.0])
        if words:
            raw = pa.array(list(words))
            for _, _, buf, off in blocks(raw, 1 << 40):
                self.known.add(span_hash(prefix(buf), off[:-1], off[1:]))

    def texts(self, lower: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each text: its row, its number of words, and places and scores of the model's words."""
        for i, j, buf, off in blocks(lower):
            start, end, _ = runs(LETTER[buf], off)
            row = self.known.find(span_hash(prefix(buf), start, end))
            at = np.flatnonzero(row >= 0)
            bounds = per_text(start, off)
            cut = np.searchsorted(at, bounds)
            for k in range(j - i):
                own = at[cut[k] : cut[k + 1]]
                yield i + k, int(bounds[k + 1] - bounds[k]), own - bounds[k], self.value[row[own]]


def segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (sum, first word, last word) in linear time; ``at`` are the words with a positive score, all others have ``drift``."""
    total, before = 0.0, -1
    found: list[tuple[float, float, int, int]] = []  # totals before and after, first and last word
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total += drift * (p - before - 1)
        low, first = total, p
        total += s
        before = p
        high = total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j -= 1
            if j < 0 or found[j][1] >= high:
                found.append((low, high, first, p))
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
    return [(b - a, i, j) for a, b, i, j in found]


def _features(model: Model, n: int, segs: list[tuple[float, int, int]]) -> tuple[list[float], list[tuple[float, int, int]]]:
    """Excess of the best segment over chance, and of all significant ones; the significant segments."""
    base = model.log_k + math.log(max(n, 1))
    excess = [model.scale * s - base for s, _, _ in segs]
    strong = [(x, i, j) for x, (_, i, j) in zip(excess, segs, strict=True) if x > -math.log(EXPECTED)]
    best = max(excess, default=-base if n else 0.0)
    return [1.0, max(-8.0, min(best, 40.0)), math.log1p(sum(x for x, _, _ in strong)), math.log1p(len(strong))], strong


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the constant is not shrunk."""
    w = np.zeros(x.shape[1])
    keep = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the words of a block: how many toxic and how many clean documents hold each."""
    for batch in batches:
        toxic = batch.column(1).to_numpy().astype(bool)
        for i, _, buf, off in blocks(pc.utf8_lower(batch.column(0))):
            start, end, _ = runs(LETTER[buf], off)
            doc = np.searchsorted(off, start, "right") - 1
            word, first, at = np.unique(span_hash(prefix(buf), start, end), return_index=True, return_inverse=True)
            own = np.unique(at * (doc.max(initial=0) + 1) + doc)  # a word of a document once
            at, own = np.divmod(own, doc.max(initial=0) + 1)
            bad = toxic[i + own]
            raw = buf.tobytes()
            names = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            n = [pa.array(np.bincount(at[which], minlength=len(word)).astype(float)) for which in (bad, ~bad)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *n], names=["word", "x", "y"])


def _words(train: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Words that stand in more toxic documents than their rate explains, with their shrunk log-odds."""
    each = map_arrow(train.select("text", "toxic"), _count_words, "word string, x double, y double")
    counts = each.groupBy("word").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where(F.col("x") >= LEAST)
    own = F.lit(PRIOR) * (F.col("x") + F.col("y"))  # pseudo-documents of each class, in number as the word is frequent in both together
    x, y = F.col("x") + own * F.lit(toxic / (toxic + clean)), F.col("y") + own * F.lit(clean / (toxic + clean))
    odds = F.log(x / F.lit(toxic * (1 + PRIOR))) - F.log(y / F.lit(clean * (1 + PRIOR)))
    error = F.sqrt(1 / x + 1 / y)
    kept = counts.select("word", odds.alias("odds"), error.alias("error")).where(F.col("odds") - 2 * F.col("error") > LEAST_ODDS)
    return {r["word"]: r["odds"] - r["error"] for r in sorted(kept.collect())}  # words of the bounded sample


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    At most ``rows`` of them are used, those with the least hash of the id, so
    what is collected and broadcast is bounded. Of these, three quarters give
    the words and a quarter the calibration. Without labelled texts of both
    classes the model is their rate alone, at most ``UNSURE``.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    chosen = labels.where("doc_id is not null and toxic is not null").where(crc % 5 != 0).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("label_id"), F.lit(5))
    chosen = chosen.orderBy(order, "label_id").limit(rows).withColumn("fold", F.pmod(F.xxhash64(F.col("label_id"), F.lit(7)), F.lit(4)))
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # bounded by rows
    own = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "toxic", "fold")
    own = materialize(own, "tox-sample")
    try:
        size = {(bool(r["first"]), r["toxic"]): r["n"] for r in own.groupBy((F.col("fold") == 0).alias("first"), "toxic").agg(F.count("*").alias("n")).collect()}
        toxic, clean = size.get((False, 1), 0), size.get((False, 0), 0)
        everything = sum(size.values())
        model = Model(rate=min(UNSURE, sum(n for (_, t), n in size.items() if t == 1) / everything) if everything else 0.0)
        if not toxic or not clean:
            return model
        model.words = _words(own.where("fold <> 0"), toxic, clean)
        got = map_arrow(own.where("fold = 0"), _best(model.words), "toxic int, n bigint, segs array<double>").collect()  # a quarter of the bounded sample
    finally:
        discard(own)
    segs = [[(s, 0, 0) for s in r["segs"]] for r in got]
    best = np.array([max((s for s, _, _ in x), default=0.0) for x in segs])
    n, y = np.array([r["n"] for r in got], float), np.array([r["toxic"] for r in got], float)
    model.scale, model.log_k = _extreme(best[y == 0], n[y == 0])
    if y.min(initial=1) == y.max(initial=0):
        return model
    x = np.array([_features(model, int(k), s)[0] for k, s in zip(n, segs, strict=True)])
    model.weights = tuple(_logistic(x, y).tolist())
    return model


def _extreme(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and ln K of P(best > x) = 1 - exp(-K n exp(-lambda x)), from the clean texts that have a segment at all.

    lambda is from the median excess over the least (some clean texts are
    mislabelled, so the mean would not do), K from how many words it takes for one.
    """
    over = best[best > 0]
    least = float(over.min()) if len(over) else 1.0
    scale = float(np.clip(math.log(2) / max(float(np.median(over)) - least, 1e-3), 0.3, 3.0)) if len(over) else 1.0
    return scale, math.log(max(len(over), 0.5) / max(float(n.sum()), 1.0)) + scale * least


def _best(words: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(words)
        for batch in batches:
            n, segs = [], []
            for _, size, at, score in scan.texts(pc.utf8_lower(batch.column(0))):
                n.append(size)
                segs.append([s for s, _, _ in segments(at, score)])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(segs, pa.list_(pa.float64()))], names=["toxic", "n", "segs"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score whole texts, of any length: doc_id, score, predicted, n_words, passages (first and last word, excess over chance) of every significant passage.

    A null or empty text has no passage and the score of such texts; a null
    doc_id stays null, repeated rows are scored each, an empty table gives no
    rows, other columns are not read.
    """
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("excess", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_words", pa.int64()), ("passages", kind)])
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model.words)
        for batch in batches:
            n, out, spans = [], [], []
            for _, size, at, value in scan.texts(pc.utf8_lower(batch.column(1))):
                x, strong = _features(model, size, segments(at, value))
                z = sum(a * b for a, b in zip(weights, x, strict=True)) if weights else None
                out.append(model.rate if z is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                n.append(size)
                spans.append([{"first_word": i, "last_word": j, "excess": e} for e, i, j in strong])
            p = np.array(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(n, pa.int64()), pa.array(spans, kind)], schema=schema)

    return map_arrow(
        docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")),
        run, "doc_id bigint, score double, predicted int, n_words bigint, passages array<struct<first_word: bigint, last_word: bigint, excess: double>>"
    )


def reject(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below ``at``. Nulls and repeated rows as in ``score``."""
    weights, where = model.weights, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model.words)
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for i, size, found, value in scan.texts(pc.utf8_lower(pc.fill_null(batch.column(where), ""))):
                x, _ = _features(model, size, segments(found, value))
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True)))))) if weights else model.rate
                keep[i] = p < at
            yield batch.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)
