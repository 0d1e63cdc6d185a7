"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked in turn to
target shares of each margin until they agree; a document's weight is its
cell's factor, and a calibrated probability (so that the expected number of
sampled tokens meets the wanted share of the corpus, probabilities being at
most one) decides by a hash of its id. Only DataFrame functions are used. The
cell table has a row for each combination that occurs, not for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty

#: Largest relative error of a margin at which raking ends; a power below 1 moves a margin's own shares toward equal ones; share of all tokens to keep.
TOLERANCE, FLATTEN, KEEP = 1e-9, 0.7, 0.5
#: Rounds of plain raking, which are enough for most tables, before steps are extrapolated; all rounds (see ``rake``); steps back from an extrapolation that goes too far.
PLAIN, ROUNDS, HALVINGS = 20, 300, 30
MARGINS = ("source", "lang", "topic")
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A coarse topic of form, from the text alone: empty, notes (under 50 words), listing (many short lines), marked (over a tenth of the characters are signs), prose."""
    n = F.length(text)
    words = F.size(F.split(text, " "))
    lines = n - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    signs = n - F.length(F.translate(text, "#$%&*+/<=>@[]^_{|}~", ""))
    return (
        F.when(n == 0, "empty")
        .when(words < 50, "notes")
        .when(signs * 10 > n, "marked")
        .when(lines * 12 > words, "listing")
        .otherwise("prose")
    )


def targets(cells: DataFrame, margin: str, flatten: float = FLATTEN) -> DataFrame:
    """Target shares of a margin: its own token shares to the power ``flatten``, scaled to one. (margin, target)"""
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").withColumn("p", F.pow("t", F.lit(flatten)))
    total = own.agg(F.sum("p")).first()[0] or 1.0
    return own.select(margin, (F.col("p") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """Fit ``weight`` of the cells so that the shares of tokens * weight by each margin meet its target, margins in turn; also the largest relative error that the last round found.

    A margin value without target keeps its share of tokens, and the targets
    share what is left in proportion; a target without tokens is left out; a
    target of zero gives weight zero. Rounds end when that error is within
    ``tolerance`` or it is proved that no weights meet all targets. The proof:
    were there such weights, the mean over their tokens of what a round adds to
    a cell's log weight would be the sum over margins of target times log
    factor; so that sum can't exceed the most that is added to any cell. Targets
    that only weights with a zero among them meet are approached but not
    reached; then raking ends after ``rounds``, and the error says how near it
    came (under 1e-4 in the tests).

    Raking alone can take very many rounds. Where the first ``PLAIN`` ones are
    not enough, rounds come in pairs, after which log weights are carried on
    along the change that the pair shows (a squared extrapolation). The step is halved until the dual objective of
    raking, which rounds only lower, is no higher than without it. Sums of
    margin factors stay such sums, so the limit is that of plain raking.
    """
    now = materialize(cells.withColumn("live", F.col("tokens") > 0), "rake")
    for margin, goal in goals.items():  # each is written, as the next one's plan reads it twice
        own = materialize(now.where("live").groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).join(goal, margin, "left"), "rake")
        total, free, aims = own.agg(F.sum("t"), F.sum(F.when(F.col("target").isNull(), F.col("t"))), F.sum("target")).first()
        free, aims = float(free or 0) / float(total or 1), float(aims or 0)
        aim = F.when(F.col("target").isNull(), F.col("t") / F.lit(float(total or 1))).otherwise(F.col("target") * F.lit((1 - free) / aims if aims else 0.0))
        old, now = now, materialize(now.join(own.select(margin, aim.alias(f"target_{margin}")), margin, "left").withColumn("live", F.col("live") & (F.coalesce(f"target_{margin}", F.lit(0.0)) > 0)), "rake")
        for x in (own, old):
            discard(x)
    every = float(now.where("live").agg(F.sum("tokens")).first()[0] or 0)  # each step brings the weighted total to it
    path, now = now._tickloom_path, now.withColumn("log", F.lit(0.0))
    now._tickloom_path = path
    mass = F.when(F.col("live"), F.col("tokens") * F.exp("log")).otherwise(0.0)

    def sweep(at: DataFrame) -> tuple[DataFrame, float, float, bool]:
        """One round; its largest error, its sum of targets times log factors, and whether that proves that targets can't be met."""
        step = at.withColumns({"was": F.col("log"), "off": F.lit(0.0), "gain": F.lit(0.0)})
        for margin in goals:
            share = step.groupBy(margin).agg(F.sum(mass).alias("have"), F.first(f"target_{margin}").alias("target"))
            share = share.select(margin, F.when((F.col("have") > 0) & (F.col("target") > 0), F.col("target") * F.lit(every) / F.col("have")).alias("factor"))
            after = F.col("log") + F.coalesce(F.log("factor"), F.lit(0.0))
            own = F.when(F.col("live"), F.col("tokens") * F.exp(after) * F.coalesce(F.log("factor"), F.lit(0.0))).otherwise(0.0)
            step = step.join(share, margin).withColumns({"gain": F.col("gain") + own, "off": F.when(F.col("live"), F.greatest("off", F.abs(1 - 1 / F.col("factor")))).otherwise(0.0), "log": after})
            step = materialize(step.drop("factor"), "rake")
            used.append(step)
        s = step.where("live").agg(F.max("off").alias("off"), F.sum("gain").alias("gain"), F.max(F.col("log") - F.col("was")).alias("top")).first()
        gain = (s["gain"] or 0.0) / (every or 1.0)
        return step, s["off"] or 0.0, gain, gain > (s["top"] or 0.0) + 1e-13

    keep = list(now.columns)
    lift, done = 0.0, 0  # the sum of targets times log factors so far; rounds
    while True:
        used: list[DataFrame] = [now]
        one, error, first, stuck = sweep(now)
        done += 1
        ended = error <= tolerance or stuck or done >= rounds
        if ended or done < PLAIN:
            for old in used[:-1]:
                discard(old)
            if ended:
                weight = F.when(F.col("live") | (F.col("tokens") == 0), F.exp("log")).otherwise(0.0)
                return one.select(*cells.columns, weight.alias("weight")), error
            now, lift = one.drop("was", "off", "gain"), lift + first
            now._tickloom_path = one._tickloom_path
            continue
        two, _, second, _ = sweep(one.select(keep))
        done += 1
        path = two.select(*keep, "was").join(one.select(*goals, F.col("was").alias("start")), list(goals))
        r, v = F.col("was") - F.col("start"), F.col("log") - 2 * F.col("was") + F.col("start")
        norm = path.where("live").agg(F.sum(r * r).alias("r"), F.sum(v * v).alias("v")).first()
        far = -((norm["r"] / norm["v"]) ** 0.5) if norm["v"] else -1.0
        plain = every * (1 - lift - first - second)
        now, lift = two.select(keep), lift + first + second
        for _ in range(HALVINGS):
            if far > -1.0001:
                break
            to = F.col("start") - 2 * far * r + far * far * v
            rise = -2 * far * first + far * far * (second - first)
            there = path.where("live").agg(F.sum(F.col("tokens") * F.exp(to))).first()[0]
            if there - every * (lift - first - second + rise) <= plain:
                now, lift = path.withColumn("log", to).select(keep), lift - first - second + rise
                break
            far = (far - 1) / 2
        now = materialize(now, "rake")
        for old in used:
            discard(old)


def mix(docs: DataFrame, keep: float = KEEP, goals: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE, seed: str = "mix") -> DataFrame:
    """Weights, probabilities and the sample for documents (doc_id, text, lang, source).

    Returns doc_id, source, lang, topic, n_tokens (words between spaces), weight
    (mean 1 over tokens), probability, sampled, residual (the largest relative
    error of a margin that raking has left, the same in all rows). Null source or lang is the
    value "(none)", a null text is empty (no tokens, probability 0). A null
    doc_id is hashed as the empty text; repeated rows share their fate. An
    empty table gives no rows; other columns are not read.
    """
    return _drawn(docs, keep, goals, tolerance, seed).select("row.doc_id", *MARGINS, "n_tokens", "weight", "probability", "sampled", "residual")


def sample(docs: DataFrame, keep: float = KEEP, goals: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE, seed: str = "mix") -> DataFrame:
    """The sampled documents, all columns; nulls and repeated rows as in ``mix``."""
    return _drawn(docs, keep, goals, tolerance, seed).where("sampled").select("row.*")


def _drawn(docs: DataFrame, keep: float, goals: dict[str, DataFrame] | None, tolerance: float, seed: str) -> DataFrame:
    text = text_or_empty()
    base = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        topic_of(text).alias("topic"),
        F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("n_tokens"),
    )
    cells = materialize(base.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    goals = goals or {m: materialize(targets(cells, m), "goal") for m in MARGINS}
    fitted, error = rake(cells, goals, tolerance)
    ranked = materialize(calibrate(fitted, keep), "cells").drop("tokens")  # where small enough, Spark broadcasts it by its own check
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    p = F.when(F.col("n_tokens") > 0, F.col("p")).otherwise(0.0)
    return base.join(ranked, list(MARGINS)).select("row", *MARGINS, "n_tokens", "weight", p.alias("probability"), ((F.col("n_tokens") > 0) & (u < F.col("p"))).alias("sampled"), F.lit(float(error)).alias("residual"))


def calibrate(fitted: DataFrame, keep: float) -> DataFrame:
    """Cells with ``weight`` (mean 1 over tokens) and ``p`` = min(1, rate * weight), so that the tokens kept are a share ``keep`` of all.

    Cells whose probability would exceed one are kept as a whole and the rate
    of the others grows by what that leaves; each pass is one aggregate, and
    the rate only rises, until no further cell is full.
    """
    every = fitted.agg(F.sum("tokens").cast("double").alias("n"), F.sum(F.col("tokens") * F.col("weight")).alias("w")).first()
    scale = every["n"] / every["w"] if every["w"] else 1.0
    cells = fitted.withColumn("weight", F.col("weight") * F.lit(scale))
    wanted, rate, full = keep * float(every["n"] or 0.0), 0.0, -1
    while True:
        is_full = F.lit(rate) * F.col("weight") >= 1
        s = cells.where("tokens > 0").agg(F.count_if(is_full).alias("k"), F.sum(F.when(is_full, F.col("tokens"))).alias("sure"), F.sum(F.when(~is_full, F.col("tokens") * F.col("weight"))).alias("open")).first()
        if s["k"] == full or not s["open"]:
            break
        full, rate = s["k"], (wanted - float(s["sure"] or 0)) / s["open"]
    return cells.select(*MARGINS, "tokens", "weight", F.least(F.lit(1.0), F.lit(rate) * F.col("weight")).alias("p"))
