"""Safe mode against a plain pass over the requests."""

from __future__ import annotations

import random

from tickloom.operators.safemode import safe_mode

COLUMNS = "seq bigint, ts_ns bigint, lp_id string, filled boolean, slippage double, predicted double, to_lp string, base_fill double"


def plain(rows, least, longest, slippage_error, fill_error):
    target, out = None, []
    for seq, ts, lp, filled, slip, pred, to, base in rows:
        if to is not None:
            target, fill, safe, n, hits, s, p, start = to, base, True, 0, 0, 0.0, 0.0, None
        elif target is not None and lp == target and safe:
            start = ts if start is None else start
            n += 1
            if filled:
                hits, s, p = hits + 1, s + slip, p + pred
            close = hits > 0 and round(abs(s - p) / hits / max(abs(s / hits), abs(p / hits), 1e-10), 6) < slippage_error and round(abs(hits / n - fill), 9) < fill_error
            safe = not (n >= least and (ts - start >= longest or close))
        on = target is not None and safe
        out.append((seq, on, 0.25 if on else 1.0, 2.0 if on else 1.0, round(min(n / least, 1.0), 9) if on else 1.0))
    return out


def test_states_equal_a_plain_pass(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        to = rng.choice(["P", "Q"]) if rng.random() < 0.01 else None
        slip = rng.uniform(0.1, 0.3)
        rows.append((i * 3, i * 1000, rng.choice(["P", "Q"]), rng.random() < 0.8, slip, slip * rng.uniform(0.7, 1.4), to, 0.8 if to else None))
    settings = (10, 40_000, 0.05, 0.1)
    got = safe_mode(spark.createDataFrame(rows, COLUMNS).repartition(7), *settings).collect()
    want = plain(rows, *settings)
    assert sorted((r["seq"], r["safe"], r["lot_factor"], r["sigma_factor"], round(r["progress"], 9)) for r in got) == want
    assert 100 < sum(w[1] for w in want) < 2900


def test_no_switch_and_no_rows(spark):
    rows = [(i, i, "P", i % 2 == 0, 0.1, 0.1, None, None) for i in range(5)]
    assert [r["safe"] for r in safe_mode(spark.createDataFrame(rows, COLUMNS)).collect()] == [False] * 5
    assert safe_mode(spark.createDataFrame([], COLUMNS)).count() == 0
