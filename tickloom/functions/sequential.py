"""Sequential kernels of numpy and pandas only: workers import this module, so nothing here touches Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

ACTIONS = ("Buy", "Sell", "Hold")


@dataclass
class Regression:
    """Bayesian linear regression with rank-one updates and an exponential noise estimate."""

    dim: int
    ridge: float = 1.0
    half_life: float = 500.0
    n: int = 0
    noise: float = 1.0
    inverse: np.ndarray = field(init=False)
    b: np.ndarray = field(init=False)
    w: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.inverse, self.b, self.w = np.eye(self.dim) / self.ridge, np.zeros(self.dim), np.zeros(self.dim)

    def update(self, x: np.ndarray, y: float) -> bool:
        """Learn one observation; true if the weights more than doubled after the first five."""
        before, a = float(np.linalg.norm(self.w)), 1 - np.exp(-np.log(2) / self.half_life)
        self.noise = max((1 - a) * self.noise + a * (y - self.w @ x) ** 2, 1e-10)
        v = self.inverse @ x
        self.inverse -= np.outer(v, v) / (1 + x @ v)
        self.b += x * y
        self.w = self.inverse @ self.b
        self.n += 1
        return self.n > 5 and before > 1e-12 and float(np.linalg.norm(self.w)) / before > 2

    def variance(self, x: np.ndarray) -> float:
        return max(self.noise * float(x @ self.inverse @ x), 0.0)

    def sample(self, rng: np.random.Generator) -> np.ndarray:
        """Weights from the posterior: by the diagonal while there are fewer observations than features, else by Cholesky."""
        z, s = rng.standard_normal(self.dim), np.sqrt(self.noise)
        if self.n < self.dim:
            return self.w + s * np.sqrt(np.maximum(np.diag(self.inverse), 0)) * z
        try:
            return self.w + s * np.linalg.cholesky(self.inverse) @ z
        except np.linalg.LinAlgError:
            return self.w

    def inflate(self, by: float) -> None:
        self.inverse *= max(by, 1.0)


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


class Windowed:
    """Online change point by mean differences of a window's splits, with a grace period after each."""

    def __init__(self, most: int = 500, delta: float = 0.002, grace: int = 100):
        self.most, self.delta, self.grace, self.wait, self.x = most, delta, grace, 0, []

    def push(self, v: float) -> float:
        """The best split's ratio to its bound; above one it is a change."""
        self.x = [*self.x[-(self.most - 1) :], v]
        n = len(self.x)
        if self.wait or n < 100:
            self.wait = max(0, self.wait - 1)
            return 0.0
        c = np.cumsum(self.x)
        i = np.arange(1, n)
        ratio = np.abs(c[:-1] / i - (c[-1] - c[:-1]) / (n - i)) / np.sqrt(np.log(4 * (n - 1) / self.delta) / (2 * np.minimum(i, n - i)))
        if ratio.max() > 1:
            self.wait = self.grace
        return float(ratio.max())


#: What a quote brings to a run.
COLUMNS = ("spread", "spread_z", "obi", "delta_obi", "depth_change_rate", "rv", "volatility_ratio", "volatility_decay", "session", "open_ms", "bid_size", "dynamic_cost", "p_revert", "p_trend")
#: Longest holding of a strategy's position in nanoseconds, and the decay of its value per millisecond.
HOLD_NS, DECAYS = {"A": 30_000_000_000, "B": 300_000_000_000, "C": 600_000_000_000}, {"A": 0.001, "B": 0.0001, "C": 0.00005}
LOT, TYPICAL, MINUTE_NS, DAY_NS, HOUR_MS = 1.0, 1000.0, 60_000_000_000, 86_400_000_000_000, 3_600_000.0
DIM = 43


class Fills:
    """Own executions: exponential means, and those of the last minute."""

    def __init__(self) -> None:
        self.rate = self.slippage = self.reject = self.drift = 0.0
        self.first, self.recent = None, []

    def add(self, ts: int, filled: bool, slippage: float, drift: float, size: float) -> None:
        self.first = ts if self.first is None else self.first
        self.rate += 0.05 * (filled - self.rate)
        self.reject += 0.05 * ((not filled) - self.reject)
        self.slippage += 0.05 * (abs(slippage) - self.slippage)
        self.drift += 0.05 * (drift - self.drift)
        if filled:
            self.recent.append((ts, size))

    def seen(self, ts: int) -> tuple[float, float, float, float, float, float]:
        """Intensity and signed volume of the last minute; the means once half a second has passed since the first execution."""
        self.recent = [x for x in self.recent if x[0] >= ts - MINUTE_NS]
        late = self.first is not None and ts - self.first >= 500_000_000
        return (float(len(self.recent)), sum(v for _, v in self.recent), *((self.rate, self.slippage, self.reject, self.drift) if late else (0.0,) * 4))


class Policy:
    """Thompson sampling over Buy, Sell and Hold: penalties, consistency, position limit, lots, and a wider posterior when it trades too rarely."""

    def __init__(self, rng: np.random.Generator, k: float = 0.1, latency_k: float = 0.001, limit: float = 10.0, least_frequency: float = 0.02, inflation: float = 1.5, keep: float = 0.99):
        self.rng, self.k, self.latency_k, self.limit, self.least, self.most, self.keep = rng, k, latency_k, limit, least_frequency, inflation, keep
        self.models = {a: Regression(DIM) for a in ACTIONS}
        self.traded: list[bool] = []
        self.inflation, self.degenerate = 1.0, 0

    def decide(self, x: np.ndarray, impact: float, cost: float, rv: float, ratio: float, latency_ms: float, position: float, multiplier: float) -> str:
        stability = max(1 - min(ratio, 1.0), 0.0)
        k = self.k * (1 + 10 * rv) * (1 + 2 * (1 - stability) if stability < 0.5 else 1.0)
        penalty = impact + cost + k * np.sqrt(self.models["Buy"].noise) + self.latency_k * latency_ms
        q = {a: float(m.sample(self.rng) @ x) - (0.0 if a == "Hold" else penalty) for a, m in self.models.items()}
        buy, sell = q["Buy"], q["Sell"]
        known = min(self.models["Buy"].n, self.models["Sell"].n) >= 20
        if known and buy > 0 and sell > 0 and abs(buy - sell) / (max(abs(buy), abs(sell)) + 1e-15) < 0.05:
            out = "Hold"
        else:
            may = {"Buy": position + 1 <= self.limit, "Sell": position - 1 >= -self.limit, "Hold": True}
            out = max((a for a in ACTIONS if may[a]), key=lambda a: q[a])  # of equals the first: Buy, Sell, Hold
        if multiplier * LOT * 100_000 < 1000:
            out = "Hold"
        self.record(out != "Hold")
        return out

    def record(self, traded: bool) -> None:
        self.traded = [*self.traded[-499:], traded]
        if len(self.traded) >= 100 and sum(self.traded) / len(self.traded) < self.least:
            self.degenerate += 1
            if self.inflation < self.most:
                for m in self.models.values():
                    m.inflate(self.most / self.inflation)
                self.inflation = self.most
        elif self.inflation > 1:
            self.inflation = 1 + (self.inflation - 1) * self.keep
            self.inflation = 1.0 if self.inflation < 1.001 else self.inflation


class Run:
    """State of one simulated run of a strategy: policy, position, executions, limits, profit, random numbers."""

    def __init__(self, strategy: str, seed: int, mode: str = "learning", daily_loss: float = 1.0):
        self.strategy, self.mode, self.daily_loss = strategy, mode, daily_loss
        self.rng = np.random.default_rng([seed, ord(strategy)])
        self.policy, self.fills = Policy(self.rng), Fills()
        self.side, self.entry, self.since, self.x, self.action = 0.0, 0.0, 0, None, "Hold"
        self.good, self.bad = 2.0, 1.0  # of the provider's Beta posterior
        self.day, self.day_profit, self.halted, self.equity, self.top = -1, 0.0, False, 0.0, 0.0
        self.out = dict.fromkeys(("n_trades", "profit", "max_drawdown", "rejected", "held", "forced"), 0)
        self.peak = 0.0

    def features(self, ts: int, mid: float, c: np.ndarray) -> np.ndarray:
        """The 38 features in their order, as this run sees them, and the strategy's five; times in hours, so that no feature outweighs all others."""
        spread, z, obi, dobi, dcr, rv, vr, decay, session, open_ms, bid, cost, revert, trend = c
        size = self.side * TYPICAL
        held = (ts - self.since) // 1_000_000 if self.side else 0
        n, volume, *means = self.fills.seen(ts)
        impact = abs(size) / TYPICAL * rv
        go_on = min(1.0, max(0.0, 0.6 * min(1.0, max(0.0, 2 * (vr - 1))) + 0.4 * min(n / 20, 1.0)))
        queue = min(abs(size) / bid, 1.0) if bid > 0 else 0.0
        base = [spread, z, obi, dobi, dcr, queue, rv, vr, decay, *(float(session == i) for i in range(4)), open_ms / HOUR_MS, 24.0, held / HOUR_MS, self.side, float(np.sign(self.side)), self.entry - mid if self.side else 0.0, self.side * (mid - self.entry) if self.side else 0.0]
        base += [n, volume, *means, impact, float(np.exp(-0.01 * held)) if held > 0 else 1.0, cost, revert, go_on, trend, z * rv, obi * session, 0.0, abs(self.side) * rv, obi * rv, z * impact]
        fade = float(np.exp(-DECAYS[self.strategy] * held)) if held > 0 else 1.0
        if self.strategy == "A":
            own = 0.4 * min(abs(z) / 3, 1) + 0.35 * (min((-dcr - 0.2) / 0.8, 1) if dcr < -0.2 else 0) + 0.25 * (min((vr - 1) / 2, 1) if vr > 1 else 0)
            base += [z * obi, impact * (1 + min(abs(dcr), 2)), own, fade, dcr * rv]
        elif self.strategy == "B":
            own = 0.4 * (min(-decay, 1) if decay < 0 else 0) + 0.35 * min(abs(obi), 1) + 0.25 * min(n / 10, 1)
            base += [rv * obi, dobi * n, own, fade, vr * volume]
        else:
            own = 0.4 * min(abs(obi), 1) + 0.35 + 0.25 * (float(np.exp(-open_ms / HOUR_MS)) if open_ms > 0 else 1.0)
            base += [obi, dcr * queue, own, fade, obi * min(open_ms / 1e6, 60)]
        return np.nan_to_num(np.array(base, float))

    def execute(self, ts: int, mid: float, spread: float, rv: float, side: float, urgent: bool) -> float | None:
        """Fill price of a market order, or None: the provider may let it go by its last look; an urgent order is tried again until it fills."""
        while True:
            look = self.good / (self.good + self.bad) * (1 - 0.1 * min(rv, 1.0))
            u = self.rng.random()
            slip = rv * (1e-4 * LOT + 0.01 * np.sqrt(LOT) + 0.001) - (5e-5 * LOT * rv if side < 0 else 0.0)
            filled = u < min(1.0, max(0.0, 0.98 * look + 0.02))
            self.fills.add(ts, filled, slip, slip * side, side * LOT)
            if filled:
                self.good += 1
                return mid + side * (spread / 2 + slip)
            self.bad += 1
            if not urgent:
                return None

    def close(self, ts: int, mid: float, spread: float, rv: float, test: bool, forced: bool) -> None:
        price = self.execute(ts, mid, spread, rv, -np.sign(self.side), True)
        gain = self.side * (price - self.entry)
        self.equity += gain
        self.day_profit += gain
        reward = gain - 0.1 * self.side**2 * rv**2 - 0.5 * min(max(self.top - self.equity, 0.0), 100.0)
        self.top = max(self.top, self.equity)
        if self.mode != "frozen" or not test:
            self.policy.models[self.action].update(self.x, reward)
        if test:
            o = self.out
            o["n_trades"] += 1
            o["profit"] += gain
            o["forced"] += forced
            self.peak = max(self.peak, o["profit"])
            o["max_drawdown"] = max(o["max_drawdown"], self.peak - o["profit"])
        self.side = 0.0

    def step(self, ts: int, mid: float, trigger: bool, c: np.ndarray, test: bool) -> None:
        if self.mode == "cold" and not test:
            return
        if ts // DAY_NS != self.day:
            self.day, self.day_profit, self.halted = ts // DAY_NS, 0.0, False
        spread, rv = c[0], c[5]
        if self.side:
            over = self.day_profit + self.side * (mid - self.entry) < -self.daily_loss
            if over or ts - self.since >= HOLD_NS[self.strategy]:
                self.close(ts, mid, spread, rv, test, over)
                self.halted |= over
        if self.side or self.halted or not trigger:
            return
        x = self.features(ts, mid, c)
        multiplier = 0.25 if self.day_profit < -self.daily_loss / 2 else 1.0
        action = self.policy.decide(x, rv, c[11], rv, c[6], 0.5 + 2 * self.rng.random(), self.side, multiplier)
        if action == "Hold":
            self.out["held"] += test
            return
        side = 1.0 if action == "Buy" else -1.0
        price = self.execute(ts, mid, spread, rv, side, False)
        if price is None:
            self.out["rejected"] += test
            return
        self.side, self.entry, self.since, self.x, self.action = side, price, ts, x, action


def simulate_rows(runs: list[tuple[str, int, str]]):
    """Rows of a partition are sorted by symbol and time and pass once: the states of all runs (strategy, seed, mode) of a symbol live side by side. What is left open at the end is closed."""
    names = ("n_trades", "profit", "max_drawdown", "rejected", "held", "forced")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, live, last, out = None, [], None, []

        def done() -> None:
            for spec, run in live:
                if run.side:
                    run.close(*last, True)
                o = run.out
                out.append((key, *spec, o["n_trades"], round(o["profit"], 6), round(o["max_drawdown"], 6), o["rejected"], o["held"], o["forced"]))

        for f in frames:
            if not len(f):
                continue
            c = np.column_stack([np.nan_to_num(f[n].to_numpy(float)) for n in COLUMNS])
            fires = {s: f[f"trigger_{s.lower()}"].to_numpy(bool) for s in HOLD_NS}
            for i, (symbol, ts, mid, test) in enumerate(zip(f["symbol"], f["ts_ns"], f["mid"], f["test"], strict=True)):
                if symbol != key:
                    done()
                    key, live = symbol, [(r, Run(*r)) for r in runs]
                for (strategy, *_), run in live:
                    if run.side or fires[strategy][i]:
                        run.step(ts, mid, bool(fires[strategy][i]), c[i], test)
                last = ts, mid, c[i][0], c[i][5], test
        done()
        yield pd.DataFrame(out, columns=["symbol", "strategy", "seed", "mode", *names])

    return work


def project_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Average cost: add to a position at the weighted mean, close against it; a flip keeps the old entry."""
    state: dict[str, list[float]] = {}
    for f in frames:
        rows = []
        for s, seq, size, price in zip(f["strategy"], f["seq"], f["size"], f["price"], strict=True):
            pos, entry, real = state.get(s, [0.0, 0.0, 0.0])
            if pos == 0:
                pos, entry = size, price
            elif pos * size > 0:
                entry, pos = (entry * abs(pos) + price * abs(size)) / (abs(pos) + abs(size)), pos + size
            else:
                part = min(abs(size), abs(pos))
                real += part * (price - entry) * (1 if pos > 0 else -1)
                pos += size
                entry = 0.0 if pos == 0 else entry
            state[s] = [pos, entry, real]
            rows.append((s, seq, pos, entry, real))
        yield pd.DataFrame(rows, columns=["strategy", "seq", "position", "entry", "realized"])
