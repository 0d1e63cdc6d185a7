"""Settings of a run from TOML: defaults, partly overridden by a file, checked."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .operators.runtime import parse_strategies


@dataclass(frozen=True)
class Risk:
    """Limits as positive amounts; ``limits`` turns them into the negative profits that are compared."""

    max_position_lots: float = 10.0
    max_daily_loss_mtm: float = 500.0
    max_daily_loss_realized: float = 1000.0
    max_weekly_loss: float = 2500.0
    max_monthly_loss: float = 5000.0
    daily_mtm_lot_fraction: float = 0.25

    def limits(self) -> dict[str, float]:
        return {k: -getattr(self, k) for k in ("max_daily_loss_mtm", "max_daily_loss_realized", "max_weekly_loss", "max_monthly_loss")}


@dataclass(frozen=True)
class Alerts:
    risk_limit_threshold: float = 0.8
    execution_drift_threshold: float = 3.0
    sharpe_degradation_threshold: float = 0.5
    debounce_seconds: float = 3600.0


@dataclass(frozen=True)
class Strategy:
    """Bounds of entry rules and the longest time that a position is held."""

    spread_z: float = 2.0
    depth_drop: float = -0.1
    volatility_ratio: float = 2.0
    obi: float = 0.1
    max_kl: float = 1.0
    max_hold_ms: int = 30_000


@dataclass(frozen=True)
class Config:
    symbol: str = "USD/JPY"
    seed: int = 42
    strategies: tuple[str, ...] = ("A", "B", "C")
    risk: Risk = field(default_factory=Risk)
    alerts: Alerts = field(default_factory=Alerts)
    strategy_a: Strategy = field(default_factory=Strategy)
    strategy_b: Strategy = field(default_factory=lambda: Strategy(max_hold_ms=300_000))
    strategy_c: Strategy = field(default_factory=lambda: Strategy(obi=0.15, max_hold_ms=600_000))


def merge(default: Any, given: dict[str, Any], at: str = "") -> Any:
    """A dataclass with the values of a table put in; an unknown name or a value of another kind is an error."""
    known = {f.name for f in dataclasses.fields(default)}
    new = {}
    for name, value in given.items():
        where = f"{at}{name}"
        if name not in known:
            raise ValueError(f"unknown setting {where}")
        old = getattr(default, name)
        if dataclasses.is_dataclass(old):
            if not isinstance(value, dict):
                raise ValueError(f"{where} must be a table")
            new[name] = merge(old, value, f"{where}.")
        elif name == "strategies":
            new[name] = tuple(parse_strategies(",".join(value) if isinstance(value, list) else value))
        elif isinstance(old, float) and isinstance(value, int | float) and not isinstance(value, bool):
            new[name] = float(value)
        elif type(value) is type(old):
            new[name] = value
        else:
            raise ValueError(f"{where} must be {type(old).__name__}")
    return dataclasses.replace(default, **new)


def check(c: Config) -> Config:
    """Ranges of values; what is out of range is named."""
    rules = [("alerts.risk_limit_threshold must be in (0, 1]", 0 < c.alerts.risk_limit_threshold <= 1), ("risk.daily_mtm_lot_fraction must be in (0, 1]", 0 < c.risk.daily_mtm_lot_fraction <= 1)]
    rules += [(f"alerts.{k} must be positive", getattr(c.alerts, k) > 0) for k in ("execution_drift_threshold", "sharpe_degradation_threshold", "debounce_seconds")]
    rules += [(f"risk.{k} must be positive", getattr(c.risk, k) > 0) for k in ("max_position_lots", "max_daily_loss_mtm", "max_daily_loss_realized", "max_weekly_loss", "max_monthly_loss")]
    rules += [(f"{s}.max_hold_ms must be positive", getattr(c, s).max_hold_ms > 0) for s in ("strategy_a", "strategy_b", "strategy_c")]
    for what, fine in rules:
        if not fine:
            raise ValueError(what)
    return c


def parse(text: str) -> Config:
    return check(merge(Config(), tomllib.loads(text)))


def read(path: str) -> Config:
    return parse(Path(path).read_text())
