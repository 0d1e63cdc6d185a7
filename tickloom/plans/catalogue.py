"""All registered queries of the library."""

from __future__ import annotations

from . import registry


def load() -> None:
    from ..sources import quotes, results, store  # noqa: F401
    from ..streaming import feed, live, reader  # noqa: F401
    from ..operators import adaptive, drift, execution, features, learning, positions, regression, risk, runtime, safemode, stateful, stats, sticky, validation, vector  # noqa: F401


def queries() -> dict[str, registry.Query]:
    load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(registry.ORACLES)
