"""All queries of the engine's own operators."""

from __future__ import annotations

from rillstone.plans import exchange, fills, forecasts, places, scores

_ALL = {**fills.QUERIES, **scores.QUERIES, **places.QUERIES, **forecasts.QUERIES, **exchange.QUERIES}


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
