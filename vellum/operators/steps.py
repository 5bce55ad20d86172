"""Pipelines of named steps: each takes a DataFrame to the next one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def run_steps(state: DataFrame, names: list[str], registry: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps in order, as one lazy plan; an unknown name is an error before anything runs."""
    if unknown := [n for n in names if n not in registry]:
        raise KeyError(f"unknown steps: {', '.join(unknown)}")
    for name in names:
        state = state.transform(registry[name])
    return state
