"""Formulas as named steps, usable as a chain of projections or inside a lambda."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = tuple[str, Callable[[dict[str, Column]], Column]]


def chain(df: DataFrame, steps: list[Step], inputs: dict[str, Column], outputs: dict[str, str], prefix: str = "_") -> DataFrame:
    """Adds the outputs {step: column name}. One projection for all steps that need no other of them: Catalyst keeps what is used again as a column,
    so nothing is computed twice and generated methods stay small, and there are few plans to analyse."""
    env = _Watched(inputs)
    level = dict.fromkeys(inputs, 0)
    kept = df.columns
    by_level: dict[int, list[Column]] = {}
    for name, make in steps:
        env.used.clear()
        made = make(env).alias(f"{prefix}{name}")
        level[name] = 1 + max((level[x] for x in env.used), default=0)
        by_level.setdefault(level[name], []).append(made)
        env[name] = F.col(f"{prefix}{name}")
    for _, made in sorted(by_level.items()):
        df = df.select("*", *made)
    return df.select(*kept, *(env[name].alias(out) for name, out in outputs.items()))


class _Watched(dict):
    """A dict that tells which of its keys were asked for."""

    def __init__(self, of: dict[str, Column]):
        super().__init__(of)
        self.used: set[str] = set()

    def __getitem__(self, key: str) -> Column:
        self.used.add(key)
        return super().__getitem__(key)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Binds a value within a lambda, where there is no reuse of subexpressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nested(steps: list[Step], env: dict[str, Column], result: str, use: Callable[[Column], Column]) -> Column:
    """The same formula as one expression of nested bindings; use() gets the result."""
    (name, make), *rest = steps
    if name == result:
        return let(make(env), use)
    return let(make(env), lambda v: nested(rest, env | {name: v}, result, use))
