"""Frequencies, clocks and the tent weights that tie a slow series to a faster clock."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fastest first; the rank is the position from 1 on. Fixed values.
FREQUENCIES = ("d", "w", "m", "q", "sa", "a")
PERIODS_PER_YEAR = {"d": 365, "w": 52, "m": 12, "q": 4, "sa": 2, "a": 1}
DEFAULT_PERIODS = 12
#: Calendar rows between two observations of a series on a monthly clock.
ROW_STEP = {"m": 1, "q": 3, "sa": 6, "a": 12}
#: Longest tent that a pair without an entry may fall back to, and the tents of pairs. Fixed values.
MAX_TENT = 12
TENTS = {
    ("q", "m"): (1, 2, 3, 2, 1),
    ("sa", "m"): (1, 2, 3, 4, 3, 2, 1),
    ("a", "m"): (1, 2, 3, 4, 5, 4, 3, 2, 1),
    ("m", "w"): (1, 2, 3, 2, 1),
    ("q", "w"): (1, 2, 3, 4, 5, 4, 3, 2, 1),
    ("sa", "q"): (1, 2, 1),
    ("a", "q"): (1, 2, 3, 2, 1),
    ("a", "sa"): (1, 2, 1),
}


def rank(frequency: str) -> int:
    return FREQUENCIES.index(frequency) + 1


def is_slower(frequency: str, clock: str) -> bool:
    return rank(frequency) > rank(clock)


def higher(frequency: str) -> str | None:
    """The next faster frequency; the fastest has none."""
    k = FREQUENCIES.index(frequency)
    return FREQUENCIES[k - 1] if k else None


def periods_per_year(frequency: str) -> int:
    return PERIODS_PER_YEAR.get(frequency, DEFAULT_PERIODS)


def annual_factor(frequency: str, step: int | None = None) -> float:
    step = ROW_STEP.get(frequency, 1) if step is None else step
    return periods_per_year(frequency) / step if step > 0 else 1.0


#: The dates that a clock's periods are written at: fixed values.
CLOCK_ALIAS = {"d": "D", "w": "W", "m": "ME", "q": "QE", "sa": "ME", "a": "YE"}


def horizon(clock: str, periods: int | None = None) -> tuple[int, str]:
    """Steps of a forecast (one period by default) and the alias they are counted in: half-years count months."""
    n = 1 if periods is None else periods
    return n * 6 if clock == "sa" and n > 0 else n, CLOCK_ALIAS[clock]


def tent(n: int, shape: str = "symmetric") -> list[int]:
    """Integer weights of length ``n``: a symmetric tent, all ones, or decay from the centre.

    The last kind is scaled to a mean of one and cut to whole numbers.
    """
    if n < 1:
        raise ValueError("a tent has at least one weight")
    if shape == "symmetric":
        return [min(k, n - 1 - k) + 1 for k in range(n)]
    if shape == "linear":
        return [1] * n
    if shape == "exponential":
        decay = np.exp(-4 * np.abs(np.arange(n) - n / 2) / n)
        return [int(x) for x in decay * n / decay.sum()]
    raise ValueError(f"unknown shape {shape!r}")


def tent_for(slow: str, clock: str) -> tuple[int, ...]:
    """Weights of a slow series on a clock; pairs without an entry get rank gap + 1 of them."""
    if (found := TENTS.get((slow, clock))) is not None:
        return found
    gap = rank(slow) - rank(clock) + 1
    if not 0 < gap <= MAX_TENT:
        raise ValueError(f"{slow} is faster than the clock {clock}")
    return tuple(tent(gap))


def constraint_matrix(weights: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows w_1 c_1 - w_(i+1) c_(i+1) = 0, and their right-hand side."""
    w = np.asarray(weights, float)
    return np.hstack([np.full((len(w) - 1, 1), w[0]), -np.diag(w[1:])]), np.zeros(len(w) - 1)


def aggregation(frequencies: list[str], clock: str) -> dict[str, tuple[int, ...]]:
    """Tent of each frequency that is slower than the clock; a faster one is an error."""
    out = {}
    for f in sorted(set(frequencies), key=rank):
        if rank(f) < rank(clock):
            raise ValueError(f"frequency {f} is faster than the clock {clock}")
        if is_slower(f, clock):
            out[f] = tent_for(f, clock)
    return out


def chain_length(frequency: str, clock: str, idio: bool = True, idio_slow: bool = True) -> int:
    """Idiosyncratic states of a series: 1 at the clock, a tent's length below it, 0 if off."""
    if not is_slower(frequency, clock):
        return int(idio)
    return len(tent_for(frequency, clock)) if idio and idio_slow else 0


def case_of(column: str | Column, values: dict[str, object], otherwise: object = None) -> Column:
    """A CASE over a string column from a small mapping."""
    column = F.col(column) if isinstance(column, str) else column
    branches = reduce(lambda c, kv: (c.when if c is not None else F.when)(column == kv[0], F.lit(kv[1])), values.items(), None)
    return branches.otherwise(F.lit(otherwise))


def rank_column(frequency: str | Column) -> Column:
    return case_of(frequency, {f: rank(f) for f in FREQUENCIES})


def periods_column(frequency: str | Column) -> Column:
    return case_of(frequency, PERIODS_PER_YEAR, DEFAULT_PERIODS)


def step_column(frequency: str | Column) -> Column:
    return case_of(frequency, ROW_STEP, 1)


def higher_column(frequency: str | Column) -> Column:
    return case_of(frequency, {f: higher(f) for f in FREQUENCIES[1:]})


def horizon_column(clock: str | Column, periods: Column) -> Column:
    """Steps of a forecast of so many periods, in the clock's alias."""
    clock = F.col(clock) if isinstance(clock, str) else clock
    return F.when((clock == "sa") & (periods > 0), periods * 6).otherwise(periods)


def alias_column(clock: str | Column) -> Column:
    return case_of(clock, CLOCK_ALIAS)


def tent_column(n: Column, shape: str = "symmetric") -> Column:
    """``tent`` as an array, its length a column."""
    places = F.sequence(F.lit(0), n - 1)
    if shape == "symmetric":
        return F.transform(places, lambda k: F.least(k, n - 1 - k) + 1)
    if shape == "linear":
        return F.transform(places, lambda k: F.lit(1))
    if shape == "exponential":
        decay = F.transform(places, lambda k: F.exp(F.lit(-4.0) * F.abs(k - n / 2) / n))
        total = F.aggregate(decay, F.lit(0.0), lambda x, y: x + y)
        return F.transform(decay, lambda x: F.floor(x * n / total).cast("int"))
    raise ValueError(f"unknown shape {shape!r}")


def tent_of_pair(slow: str | Column, clock: str | Column) -> Column:
    """The weights of a slow series on a clock: those of the pair, else a tent of rank gap + 1; null where it is not slower."""
    slow, clock = (F.col(x) if isinstance(x, str) else x for x in (slow, clock))
    gap = rank_column(slow) - rank_column(clock)
    pairs = F.map_from_arrays(F.array(*[F.lit(f"{s} {c}") for s, c in TENTS]), F.array(*[F.array(*[F.lit(w) for w in x]) for x in TENTS.values()]))
    return F.when(gap > 0, F.coalesce(F.try_element_at(pairs, F.concat_ws(" ", slow, clock)), tent_column(F.greatest(gap, F.lit(0)) + 1)))


def constraint_column(weights: Column) -> Column:
    """``constraint_matrix`` of an array of weights, as rows of an array."""
    n = F.size(weights)

    def row(i: Column) -> Column:
        entry = lambda j: F.when(j == 0, F.get(weights, F.lit(0))).when(j == i + 1, -F.get(weights, j)).otherwise(F.lit(0)).cast("double")
        return F.transform(F.sequence(F.lit(0), n - 1), entry)

    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), row)).otherwise(F.array().cast("array<array<double>>"))
