"""Model configuration: series, blocks and estimation settings, from mappings, YAML or spec tables.

Every source yields a plain mapping; sources merge as mappings, and one constructor reads and
checks the result. The configuration is small and lives on the driver; ``series_table`` and
``block_table`` turn it into tables for joins.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any, Protocol

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frequency import FREQUENCIES, rank
from ..functions.transforms import CODES
from ..operators.models import ModelSpec
from ..plans.kernel import Layout, Options

GLOBAL = "Block_Global"


@dataclass(frozen=True)
class SeriesSpec:
    series_id: str
    frequency: str = "m"
    transformation: str = "lin"
    blocks: tuple[str, ...] = (GLOBAL,)
    series_name: str = ""
    units: str | None = None
    release_day: int | None = None


@dataclass(frozen=True)
class BlockSpec:
    factors: int = 1
    #: Null: the lags of the settings.
    ar_lag: int | None = None
    clock: str = "m"
    notes: str | None = None


@dataclass(frozen=True)
class Settings:
    """Estimation settings; names are those of configuration files."""

    ar_lag: int = 1
    threshold: float = 1e-5
    max_iter: int = 5000
    nan_method: int = 2
    nan_k: int = 3
    clock: str = "m"
    clip_ar_coefficients: bool = True
    ar_clip_min: float = -0.99
    ar_clip_max: float = 0.99
    warn_on_ar_clip: bool = True
    clip_data_values: bool = True
    data_clip_threshold: float = 100.0
    warn_on_data_clip: bool = True
    use_regularization: bool = True
    regularization_scale: float = 1e-5
    min_eigenvalue: float = 1e-8
    max_eigenvalue: float = 1e6
    warn_on_regularization: bool = True
    use_damped_updates: bool = True
    damping_factor: float = 0.8
    warn_on_damped_update: bool = True
    augment_idio: bool = True
    augment_idio_slow: bool = True
    idio_rho0: float = 0.1
    idio_min_var: float = 1e-8


def _series_list(raw: Any) -> list[dict[str, Any]]:
    """Series as a list of mappings, or as a mapping by id."""
    if isinstance(raw, Mapping):
        return [{"series_id": k, **(v or {})} for k, v in raw.items()]
    return [asdict(x) if isinstance(x, SeriesSpec) else dict(x) for x in raw or []]


def _block_names(series: list[dict], given: Mapping | None, listed: list[str] | None) -> list[str]:
    names = list(given or listed or [])
    if not names:
        names = sorted({b for s in series for b in s.get("blocks") or [] if isinstance(b, str)}) or [GLOBAL]
    if GLOBAL in names:  # the global block leads
        names.insert(0, names.pop(names.index(GLOBAL)))
    return names


@dataclass(frozen=True)
class ModelConfig:
    series: tuple[SeriesSpec, ...]
    blocks: dict[str, BlockSpec]
    settings: Settings = field(default_factory=Settings)

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any], check: bool = True) -> ModelConfig:
        """Series as a list or by id; blocks by name, or found in the series; 0/1 block lists are read in block order."""
        series = _series_list(raw.get("series"))
        given = raw.get("blocks") if isinstance(raw.get("blocks"), Mapping) else None
        names = _block_names(series, given, raw.get("block_names"))
        known, clock = {f.name for f in fields(BlockSpec)}, raw.get("clock", "m")
        blocks = {}
        for n in names:
            b = (given or {}).get(n) or {}
            b = asdict(b) if isinstance(b, BlockSpec) else {"factors": b} if isinstance(b, int) else b
            blocks[n] = BlockSpec(**{"clock": clock} | {k: v for k, v in b.items() if k in known})
        out = []
        for k, s in enumerate(series):
            own = s.get("blocks") or [names[0]]
            if isinstance(own, str):
                own = [x.strip() for x in own.split(",")]
            if own and not isinstance(own[0], str):
                own = [n for n, x in zip(names, own, strict=False) if x]
            if names[0] not in own and not check:
                own = list(own)
            elif isinstance(raw.get("series"), Mapping) and names[0] not in own:
                own = [names[0], *own]
            day = next((s[x] for x in ("release_day", "release_date", "release", "Release") if s.get(x) is not None), None)
            code = str(s.get("transformation", "lin")).lower()
            out.append(
                SeriesSpec(
                    s.get("series_id") or f"series_{k}",
                    s.get("frequency", "m"),
                    code if code in CODES else "lin",
                    tuple(own),
                    s.get("series_name") or s.get("series_id") or f"series_{k}",
                    s.get("units"),
                    int(day) if day is not None else None,
                )
            )
        settings = Settings(**{f.name: type(f.default)(raw[f.name]) for f in fields(Settings) if raw.get(f.name) is not None})
        config = cls(tuple(out), blocks, settings)
        if check and (errors := config.report()["errors"]):
            raise ValueError("; ".join(errors))
        return config

    def report(self) -> dict[str, Any]:
        """What is wrong with the configuration, without raising."""
        errors: list[str] = []
        advice: list[str] = []

        def wrong(message: str, hint: str) -> None:
            errors.append(message)
            advice.append(hint)

        if not self.series:
            wrong("no series", "add at least one series")
        if not self.blocks:
            wrong("no blocks", "add at least one block")
        lead = next(iter(self.blocks), None)
        for name, b in self.blocks.items():
            if b.clock not in FREQUENCIES:
                wrong(f"block {name}: unknown clock {b.clock}", f"use one of {', '.join(FREQUENCIES)}")
            elif rank(b.clock) < rank(self.settings.clock):
                wrong(f"block {name}: clock {b.clock} is faster than the global clock {self.settings.clock}", "slow the block's clock down")
            if b.factors < 1:
                wrong(f"block {name}: {b.factors} factors", "give each block at least one factor")
        seen: set[str] = set()
        for s in self.series:
            if s.series_id in seen:
                wrong(f"series {s.series_id}: listed twice", "give each series its own id")
            seen.add(s.series_id)
            if s.frequency not in FREQUENCIES:
                wrong(f"series {s.series_id}: unknown frequency {s.frequency}", f"use one of {', '.join(FREQUENCIES)}")
                continue
            if lead is not None and lead not in s.blocks:
                wrong(f"series {s.series_id}: does not load on {lead}", f"add {lead} to its blocks")
            for b in s.blocks:
                if b not in self.blocks:
                    wrong(f"series {s.series_id}: unknown block {b}", "define the block or drop it")
                elif self.blocks[b].clock in FREQUENCIES and rank(s.frequency) < rank(self.blocks[b].clock):
                    wrong(f"series {s.series_id}: frequency {s.frequency} is faster than the clock of {b}", "slow the series down or speed the block up")
        warnings = [f"series {s.series_id}: release day {s.release_day} is no day" for s in self.series if s.release_day == 0 or abs(s.release_day or 1) > 31]
        return {"valid": not errors, "errors": errors, "warnings": warnings, "suggestions": advice}

    def to_mapping(self) -> dict[str, Any]:
        series = {s.series_id: {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(s).items() if k != "series_id" and v is not None} for s in self.series}
        return {**asdict(self.settings), "series": series, "blocks": {n: {k: v for k, v in asdict(b).items() if v is not None} for n, b in self.blocks.items()}}

    def series_table(self, spark: SparkSession) -> DataFrame:
        rows = [(s.series_id, s.series_name, s.frequency, s.transformation, list(s.blocks), s.units, s.release_day, k) for k, s in enumerate(self.series)]
        return spark.createDataFrame(
            rows, "series_id string, series_name string, frequency string, transformation string, blocks array<string>, units string, release_day int, ord int"
        )

    def block_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, b.factors, b.ar_lag, b.clock, k) for k, (n, b) in enumerate(self.blocks.items())]
        return spark.createDataFrame(rows, "block string, factors int, ar_lag int, clock string, ord int")

    def options(self, settings: Settings | None = None) -> Options:
        """The guards of the estimation that the settings ask for."""
        s = settings or self.settings
        return Options(
            s.nan_method,
            s.nan_k,
            (s.ar_clip_min, s.ar_clip_max) if s.clip_ar_coefficients else None,
            s.regularization_scale if s.use_regularization else None,
            s.min_eigenvalue,
            s.max_eigenvalue,
            s.damping_factor if s.use_damped_updates else None,
            s.idio_rho0,
            s.idio_min_var,
        )

    def model(self, series: list[str] | None = None, max_iter: int | None = None, threshold: float | None = None, **overrides: Any) -> ModelSpec:
        """The worker's view of the configuration, for the given series in order.

        An override goes before the configuration, and that before the defaults.
        """
        named = {"max_iter": max_iter, "threshold": threshold, **overrides}
        if unknown := set(named) - {f.name for f in fields(Settings)}:
            raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
        s = replace(self.settings, **{k: v for k, v in named.items() if v is not None})
        chosen = [x for x in self.series if series is None or x.series_id in series]
        names = list(self.blocks)
        lags = tuple(s.ar_lag if b.ar_lag is None else b.ar_lag for b in self.blocks.values())
        layout = Layout(
            tuple(x.frequency for x in chosen),
            tuple(tuple(int(n in x.blocks) for n in names) for x in chosen),
            tuple(b.factors for b in self.blocks.values()),
            s.ar_lag,
            s.clock,
            s.augment_idio,
            s.augment_idio_slow,
            lags if any(n != s.ar_lag for n in lags) else (),
        )
        clip = s.data_clip_threshold if s.clip_data_values else None
        return ModelSpec(tuple(x.series_id for x in chosen), layout, tuple(names), s.max_iter, s.threshold, clip, self.options(s))

    def warnings(self, guards: Mapping[str, int]) -> list[str]:
        """What the settings want to be told of the guards that acted in a fit."""
        s = self.settings
        asked = {"ar_clip": s.warn_on_ar_clip, "data_clip": s.warn_on_data_clip, "regularization": s.warn_on_regularization, "damped_update": s.warn_on_damped_update}
        return [f"{name.replace('_', ' ')}: {n} times" for name, n in guards.items() if asked.get(name)]

    def series_index(self, series_id: str) -> int:
        ids = self.series_ids()
        if series_id not in ids:
            raise KeyError(f"unknown series {series_id!r}; known: {', '.join(ids[:10])}")
        return ids.index(series_id)

    def series_ids(self) -> list[str]:
        return [s.series_id for s in self.series]

    def series_names(self) -> list[str]:
        return [s.series_name for s in self.series]

    def units(self) -> list[str | None]:
        return [s.units for s in self.series]

    def series_at(self, index: int) -> SeriesSpec:
        """The series at a place in the order; one outside it is an error that names the bounds."""
        if not 0 <= index < len(self.series):
            raise IndexError(f"series {index} is outside 0 to {len(self.series) - 1}")
        return self.series[index]

    def series_name(self, series: str | int) -> str:
        """The name of a series, by id or place; its id where it has no name."""
        found = self.series_at(series if isinstance(series, int) else self.series_index(series))
        return found.series_name or found.series_id

    def unit(self, series: str | int, default: str = "") -> str:
        """The unit of a series, by id or place."""
        return self.series_at(series if isinstance(series, int) else self.series_index(series)).units or default

    def ids_named(self, name: str) -> list[str]:
        """The ids of all series of a name."""
        return [s.series_id for s in self.series if s.series_name == name]

    def drift_from(self, spec: ModelSpec) -> list[str]:
        """How the configuration differs from the specification of a fitted result."""
        mine, now = list(spec.series), self.series_ids()
        found = [f"series {x} is gone" for x in mine if x not in now] + [f"series {x} is new" for x in now if x not in mine]
        if not found and mine != now:
            found.append("the series are in another order")
        for x, frequency in zip(mine, spec.layout.frequencies, strict=True):
            if x in now and self.series[now.index(x)].frequency != frequency:
                found.append(f"series {x}: frequency {frequency}")
        if spec.block_names != tuple(self.blocks):
            found.append(f"blocks {', '.join(spec.block_names)}")
        if spec.layout.clock != self.settings.clock:
            found.append(f"clock {spec.layout.clock}")
        return found


class ConfigSource(Protocol):
    """Anything that yields a configuration mapping."""

    def mapping(self) -> dict[str, Any]: ...


@dataclass(frozen=True)
class MappingSource:
    """A mapping as it is; it may be partial if it is merged onto another."""

    raw: Mapping[str, Any]

    def mapping(self) -> dict[str, Any]:
        return dict(self.raw)


def _folder_with(path: str) -> str:
    """The nearest folder upwards that holds ``series`` and ``blocks``."""
    at = os.path.dirname(os.path.abspath(path))
    while not all(os.path.isdir(os.path.join(at, x)) for x in ("series", "blocks")):
        up = os.path.dirname(at)
        if up == at:
            return os.path.dirname(os.path.abspath(path))
        at = up
    return at


@dataclass(frozen=True)
class YamlSource:
    """A YAML file. A ``defaults`` list names files ``series/<name>.yaml`` and ``blocks/<name>.yaml`` near it."""

    path: str

    def mapping(self) -> dict[str, Any]:
        with open(self.path) as f:
            raw = yaml.safe_load(f) or {}
        folder = _folder_with(self.path)
        for entry in raw.pop("defaults", None) or []:
            for group, name in entry.items() if isinstance(entry, dict) else ():
                part = os.path.join(folder, group, f"{name}.yaml")
                if name and os.path.exists(part):
                    with open(part) as f:
                        found = yaml.safe_load(f) or {}
                    if group in ("series", "blocks"):
                        raw[group] = found | (raw.get(group) or {})
                    else:
                        raw = found | raw
        return raw


@dataclass(frozen=True)
class MergedSource:
    """Settings and blocks of both, the override's where both speak; series of the override if it has any."""

    base: ConfigSource
    override: ConfigSource

    def mapping(self) -> dict[str, Any]:
        a, b = self.base.mapping(), self.override.mapping()
        out = a | {k: v for k, v in b.items() if v is not None}
        out["blocks"] = dict(a.get("blocks") or {}) | dict(b.get("blocks") or {})
        out["series"] = b.get("series") or a.get("series")
        return out


def source(given: Any = None, *, yaml_path: str | None = None, mapping: Mapping | None = None, hydra: Mapping | None = None) -> ConfigSource:
    """The source of a path, a mapping, a configuration or a source; one of them only."""
    named = [x for x in (given, yaml_path, mapping, hydra) if x is not None]
    if len(named) != 1:
        raise ValueError("give exactly one configuration source")
    x = named[0]
    if hasattr(x, "mapping"):
        return x
    if isinstance(x, ModelConfig):
        return MappingSource(x.to_mapping())
    if isinstance(x, Mapping):
        return MappingSource(x)
    if isinstance(x, str) and x.endswith((".yaml", ".yml")):
        return YamlSource(x)
    if isinstance(x, str) and x.endswith(".csv"):
        raise ValueError("a spec table is converted first: see spec_mapping and write_yaml")
    raise TypeError(f"no configuration source: {x!r}")


def load(given: Any) -> ModelConfig:
    return ModelConfig.from_mapping(source(given).mapping())


def spec_mapping(spec: DataFrame) -> dict[str, Any]:
    """A configuration mapping from a spec table: one row a series, 0/1 columns ``Block_*`` or ``Block-*``, or names in ``blocks``.

    Collects the specification: one row a series.
    """
    flags = [c for c in spec.columns if c.startswith(("Block_", "Block-"))]
    rows = [r.asDict() for r in spec.collect()]
    series: dict[str, dict] = {}
    for k, r in enumerate(rows):
        listed = [x.strip() for x in str(r.get("blocks") or "").split(",") if x.strip()]
        own = [c for c in flags if r[c] is not None and float(r[c]) != 0] or listed
        day = next((r[c] for c in ("Release", "release", "release_date", "release_day") if r.get(c) is not None), None)
        series[r.get("series_id") or f"series_{k}"] = {
            "series_name": r.get("series_name"),
            "frequency": r.get("frequency") or "m",
            "transformation": r.get("transformation") or "lin",
            "units": r.get("units"),
            "blocks": own,
            "release": int(day) if day not in (None, "") else None,
        }
    names = sorted(flags) or sorted({b for s in series.values() for b in s["blocks"]})
    return {"series": series, "blocks": {n: asdict(BlockSpec()) for n in names}}


def block_membership(spec: DataFrame, blocks: list[str]) -> DataFrame:
    """(series_id, block) from 0/1 columns, without collecting."""
    long = spec.unpivot("series_id", blocks, "block", "member")
    return long.where(F.col("member") != 0).select("series_id", "block")


def write_yaml(mapping: Mapping[str, Any], folder: str, name: str) -> tuple[str, str]:
    """``folder/series/<name>.yaml`` and ``folder/blocks/<name>.yaml``; returns both paths."""
    paths = []
    for group in ("series", "blocks"):
        os.makedirs(os.path.join(folder, group), exist_ok=True)
        paths.append(os.path.join(folder, group, f"{name}.yaml"))
        with open(paths[-1], "w") as f:
            yaml.safe_dump(mapping[group], f, sort_keys=False, allow_unicode=True)
    return paths[0], paths[1]


def issues(spec: DataFrame, blocks: DataFrame, clock: str = "m") -> DataFrame:
    """Validation as a table: (series_id, block, issue) for specifications that are tables themselves."""
    from ..functions.frequency import rank_column

    member = spec.select("series_id", "frequency", F.explode("blocks").alias("block")).join(blocks, "block", "left")
    kind = (
        F.when(F.col("clock").isNull(), F.lit("unknown block"))
        .when(rank_column("frequency").isNull(), F.lit("unknown frequency"))
        .when(rank_column("frequency") < rank_column("clock"), F.lit("faster than block clock"))
        .when(rank_column("clock") < rank(clock), F.lit("block faster than clock"))
        .when(F.col("factors") < 1, F.lit("no factors"))
    )
    return member.select("series_id", "block", kind.alias("issue")).where("issue is not null")
