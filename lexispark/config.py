"""Settings: the formulas' coefficients and bounds, default parameters and the search space.

``Config()`` has the defaults; ``load_config`` reads what differs from a JSON or YAML file. All parts are immutable,
so a cached file can be handed to every caller.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from functools import lru_cache
from itertools import product


@dataclass(frozen=True)
class Coefficients:
    # The published coefficients, thresholds and bounds.
    k1_base: float = 1.5
    alpha_ttr: float = 1.5
    alpha_maxtf: float = 0.3
    b_base: float = 0.5
    beta_corr: float = 0.4
    beta_cv: float = 0.3
    gamma_delta: float = 1.0
    k3_base: float = 0.5
    k3_rep: float = 2.0
    heaps_beta_threshold: float = 0.7
    hapax_ratio_threshold: float = 0.6
    k1_min: float = 0.5
    k1_max: float = 3.0
    b_min: float = 0.0
    b_max: float = 1.0
    delta_min: float = 0.0
    delta_max: float = 2.0
    k3_min: float = 0.0
    k3_max: float = 8.0


@dataclass(frozen=True)
class Params:
    k1: float = 1.2
    b: float = 0.75
    k3: float = 0.0
    delta: float = 0.0
    idf_type: str = "rsj"

    @property
    def model_variant(self) -> str:
        return "bm25+" if self.delta > 0 else "bm25"

    def updated(self, **changes) -> Params:
        """Only what is given and not None changes."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


@dataclass(frozen=True)
class Space:
    # The default search space.
    k1: tuple = (0.5, 0.8, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0)
    b: tuple = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 1.0)
    k3: tuple = (0.0, 0.5, 1.2, 2.0, 4.0, 8.0)
    delta: tuple = (0.0, 0.3, 0.5, 0.7, 1.0, 1.5)
    idf_type: tuple = ("rsj", "smoothed")

    def combos(self) -> list[tuple]:
        """(combo_id, k1, b, k3, delta, idf_type), the last varying fastest."""
        return [(i, *map(float, c[:4]), c[4]) for i, c in enumerate(product(self.k1, self.b, self.k3, self.delta, self.idf_type))]


@dataclass(frozen=True)
class Config:
    coefficients: Coefficients = field(default_factory=Coefficients)
    default_params: Params = field(default_factory=Params)
    space: Space = field(default_factory=Space)
    metric: str = "ndcg@10"
    top_k: int = 100


def _part(default, given: dict, where: str):
    known = {f.name for f in fields(default)}
    if unknown := set(given) - known:
        raise ValueError(f"{where} has unknown settings: {', '.join(sorted(unknown))}")
    return replace(default, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def from_dict(raw: dict) -> Config:
    """The sections ``coefficients``, ``default_params`` and ``grid_search``; others are not read, missing ones keep
    their defaults."""
    grid = dict(raw.get("grid_search") or {})
    c = Config()
    return Config(
        _part(c.coefficients, raw.get("coefficients") or {}, "coefficients"), _part(c.default_params, raw.get("default_params") or {}, "default_params"),
        _part(c.space, {k: v for k, v in grid.items() if k not in ("metric", "top_k")}, "grid_search"), grid.get("metric", c.metric), int(grid.get("top_k", c.top_k)),
    )


def load_config(path: str | None = None) -> Config:
    """The settings of a file on the driver, read again once it has changed; the defaults without one."""
    return Config() if path is None else _read(path, os.stat(path).st_mtime_ns)


@lru_cache(maxsize=8)
def _read(path: str, _changed: int) -> Config:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise RuntimeError("reading YAML settings needs the package yaml; JSON does not") from None
        return from_dict(yaml.safe_load(text) or {})
    return from_dict(json.loads(text))
