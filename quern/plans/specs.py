"""Sweep specs, metric registry and reports."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass, field


def fingerprint(config: dict) -> str:
    """Digest of the sorted JSON of a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class SweepSpec:
    lever: str
    grid: tuple[float, ...]
    seeds: tuple[int, ...]
    metric: str
    direction: str = "maximize"
    epsilon: float = 0.0

    @property
    def hash(self) -> str:
        return fingerprint(self.__dict__)


def parse_spec(toml: str, bounds: dict[str, tuple[float, float]]) -> SweepSpec:
    """A spec from TOML: grid as a list, or lo, hi, n. Unknown keys or levers
    and points out of bounds are refused."""
    raw = tomllib.loads(toml)
    extra = set(raw) - {"lever", "grid", "seeds", "metric", "direction", "epsilon"}
    if extra or raw.get("lever") not in bounds or raw.get("direction", "maximize") not in ("maximize", "minimize"):
        raise ValueError(f"not a sweep: {sorted(extra) or raw.get('lever')}")
    grid = raw["grid"]
    if isinstance(grid, dict):
        lo, hi, n = grid["lo"], grid["hi"], grid["n"]
        grid = [lo + (hi - lo) * i / (n - 1) for i in range(n)] if n > 1 else [lo]
    low, high = bounds[raw["lever"]]
    if not grid or any(not low <= g <= high for g in grid):
        raise ValueError("the grid is empty or out of bounds")
    return SweepSpec(raw["lever"], tuple(map(float, grid)), tuple(raw.get("seeds", [0])), raw["metric"], raw.get("direction", "maximize"), float(raw.get("epsilon", 0.0)))


@dataclass
class Registry:
    """Named metrics; a name is given once, and unknown ones are refused."""

    found: dict[str, object] = field(default_factory=dict)

    def register(self, name: str, what: object) -> None:
        if name in self.found:
            raise ValueError(f"{name} is registered")
        self.found[name] = what

    def get(self, name: str) -> object:
        if name not in self.found:
            raise KeyError(f"{name} is not registered")
        return self.found[name]


def report(title: str, curves: dict[str, list[float]], notes: list[str]) -> tuple[str, str]:
    """(markdown, JSON) of a summary; the same input gives the same bytes."""
    lines = [f"# {title}", ""]
    for name in sorted(curves):
        lines.append(f"- {name}: " + ", ".join(f"{v:.4f}" for v in curves[name]))
    lines += ["", *[f"> {n}" for n in notes]]
    return "\n".join(lines) + "\n", json.dumps({"title": title, "curves": curves, "notes": notes}, sort_keys=True, indent=1)
