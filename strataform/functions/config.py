"""Plan-time configuration: merging, units, budgets and automatic thresholds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from copy import deepcopy
from typing import Any


class Refusal(Exception):
    """A step that may not run: the gate it belongs to, why, and what would help."""

    def __init__(self, reason: str, gate: str | None = None, remedy: str | None = None):
        super().__init__(reason)
        self.reason, self.gate, self.remedy = reason, gate, remedy


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Nested mappings, later layers over earlier ones; lists and scalars are replaced whole."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else deepcopy(v)
    return out


def leaves(config: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """Leaf values by dotted path."""
    out: dict[str, Any] = {}
    for k, v in config.items():
        path = f"{prefix}.{k}" if prefix else k
        out |= leaves(v, path) if isinstance(v, Mapping) and v else {path: v}
    return out


def longest_prefix(path: str, rules: Mapping[str, str]) -> str | None:
    """The value of the longest rule that is the path or one of its parents."""
    parts = path.split(".")
    for n in range(len(parts), 0, -1):
        if (rule := ".".join(parts[:n])) in rules:
            return rules[rule]
    return None


def in_units(config: Mapping[str, Any], keys: Iterable[str], units_per_metre: float) -> tuple[dict[str, Any], dict[str, tuple[float, float]]]:
    """Length keys (dotted) turned from metres to scene units, with the pairs before and after."""
    out, changed = deepcopy(dict(config)), {}
    for path in keys:
        node: Any = out
        *parents, last = path.split(".")
        for p in parents:
            node = node.get(p) if isinstance(node, dict) else None
        if isinstance(node, dict) and isinstance(node.get(last), (int, float)) and not isinstance(node[last], bool):
            changed[path] = (node[last], node[last] * units_per_metre)
            node[last] = node[last] * units_per_metre
    return out, changed


def scale_of(record: Mapping[str, Any] | None) -> float:
    """Scene units in a metre from a measurement: its length in metres and in units."""
    if not record:
        raise Refusal("the scene has no measured length", gate="volume", remedy="measure a length whose size in metres is known")
    metres, units = float(record["length_m"]), float(record["units"])
    if metres <= 0 or units <= 0:
        raise Refusal("a measured length must be positive", gate="volume")
    return units / metres


def same_scale(a: float, b: float, tolerance: float = 1e-9) -> bool:
    return abs(a - b) <= tolerance * max(abs(a), abs(b))


def auto_thresholds(config: Mapping[str, Any], smallest_extent: float, fractions: Mapping[str, float]) -> dict[str, Any]:
    """Values `auto` become a fraction of the smallest horizontal extent."""
    return {k: fractions[k] * smallest_extent if v == "auto" else v for k, v in config.items()}


def class_capacity(points: int, memory: float, reserve: float, bytes_each: float = 12.0) -> int:
    """Classes whose weights of all points fit into memory."""
    return int((memory - reserve) // (bytes_each * points)) if points else 0


def grid_cells(extent: tuple[float, float], cell: float) -> int:
    import math

    return math.ceil(extent[0] / cell) * math.ceil(extent[1] / cell)


def check_grid(extent: tuple[float, float], cell: float, most: int) -> int:
    """The number of cells, refused above `most` before any work."""
    n = grid_cells(extent, cell)
    if n > most:
        raise Refusal(f"a grid of {n} cells exceeds {most}", remedy="use larger cells or a smaller region")
    return n


def fit_order(models: Mapping[str, float], memory: float, tight: float = 0.9) -> str | None:
    """The largest model that fits well, else the largest that fits tightly, else the smallest."""
    if not models:
        return None
    well = [m for m, need in models.items() if need <= memory * tight]
    some = [m for m, need in models.items() if need <= memory]
    pool, best = (well or some, True) if well or some else (list(models), False)
    return max(pool, key=lambda m: (models[m], m)) if best else min(pool, key=lambda m: (models[m], m))


def box_decimals(voxel: float) -> int:
    """Decimals worth keeping for box corners: one below the voxel size, 0 to 6."""
    import math

    return max(0, min(6, 1 - math.floor(math.log10(voxel)))) if voxel > 0 else 6


def significant(v: float, n: int = 3) -> float:
    """Rounded to n significant digits."""
    return float(f"{v:.{n}g}") if v else 0.0


def metres_text(v: float) -> str:
    """A length with three significant digits and no trailing zeros."""
    return f"{significant(v):g} m"
