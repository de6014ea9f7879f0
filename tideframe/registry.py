"""Operators with what they promise: the shape of input and output, and whether they respect entities and time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

SHAPES = ("elem", "ts", "xs", "scalar", "frame")


@dataclass(frozen=True)
class FeatureSpec:
    """``build(column, panel, **params)`` makes the operator's column over a panel.

    ``panel_safe``: stays inside its entity. ``leakage_safe``: no row reads a later one. ``safe_scope`` says whether the
    operator may be taken row by row (``rowwise``) or needs its window (``window``).
    """

    name: str
    input_shape: str
    output_shape: str
    build: Callable[..., Column]
    panel_safe: bool
    leakage_safe: bool
    safe_scope: str = "window"
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.input_shape not in SHAPES or self.output_shape not in SHAPES:
            raise ValueError(f"shapes are {SHAPES}")
        if self.safe_scope not in ("rowwise", "window"):
            raise ValueError("safe_scope is rowwise or window")


_SPECS: dict[str, FeatureSpec] = {}


def register_feature(name: str, *, input_shape: str = "ts", output_shape: str = "ts", panel_safe: bool, leakage_safe: bool, safe_scope: str = "window", **params):
    """Decorator that adds an operator; names are unique."""

    def put(f: Callable[..., Column]):
        if name in _SPECS:
            raise ValueError(f"{name} is registered")
        _SPECS[name] = FeatureSpec(name, input_shape, output_shape, f, panel_safe, leakage_safe, safe_scope, params)
        return f

    return put


def get(name: str) -> FeatureSpec:
    return _SPECS[name]


def names(shape: str | None = None, leakage_safe: bool | None = None) -> list[str]:
    return sorted(n for n, s in _SPECS.items() if (shape is None or s.output_shape == shape) and (leakage_safe is None or s.leakage_safe == leakage_safe))


def unregister(name: str) -> None:
    _SPECS.pop(name, None)


def _fill() -> None:
    from tideframe.operators import alpha, rolling, xs

    for op in alpha.OPS.values():
        if op.frame:  # adds its column to a frame: tideframe.operators.alpha.apply
            continue

        def build(c, p, *more, op=op, **kw):
            context = alpha.Context(p.window, (p.df[p.time],))
            grid = () if not op.grid else (kw.get("param", op.grid[0]),)
            return op.build(context, c, *more, *grid)

        _SPECS[f"alpha.{op.name}"] = FeatureSpec(f"alpha.{op.name}", op.kind, op.kind, build, True, True, "rowwise" if op.kind == "elem" else "window", {"arity": op.arity, "grid": op.grid})
    for n, f in (("zscore", rolling.zscore), ("rolling_vol", rolling.rolling_vol)):
        _SPECS[f"panel.{n}"] = FeatureSpec(f"panel.{n}", "ts", "ts", lambda c, p, window=5, f=f: f(c, p.window, window), True, True)
    _SPECS["panel.frac_diff"] = FeatureSpec("panel.frac_diff", "ts", "ts", lambda c, p, d=0.5, threshold=0.05: rolling.frac_diff(c, p.window, d, threshold), True, True)
    for n, f in (("rank", xs.rank), ("demean", xs.demean), ("zscore", xs.zscore), ("up_share", xs.up_share), ("dispersion", xs.dispersion)):
        _SPECS[f"xs.{n}"] = FeatureSpec(f"xs.{n}", "xs", "xs", lambda c, p, f=f: f(c, p.time), True, True)


_fill()


class FeatureRegistry:
    """The registered operators as a whole: names are ``namespace.operator``."""

    @staticmethod
    def all() -> list[FeatureSpec]:
        return [_SPECS[n] for n in sorted(_SPECS)]

    @staticmethod
    def namespaces() -> list[str]:
        return sorted({n.rpartition(".")[0] for n in _SPECS})

    @staticmethod
    def by_namespace(namespace: str) -> list[FeatureSpec]:
        return [s for s in FeatureRegistry.all() if s.name.rpartition(".")[0] == namespace]

    @staticmethod
    def to_records() -> list[dict]:
        return [{k: v for k, v in vars(s).items() if k != "build"} for s in FeatureRegistry.all()]

    @staticmethod
    def to_llms_txt() -> str:
        """The operators as Markdown, a list for each namespace."""
        lines = []
        for space in FeatureRegistry.namespaces():
            lines += [f"## {space or 'general'}", ""]
            for s in FeatureRegistry.by_namespace(space):
                promise = ", ".join(x for x, on in (("inside its entity", s.panel_safe), ("never looks ahead", s.leakage_safe)) if on) or "no promise"
                lines.append(f"- `{s.name}`: {s.input_shape} to {s.output_shape}; {promise}")
            lines.append("")
        return "\n".join(lines)

    @staticmethod
    def clear() -> None:
        """Back to the operators of the library itself."""
        _SPECS.clear()
        _fill()
