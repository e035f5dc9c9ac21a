"""Roles, contrasts and constants of a study."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Contrast:
    """Group A against the groups of B; other groups stay in rankings but not in the contrast."""

    a: tuple[str, ...]
    b: tuple[str, ...]


@dataclass(frozen=True)
class BlockSpec:
    """A feature block: which encoder families it holds. Ablations make a new value."""

    name: str
    base: bool = True
    municipality: bool = True
    background: bool = True
    group: bool = False
    sex: bool = False
    extra: tuple[str, ...] = ()


BLOCKS = {
    "B1": BlockSpec("B1", municipality=False, background=False),
    "B2": BlockSpec("B2", background=False),
    "B3": BlockSpec("B3"),
    "B4": BlockSpec("B4", group=True),
    "B5": BlockSpec("B5", sex=True),
    "B6": BlockSpec("B6", group=True, sex=True),
}


@dataclass(frozen=True)
class Study:
    seed: int = 20190101
    capacity: float = 0.10
    epsilon_pp: float = 1.0
    replicates: int = 1000
    floor: int = 30
    smoothing: int = 30
    min_events: int = 30
    contrast: Contrast = field(default_factory=lambda: Contrast(("EUROPE",), ("AFRICA", "AMERICA")))
    undeclared: str = "NOT_DECLARED"


STUDY = Study()
