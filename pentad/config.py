"""Knobs of the index builder and of the search. Values out of range raise."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

DIMS = 14
SCALE = 10_000
NEIGHBOURS = 5
APPROVE_BELOW = 3
FEATURES = tuple(f"f{i}" for i in range(DIMS))
#: Stands for "no last transaction" in features 5 and 6.
MISSING = -SCALE


def _between(name: str, value: int, low: int, high: int | None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} is {value}, not in {low}..{high if high is not None else ''}")


LAYOUTS = ("flat", "lists", "kmeans", "tree")


@dataclass(frozen=True)
class IndexConfig:
    """How the reference set is laid out."""

    layout: str = "tree"  # flat, lists (equal ranges), kmeans or tree
    lists: int = 0  # 0: as many as references, for the layouts of lists
    leaf_size: int = 256  # references in a leaf of the tree
    train_rows: int = 131_072
    iterations: int = 3
    window: int = 64
    min_support: tuple[int, int, int, int] = (100, 6000, 150, 6000)  # table 1 legit, fraud; table 2 legit, fraud

    def __post_init__(self):
        _between("lists", self.lists, 0, None)
        _between("leaf_size", self.leaf_size, 8, 512)
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout is {self.layout}, not one of {', '.join(LAYOUTS)}")
        _between("train_rows", self.train_rows, 1, None)
        _between("iterations", self.iterations, 0, 32)
        _between("window", self.window, 0, None)
        for n in self.min_support:
            _between("min_support", n, 1, 65_535)


@dataclass(frozen=True)
class SearchConfig:
    """How lists are probed, and which shortcuts answer without a search."""

    nprobe: int = 40
    repair_nprobe: int = 64
    repair_min: int = 2
    repair_max: int = 3
    worst_thresholds: tuple[int, ...] = (0,) * 6  # 0: off
    exact_fallback: bool = True
    early_milli: int = 0  # 0: off
    profile_shortcut: bool = False
    profile_min: tuple[int, int] = (1000, 1000)
    purity_shortcut: bool = False
    purity_answers: tuple[bool, bool, bool, bool] = (False, True, False, True)  # table 1 legit, fraud; table 2 legit, fraud

    def __post_init__(self):
        _between("nprobe", self.nprobe, 1, None)
        _between("repair_nprobe", self.repair_nprobe, 0, None)
        _between("repair_min", self.repair_min, 0, NEIGHBOURS)
        _between("repair_max", self.repair_max, 0, NEIGHBOURS)
        _between("early_milli", self.early_milli, 0, 2000)
        if len(self.worst_thresholds) != NEIGHBOURS + 1:
            raise ValueError("worst_thresholds has one value for each count of fraud labels")
        for n in self.profile_min:
            _between("profile_min", n, 1, 65_535)

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> SearchConfig:
        """From strings by field name, as an environment has them: numbers, lists by comma, truth as 0, false or other."""

        def read(default, text: str):
            if isinstance(default, tuple):
                return tuple(read(d, t) for d, t in zip(default, text.split(","), strict=True))
            return text.lower() not in ("0", "false") if isinstance(default, bool) else int(text)

        now = cls()
        return replace(now, **{f.name: read(getattr(now, f.name), values[f.name]) for f in fields(cls) if f.name in values})

    @property
    def early_distance(self) -> int:
        return (SCALE * self.early_milli // 1000) ** 2
