"""Settings of the two pipelines."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EpisodeConfig:
    """Excavator episodes: features, scores, thresholds."""

    win_seconds: tuple[int, ...] = (30, 60, 120)
    agg_minutes: int = 10
    score_quantile: float = 0.995
    healthy_days: int = 7
    idle_max_kmh: float = 0.3
    move_min_kmh: float = 1.0
    mad_floor: float = 1e-9
    min_regime_rows: int = 500
    min_healthy_rows: int = 2000
    forest_weight: float = 0.5
    stat_weight: float = 0.5
    trees: int = 300
    sample_fraction: float = 0.3
    contamination: float = 0.01
    seed: int = 42

    def rows_in(self, seconds: float, step: int) -> int:
        return rows_in_window(seconds, step)


@dataclass(frozen=True)
class ForestConfig:
    """Isolation forest. A tree draws ``sample_fraction`` of its group, or ``sample_rows``.

    ``task_rows`` bounds the rows that one task grows trees from; without it ``task_cells`` does, in numbers of 8 bytes.
    ``trees_per_task`` bounds the trees of a task, ``score_rows`` the rows of a task that scores, ``score_nodes`` the nodes
    of the tree pieces it meets (16 bytes each).
    """

    trees: int = 300
    sample_fraction: float = 0.3
    sample_rows: int | None = None
    task_rows: int | None = None
    task_cells: int = 131_072 * 144
    trees_per_task: int = 30
    contamination: float = 0.01
    seed: int = 42
    score_rows: int = 100_000
    score_nodes: int = 8_000_000

    def rows_of_task(self, features: int) -> int:
        """Rows of so many features that fit a task; a row takes about twelve numbers more: keys, places, a tree's draw."""
        return self.task_rows or max(1, self.task_cells // (features + 12))


@dataclass(frozen=True)
class RiskConfig:
    """Truck failure risk."""

    window: str = "720 minutes"
    fuel_window: str = "15 minutes"
    empty_days: float = 7
    target_days: float = 30
    threshold: float = 0.6
    rounds: int = 500
    rate: float = 0.03
    depth: int = 6
    seed: int = 42
    outlier_share: float = 0.02


def rows_in_window(seconds: float, step: int) -> int:
    """Window length in rows; ``round`` is half-to-even."""
    return max(2, int(round(seconds / step)))


def min_rows(width: int) -> int:
    """Rows a window must hold before it yields a value."""
    return max(2, width // 3)
