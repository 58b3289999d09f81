"""Statistics of the last rows up to each row, for use inside tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Frame:
    """Known values of a frame at each row (rows x columns): their number, sum, mean, squared deviations, least and largest."""

    n: np.ndarray
    total: np.ndarray
    centre: np.ndarray
    squares: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / np.maximum(self.n, 1.0)

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(self.squares / np.maximum(self.n - 1.0, 1.0))


def trailing_frames(x: np.ndarray, known: np.ndarray, place: np.ndarray, widths: Sequence[int], ends: int | None = None) -> dict[int, Frame]:
    """The frame of the last so many rows at each row, for each width.

    ``place`` counts the rows of a group from 0, and no frame leaves its group. Frames of 1, 2, 4, ... rows are put together
    from halves, and a width from those, so the steps of a row are the bits of the width, not its rows. Nothing is taken away
    from a sum, so a value that does not change has no deviation. Least and largest are those of the first ``ends`` columns.
    """
    first, some = x[:, :ends], known[:, :ends]
    held = np.where(known, x, 0.0)
    now = Frame(known.astype(np.float64), held, held, np.zeros(x.shape), np.where(some, first, np.nan), np.where(some, first, -np.inf))
    made: dict[int, Frame] = {}
    reach, size, most = dict.fromkeys(widths, 0), 1, max(widths)
    while size <= most:
        for width in reach:
            if width & size:
                made[width] = _joined(made[width], now, reach[width], place) if width in made else now
                reach[width] += size
        size *= 2
        if size <= most:
            now = _joined(now, now, size // 2, place)
    return made


def _joined(near: Frame, far: Frame, shift: int, place: np.ndarray) -> Frame:
    """Two adjoining frames in one: ``near`` ends at a row, ``far`` so many rows before it."""
    inside = (place >= shift)[shift:, None]
    if not inside.any():
        return near

    def pair(name: str, blank: float) -> tuple[np.ndarray, np.ndarray]:
        return getattr(near, name)[shift:], np.where(inside, getattr(far, name)[:-shift], blank)

    def whole(name: str, rest: np.ndarray) -> np.ndarray:
        return np.concatenate([getattr(near, name)[:shift], rest])

    with np.errstate(invalid="ignore", over="ignore"):
        (n, m), (total, more) = pair("n", 0.0), pair("total", 0.0)
        (centre, other), (squares, rest) = pair("centre", 0.0), pair("squares", 0.0)
        apart, both = other - centre, n + m
        share = m / np.maximum(both, 1.0)
        return Frame(whole("n", both), whole("total", total + more), whole("centre", centre + apart * share),
                     whole("squares", squares + rest + apart * apart * n * share),
                     whole("low", np.fmin(*pair("low", np.nan))), whole("high", np.maximum(*pair("high", -np.inf))))
