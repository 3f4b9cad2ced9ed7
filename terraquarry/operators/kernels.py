"""What is computed on one raster inside a task, in NumPy: magnitudes, thresholds, neighbours, components, confidence.

A raster here is a tile (of bounded size) or a block of a larger one. The functions take and
give arrays; ``detection``, ``suppression`` and ``change`` deal rasters out to them.
"""

from __future__ import annotations

import numpy as np

#: Scene classes that hide the ground (none, saturated, shadow, clouds, cirrus, snow).
UNUSABLE_CLASSES = (0, 1, 3, 8, 9, 10, 11)
#: Fixed value: median absolute deviations to standard deviations of a normal distribution.
MAD_SCALE = 1.4826
#: The weights of spectral margin and of eight neighbours, and the least confidence.
MARGIN_WEIGHT, NEIGHBOR_WEIGHT, LEAST_CONFIDENCE = 0.5, 0.5 / 8, 0.05


def usable(values: np.ndarray, nodata: float | None, mask_nodata: bool = True) -> np.ndarray:
    """Which digital numbers are finite and, with ``mask_nodata``, positive and not the nodata value."""
    good = np.isfinite(values)
    if mask_nodata:
        good &= values > 0
        if nodata is not None:
            good &= values != nodata
    return good


def magnitude(reference: list[np.ndarray], comparison: list[np.ndarray], nodata: list[tuple[float | None, float | None]], scale: float, hidden: np.ndarray | None = None, mask_nodata: bool = True) -> np.ndarray:
    """The Euclidean distance of the bands' reflectances; NaN where a band of either side is not usable or ``hidden``."""
    total, valid = np.zeros(reference[0].shape), np.ones(reference[0].shape, bool)
    for a, b, (none_a, none_b) in zip(reference, comparison, nodata, strict=True):
        valid &= usable(a, none_a, mask_nodata) & usable(b, none_b, mask_nodata)
        x, y = (v.astype(np.float32).astype(np.float64) / float(np.float32(scale)) for v in (a, b))
        total += np.square(y - x)
    if hidden is not None:
        valid &= ~hidden
    return np.where(valid, np.sqrt(total), np.nan)


def hidden_by(classes: np.ndarray) -> np.ndarray:
    """Pixels that a class layer of half the resolution hides."""
    return np.isin(classes, UNUSABLE_CLASSES).repeat(2, 0).repeat(2, 1)


def summary(values: np.ndarray) -> tuple[float, ...]:
    """mean, median, 95th and 99th percentile, max and standard deviation (of the population) of some finite values."""
    return (float(values.mean()), *map(float, np.percentile(values, (50, 95, 99))), float(values.max()), float(values.std()))


def limits(values: np.ndarray, k: float, offset: float) -> tuple[float, float, float]:
    """Median, median absolute deviation and threshold."""
    median = float(np.median(values))
    mad = float(np.median(np.abs(values - median)))
    return median, mad, median + max(k * MAD_SCALE * mad, offset)


def neighbor_counts(place: np.ndarray, width: int) -> np.ndarray:
    """For pixels (sorted, distinct, row * width + column): how many of the eight around each are among them."""
    row, column = np.divmod(place, width)
    out = np.zeros(len(place), np.int64)
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if i or j:
                out += _found(place, row + i, column + j, width)[0]
    return out


def _found(place: np.ndarray, row: np.ndarray, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pixel is at each row and column, and where in ``place``."""
    want = row * width + column
    at = np.searchsorted(place, want)
    inside = (at < len(place)) & (column >= 0) & (column < width)
    inside[inside] = place[at[inside]] == want[inside]
    return inside, at


def labels(place: np.ndarray, width: int) -> np.ndarray:
    """For pixels as above: the index of the first pixel of each one's 8-connected component, by pointer jumping."""
    row, column = np.divmod(place, width)
    ends = []
    for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)):
        hit, at = _found(place, row + i, column + j, width)
        ends.append((np.flatnonzero(hit), at[hit]))
    a, b = np.concatenate([x for x, _ in ends]), np.concatenate([x for _, x in ends])
    root = np.arange(len(place))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def confidence(values: np.ndarray, threshold: float, neighbors: np.ndarray) -> np.ndarray:
    """0.05 to 1: half spectral margin, half density of candidates around."""
    total = values + threshold
    margin = np.divide(values - threshold, total, out=np.zeros_like(values), where=total > 0)
    return np.clip(MARGIN_WEIGHT * margin + NEIGHBOR_WEIGHT * neighbors, LEAST_CONFIDENCE, 1.0)


def candidates(place: np.ndarray, values: np.ndarray, width: int, threshold: float, min_neighbors: int, min_area: int) -> dict[str, np.ndarray]:
    """The pixels over the threshold: place, magnitude, neighbors, and component (a place), area and confidence where confirmed (component -1 elsewhere).

    ``place`` is sorted and distinct. Confirmed are candidates of ``min_neighbors`` and more, in an
    8-connected component of them of ``min_area`` and more.
    """
    over = values > threshold
    place, values = place[over], values[over]
    near = neighbor_counts(place, width)
    kept = np.flatnonzero(near >= min_neighbors)
    root = labels(place[kept], width)
    area = np.bincount(root, minlength=len(root))[root] if len(root) else root
    good = kept[area >= min_area]
    component, areas = np.full(len(place), -1, np.int64), np.zeros(len(place), np.int64)
    component[good], areas[good] = place[kept][root[area >= min_area]], area[area >= min_area]
    return {"place": place, "magnitude": values, "neighbors": near, "component": component, "area": areas, "confidence": np.where(component >= 0, confidence(values, threshold, near), np.nan)}
