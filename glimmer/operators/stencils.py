"""Frame-local operators on packed frames: each task holds a batch of frames and shuffles nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame


def taps(radius: float, second: bool = False) -> np.ndarray:
    """Gaussian weights at -n..n with n = 4 ceil(radius); ``second``: times (1 - d^2 / radius^2)."""
    n = 4 * int(np.ceil(radius))
    d = np.arange(-n, n + 1)
    g = np.exp(-(d**2) / (2 * radius**2)) / (radius * np.sqrt(2 * np.pi))
    return (1 - d**2 / radius**2) * g if second else g


def band(weights: np.ndarray, size: int) -> np.ndarray:
    """The matrix that convolves a line of ``size`` with ``weights``, zeros outside."""
    n = len(weights) // 2
    d = np.arange(size)[:, None] - np.arange(size)[None, :]
    return np.where(np.abs(d) <= n, weights[np.clip(d + n, 0, 2 * n)], 0.0)


def gaussian(images: np.ndarray, radius: float) -> np.ndarray:
    h, w = images.shape[-2:]
    g = taps(radius)
    return band(g, h) @ images @ band(g, w).T


def log_filter(images: np.ndarray, radius: float) -> np.ndarray:
    """Negated, scale-normalised Laplacian of a Gaussian as two separable passes."""
    h, w = images.shape[-2:]
    g, s = taps(radius), taps(radius, True)
    return band(s, h) @ images @ band(g, w).T + band(g, h) @ images @ band(s, w).T


def log_scales(images: np.ndarray, radii: Sequence[float]) -> np.ndarray:
    """(frame, scale, y, x)."""
    return np.stack([log_filter(images, r) for r in radii], -3)


def slide(images: np.ndarray, axis: int, before: int, after: int, best: Callable) -> np.ndarray:
    """Running maximum or minimum (``best``: np.maximum or np.minimum) over a window cut off at the edges."""
    out = images.copy()
    n = images.shape[axis]
    cut = lambda a, b: tuple(slice(a, b) if i == axis % images.ndim else slice(None) for i in range(images.ndim))
    for k in range(1, before + 1):
        if k < n:
            out[cut(k, n)] = best(out[cut(k, n)], images[cut(0, n - k)])
    for k in range(1, after + 1):
        if k < n:
            out[cut(0, n - k)] = best(out[cut(0, n - k)], images[cut(k, n)])
    return out


def max_pool(images: np.ndarray, axes: Sequence[int] = (-3, -2, -1)) -> np.ndarray:
    for axis in axes:
        images = slide(images, axis, 1, 1, np.maximum)
    return images


def neighbor_mean(images: np.ndarray) -> np.ndarray:
    """Mean of the eight neighbours; zeros stand outside."""
    h, w = images.shape[-2:]
    ones = np.ones(3)
    return (band(ones, h) @ images @ band(ones, w).T - images) / 8


def grey_closing(images: np.ndarray, size: int = 10) -> np.ndarray:
    """Dilation over -(size/2 - 1)..size/2, then erosion over the mirrored window, on both axes."""
    low, high = size - 1 - size // 2, size // 2
    for axis in (-2, -1):
        images = slide(images, axis, low, high, np.maximum)
    for axis in (-2, -1):
        images = slide(images, axis, high, low, np.minimum)
    return images


def region(image: np.ndarray, y: int, x: int) -> np.ndarray:
    """Grow from the seed: a pixel joins if it is positive and no larger than an 8-neighbour that is in."""
    h, w = image.shape
    inside = np.zeros((h, w), bool)
    inside[y, x] = True
    edge = [(y, x)]
    while edge:
        cy, cx = edge.pop()
        for ny in range(max(0, cy - 1), min(h, cy + 2)):
            for nx in range(max(0, cx - 1), min(w, cx + 2)):
                if not inside[ny, nx] and 0 < image[ny, nx] <= image[cy, cx]:
                    inside[ny, nx] = True
                    edge.append((ny, nx))
    return inside


def rescaled(image: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Values inside brought to 0..1, zero outside; a flat region has no scale and is zero."""
    low, high = image[inside].min(), image[inside].max()
    return np.where(inside, (image - low) / (high - low), 0.0) if high > low else np.zeros_like(image)


def by_frame(frames: DataFrame, height: int, width: int, work: Callable, schema: str) -> DataFrame:
    """``work(t, images)`` on batches of frames; it returns a dict of columns for ``schema``. A frame
    that is null or has another number of pixels has no rows; a null pixel is NaN to ``work``."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column("px")), height * width), False)
            if not pc.all(whole).as_py():
                batch = batch.filter(whole)
            if not batch.num_rows:
                continue
            flat = batch.column("px").flatten().to_numpy(zero_copy_only=False)
            out = work(batch.column("t").to_numpy(), flat.reshape(-1, height, width))
            yield pa.RecordBatch.from_pydict(out)

    return frames.select("t", "px").mapInArrow(run, schema)


def image_rows(t: np.ndarray, images: np.ndarray, name: str = "v") -> dict:
    """Columns t, y, x and ``name`` of (frame, y, x) values."""
    n, h, w = images.shape
    y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
    return {"t": np.repeat(t.astype(np.int32), h * w), "y": np.tile(y, n), "x": np.tile(x, n), name: images.ravel()}


def image_map(frames: DataFrame, height: int, width: int, work: Callable, name: str = "v") -> DataFrame:
    """(t, y, x, name) of a function from images to images."""
    return by_frame(frames, height, width, lambda t, images: image_rows(t, np.ascontiguousarray(work(images)), name), f"t int, y int, x int, {name} double")


def scale_map(frames: DataFrame, height: int, width: int, radii: Sequence[float], work: Callable, kind: str = "double") -> DataFrame:
    """(t, ri, y, x, v) of a function of the scale space (frame, scale, y, x)."""

    def rows(t, images):
        found = work(log_scales(images, radii))
        n, k, h, w = found.shape
        flat = image_rows(np.repeat(t, k), found.reshape(n * k, h, w))
        flat["ri"] = np.tile(np.repeat(np.arange(k, dtype=np.int32), h * w), n)
        return {c: flat[c] for c in ("t", "ri", "y", "x", "v")}

    return by_frame(frames, height, width, rows, f"t int, ri int, y int, x int, v {kind}")
