"""Pixel work in Arrow batches: slicing, cropping, resizing, normalising.  Rasters are (height, width, 3) uint8 in BGR."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MEAN, STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def area_resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the source area of each target pixel, by summed-area tables along each axis."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        edges = np.linspace(0, a.shape[0], n + 1)
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        low = np.floor(edges).astype(int)
        frac = (edges - low).reshape(-1, *[1] * (a.ndim - 1))
        at = sums[low] + frac * (sums[np.minimum(low + 1, a.shape[0])] - sums[low])
        return np.diff(at, axis=0) / (a.shape[0] / n)

    out = along(img.astype(float), height)
    return np.clip(np.rint(along(out.swapaxes(0, 1), width).swapaxes(0, 1)), 0, 255).astype(np.uint8)


def crop(img: np.ndarray | None, window: tuple[int, int, int, int] | None, size: int = 224) -> np.ndarray:
    """A window (x1, y1, x2, y2) resized to a square; black without a window or raster."""
    if img is None or window is None or window[2] <= window[0] or window[3] <= window[1]:
        return np.zeros((size, size, 3), np.uint8)
    return area_resize(img[window[1] : window[3], window[0] : window[2]], size, size)


def fit_square(img: np.ndarray, size: int) -> np.ndarray:
    """Longest side to ``size``, the rest padded by reflection."""
    h, w = img.shape[:2]
    scale = size / max(h, w)
    small = area_resize(img, max(1, round(h * scale)), max(1, round(w * scale)))
    dy, dx = size - small.shape[0], size - small.shape[1]
    return np.pad(small, ((dy // 2, dy - dy // 2), (dx // 2, dx - dx // 2), (0, 0)), mode="reflect" if min(small.shape[:2]) > 1 else "edge")


def centre_crop(img: np.ndarray, size: int) -> np.ndarray:
    y, x = (img.shape[0] - size) // 2, (img.shape[1] - size) // 2
    return img[y : y + size, x : x + size]


def random_resized_crop(img: np.ndarray, size: int, rng: np.random.Generator, scale: tuple[float, float] = (0.7, 1.0), ratio: tuple[float, float] = (0.75, 1.333)) -> np.ndarray:
    """A window of a random share of the area and a random aspect, resized to a square; the whole centre if ten draws don't fit."""
    h, w = img.shape[:2]
    for _ in range(10):
        area = h * w * rng.uniform(*scale)
        aspect = np.exp(rng.uniform(*np.log(ratio)))
        cw, ch = round((area * aspect) ** 0.5), round((area / aspect) ** 0.5)
        if 0 < cw <= w and 0 < ch <= h:
            y, x = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
            return area_resize(img[y : y + ch, x : x + cw], size, size)
    return area_resize(centre_crop(img, min(h, w)), size, size)


def shift_scale_rotate(img: np.ndarray, dx: float, dy: float, zoom: float, degrees: float) -> np.ndarray:
    """Turned and scaled about the centre, then shifted by shares of the sides: bilinear, mirrored at the borders without the edge itself."""
    h, w = img.shape[:2]
    y, x = np.mgrid[0:h, 0:w].astype(float)
    x, y = x - dx * w - (w - 1) / 2, y - dy * h - (h - 1) / 2
    c, s = np.cos(np.radians(degrees)) / zoom, np.sin(np.radians(degrees)) / zoom

    def mirrored(v: np.ndarray, n: int) -> np.ndarray:
        v = np.abs(v) % max(1, 2 * (n - 1))
        return np.minimum(v, 2 * (n - 1) - v)

    fx, fy = mirrored(c * x - s * y + (w - 1) / 2, w), mirrored(s * x + c * y + (h - 1) / 2, h)
    x0, y0 = np.floor(fx).astype(int), np.floor(fy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    ax, ay = (fx - x0)[..., None], (fy - y0)[..., None]
    top, low = img[y0, x0] * (1 - ax) + img[y0, x1] * ax, img[y1, x0] * (1 - ax) + img[y1, x1] * ax
    return np.clip(np.rint(top * (1 - ay) + low * ay), 0, 255).astype(np.uint8)


def colour_jitter(img: np.ndarray, brightness: float, contrast: float, saturation: float, hue: float) -> np.ndarray:
    """Factors of brightness, of contrast about the mean grey, of saturation about each pixel's grey, and a turn of the hue in full turns."""
    grey = np.array([0.114, 0.587, 0.299])  # of blue, green and red
    out = img.astype(float) * brightness
    mean = (out @ grey).mean()
    out = (out - mean) * contrast + mean
    own = (out @ grey)[..., None]
    out = np.clip((out - own) * saturation + own, 0, 255)
    if hue:
        a = 2 * np.pi * hue
        axis = np.full((3, 3), 1 / 3)
        cross = np.array([[0, -1, 1], [1, 0, -1], [-1, 1, 0]]) / 3**0.5
        out = out @ (np.cos(a) * np.eye(3) + np.sin(a) * cross + (1 - np.cos(a)) * axis).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def coarse_dropout(img: np.ndarray, rng: np.random.Generator, holes: int = 2, share: float = 0.12) -> np.ndarray:
    """One to ``holes`` black rectangles of sides up to ``share`` of the image's."""
    out = img.copy()
    for _ in range(rng.integers(1, holes + 1)):
        h, w = (rng.integers(1, max(2, int(n * share) + 1)) for n in img.shape[:2])
        y, x = rng.integers(0, img.shape[0] - h + 1), rng.integers(0, img.shape[1] - w + 1)
        out[y : y + h, x : x + w] = 0
    return out


def random_augment(img: np.ndarray, seed: int, size: int | None = None) -> np.ndarray:
    """The training chain by a row's seed: random crop, flips, a small shift, turn and scaling, colours, dropped-out rectangles."""
    rng = np.random.default_rng(seed)
    out = random_resized_crop(img, size or min(img.shape[:2]), rng)
    out = out[:, ::-1] if rng.random() < 0.5 else out
    out = out[::-1] if rng.random() < 0.15 else out
    if rng.random() < 0.35:
        out = shift_scale_rotate(out, *rng.uniform(-0.05, 0.05, 2), 1 + rng.uniform(-0.1, 0.1), rng.uniform(-20, 20))
    if rng.random() < 0.35:
        out = colour_jitter(out, *rng.uniform(0.8, 1.2, 3), rng.uniform(-0.02, 0.02))
    return coarse_dropout(out, rng) if rng.random() < 0.3 else out


def transform(size: int, train: bool) -> Callable[[np.ndarray, int], np.ndarray]:
    """The chain of a mode: (raster, seed) -> normalised planes.  Evaluation is deterministic and doesn't look at the seed."""
    if train:
        return lambda img, seed: to_tensor(random_augment(fit_square(img, max(256, size)), seed, size))
    return lambda img, seed: to_tensor(centre_crop(fit_square(img, size), size))


def tensors(rows: DataFrame, size: int, train: bool, seed: int = 42) -> DataFrame:
    """(row_id, tensor) of rows (row_id, height, width, data): 3 x size x size floats; a missing or unreadable raster is black."""
    chain = transform(size, train)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                img = None if pd.isna(r.height) or pd.isna(r.width) else _raster(r.data, int(r.height), int(r.width))
                img = np.zeros((size, size, 3), np.uint8) if img is None else img
                out.append(chain(img, (seed << 32) ^ int(r.row_id)).ravel())
            yield pd.DataFrame({"row_id": frame["row_id"], "tensor": out})

    return rows.select("row_id", "height", "width", "data").mapInPandas(run, "row_id long, tensor array<float>")


def to_tensor(img: np.ndarray) -> np.ndarray:
    """BGR bytes to normalised RGB planes."""
    return ((img[..., ::-1] / 255.0 - MEAN) / STD).transpose(2, 0, 1).astype(np.float32)


def _raster(data: bytes | None, height: int, width: int) -> np.ndarray | None:
    return None if data is None or len(data) != height * width * 3 else np.frombuffer(data, np.uint8).reshape(height, width, 3)


def slice_tiles(images: DataFrame, size: int) -> DataFrame:
    """(om, tile_x, tile_y, data) of rows (om, height, width, data): one raster at a time, never shuffled; unreadable ones give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                img = _raster(r.data, r.height, r.width)
                if img is None:
                    continue
                for y in range(0, r.height // size * size, size):
                    row = [(r.om, x, y, np.ascontiguousarray(img[y : y + size, x : x + size]).tobytes()) for x in range(0, r.width // size * size, size)]
                    yield pd.DataFrame(row, columns=["om", "tile_x", "tile_y", "data"])

    return images.select("om", "height", "width", "data").mapInPandas(run, "om long, tile_x int, tile_y int, data binary")


def crop_tiles(rows: DataFrame, size: int = 224) -> DataFrame:
    """(annotation_id, data) of rows (annotation_id, x1, y1, x2, y2, height, width, data): square crops, black where there is nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                window = None if pd.isna(r.x1) else (int(r.x1), int(r.y1), int(r.x2), int(r.y2))
                out.append(crop(_raster(r.data, r.height, r.width), window, size).tobytes())
            yield pd.DataFrame({"annotation_id": frame["annotation_id"], "data": out})

    return rows.select("annotation_id", "x1", "y1", "x2", "y2", "height", "width", "data").mapInPandas(run, "annotation_id long, data binary")
