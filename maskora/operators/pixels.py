"""Pixel operators on planes ``(doc_id, width, height, channels, pixels)``, one image a row, numpy within.

Kernels keep the 8-bit rounding of canvas code: a half is added and the rest cut off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a plane that are worked on at a time, so that they stay in the cache.
_BAND = 32
PLANES = "doc_id long, width int, height int, channels int, pixels binary"


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def luminance(rgba: np.ndarray) -> np.ndarray:
    return _byte(rgba[..., 0] * 0.299 + rgba[..., 1] * 0.587 + rgba[..., 2] * 0.114)


def median3(gray: np.ndarray) -> np.ndarray:
    """3 x 3 median; the border stays."""
    out = gray.copy()
    if min(gray.shape) >= 3:
        out[1:-1, 1:-1] = np.median(np.lib.stride_tricks.sliding_window_view(gray, (3, 3)), axis=(2, 3)).astype(np.uint8)
    return out


def gaussian(gray: np.ndarray, sigma: float = 1.2) -> np.ndarray:
    """Separable blur of radius ceil(2.2 sigma) with weights in single precision, edges repeated, 8 bits between the passes."""
    r = max(1, int(np.ceil(sigma * 2.2)))
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    weights = (weights.astype(np.float32) / weights.sum()).astype(np.float32).astype(np.float64)

    def blurred(a: np.ndarray, axis: int) -> np.ndarray:
        out = np.empty_like(a)
        padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(2)], "edge")
        for y in range(0, a.shape[0], _BAND):
            rows = min(_BAND, a.shape[0] - y)
            total = np.zeros((rows, a.shape[1]))
            term = np.empty_like(total)
            for i, k in enumerate(weights):
                total += np.multiply(padded[y + i : y + i + rows] if axis == 0 else padded[y : y + rows, i : i + a.shape[1]], k, out=term)
            total += 0.5
            out[y : y + rows] = total
        return out

    return blurred(blurred(gray, 1), 0)


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    """Mean of the window of radius ``r`` inside the image, by an integral image."""
    h, w = a.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = a.astype(np.float64).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    s = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return s / ((y1 - y0)[:, None] * (x1 - x0)[None])


def guided(gray: np.ndarray, r: int = 4, eps: float = 80.0) -> np.ndarray:
    """Edge-keeping smoothing with the image as its own guide."""
    g = gray.astype(np.float64)
    mean = box_mean(g, r)
    variance = box_mean(g * g, r) - mean * mean
    a = variance / (variance + eps)
    return _byte(box_mean(a, r) * g + box_mean(mean - a * mean, r))


def unsharp(gray: np.ndarray, amount: float = 0.6, sigma: float = 1.0) -> np.ndarray:
    return _byte(gray + amount * (gray.astype(np.float64) - gaussian(gray, sigma)))


def invert(gray: np.ndarray) -> np.ndarray:
    return 255 - gray


def clahe(gray: np.ndarray, tiles: int = 8, clip: float = 2.4) -> np.ndarray:
    """Equalisation by tiles of eight pixels at least, with clipped histograms; the tables of four tiles are blended.

    Counts are in single precision and tables in whole numbers, cut off; a pixel's place among the tiles is its
    coordinate over the tile's size, so a tile's own table holds at its first pixel.
    """
    h, w = gray.shape
    th, tw = max(8, -(-h // tiles)), max(8, -(-w // tiles))
    ny, nx = -(-h // th), -(-w // tw)
    tile = (np.arange(h) // th * nx)[:, None] + np.arange(w) // tw
    counts = np.bincount((tile * 256 + gray).ravel(), minlength=ny * nx * 256).reshape(ny * nx, 256).astype(np.float64)
    size = counts.sum(1, keepdims=True)
    top = np.maximum(1.0, clip * size / 256)
    spread = np.maximum(counts - top, 0).sum(1, keepdims=True) / 256
    counts = np.minimum(counts, top).astype(np.float32).astype(np.float64)
    counts = (counts + spread).astype(np.float32).astype(np.float64)
    tables = np.clip(counts.cumsum(1) * (255 / np.maximum(1, size)), 0, 255).astype(np.uint8)

    def places(n: int, size: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(last - 1, np.arange(n) / size)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(last - 1, low + 1), at - low

    y0, y1, fy = places(h, th, ny)
    x0, x1, fx = places(w, tw, nx)
    out = np.empty_like(gray)
    for y in range(0, h, th):  # a band of rows between two rows of tiles
        band, rows = slice(y, y + th), gray[y : y + th].astype(np.int64)

        def across(row: int, rows=rows) -> np.ndarray:
            left, right = tables.ravel()[rows + ((row * nx + x0) * 256)], tables.ravel()[rows + ((row * nx + x1) * 256)]
            return left * (1 - fx) + right * fx

        f = fy[band][:, None]
        out[band] = (across(y0[y]) * (1 - f) + across(y1[y]) * f + 0.5).astype(np.uint8)
    return out


def bradley(gray: np.ndarray, t: float = 0.12, window: int | None = None, dark_text: bool = True) -> np.ndarray:
    """Text where a pixel is darker than its window's mean by more than the share ``t``; the window is about 3.5 % of the short side."""
    side = max(15, min(65, int(np.floor(min(gray.shape) * 0.035 + 0.5)) | 1)) if window is None else window | 1
    text = gray < box_mean(gray, side // 2) * (1 - t)
    return np.where(text == dark_text, 0, 255).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The threshold that parts the histogram with the largest variance between its parts."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below, sums = counts.cumsum(), (counts * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def skew_angle(gray: np.ndarray) -> float:
    """The rotation in degrees, of -18 to 18 in steps of 1 and then 0.1, whose row profile varies most."""
    dark = np.argwhere(gray <= otsu(gray)) if gray.min() < gray.max() else np.zeros((0, 2))
    if len(dark) < 8:
        return 0.0
    y, x = dark[:, 0] - gray.shape[0] / 2, dark[:, 1] - gray.shape[1] / 2

    def sharpness(angle: float) -> float:
        a = np.radians(angle)
        rows = np.round(y * np.cos(a) - x * np.sin(a)).astype(int)
        return float(np.var(np.bincount(rows - rows.min())))

    coarse = max(range(-18, 19), key=lambda a: (sharpness(a), -abs(a)))
    return round(max((coarse + k / 10 for k in range(-16, 17)), key=lambda a: (sharpness(a), -abs(a))), 1)


def homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray:
    """The 3 x 3 map that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def warp(image: np.ndarray, quad: list[tuple[float, float]], width: int, height: int, outside=(11, 13, 18)) -> np.ndarray:
    """The quadrangle of an image straightened to a rectangle, bilinear; what lies outside has one colour."""
    m = homography([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], quad)
    v, u = np.mgrid[0:height, 0:width]
    p = m @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)])
    x, y = p[0] / p[2], p[1] / p[2]
    h, w = image.shape[:2]
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x0, y0 = np.clip(np.floor(x).astype(int), 0, max(0, w - 2)), np.clip(np.floor(y).astype(int), 0, max(0, h - 2))
    fx, fy = (x - x0)[:, None], (y - y0)[:, None]
    px = image.reshape(h, w, -1)[..., :3].astype(np.float64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    mixed = (px[y0, x0] * (1 - fx) + px[y0, x1] * fx) * (1 - fy) + (px[y1, x0] * (1 - fx) + px[y1, x1] * fx) * fy
    fill = np.array(outside[: px.shape[2]], float)
    return np.where(inside[:, None], _byte(mixed), fill).astype(np.uint8).reshape(height, width, -1)


def mask(rgba: np.ndarray, rects: list[tuple[float, ...]], style: str = "blackout", export: bool = False) -> np.ndarray:
    """Rectangles blacked or whited out, or as a mosaic or blur, which an export turns into black.

    A fifth value turns a rectangle about its middle by so many degrees, if by more than 0.1; every pixel that it
    touches is masked.
    """
    out = rgba.copy()
    h, w = out.shape[:2]
    for x, y, rw, rh, *turn in rects:
        inside = None
        if turn and abs(turn[0]) > 0.1 and rw > 0 and rh > 0:
            cos, sin = np.cos(np.radians(turn[0])), np.sin(np.radians(turn[0]))
            cx, cy, half_w, half_h = x + rw / 2, y + rh / 2, rw / 2, rh / 2
            x, y = cx - half_w * abs(cos) - half_h * abs(sin), cy - half_w * abs(sin) - half_h * abs(cos)
            rw, rh = 2 * (cx - x), 2 * (cy - y)
            px, py = np.arange(w)[None] + 0.5 - cx, np.arange(h)[:, None] + 0.5 - cy
            edge = (abs(cos) + abs(sin)) / 2
            inside = (abs(px * cos + py * sin) < half_w + edge) & (abs(py * cos - px * sin) < half_h + edge)
        a, b, c, d = max(0, int(np.floor(y))), min(h, int(np.ceil(y + rh))), max(0, int(np.floor(x))), min(w, int(np.ceil(x + rw)))
        if a >= b or c >= d:
            continue
        part = out[a:b, c:d, :3]
        kept = part.copy()
        if style == "whiteout":
            part[:] = 255
        elif style == "mosaic" and not export:
            n = max(4, min(b - a, d - c) // 4)
            for i in range(0, b - a, n):
                for j in range(0, d - c, n):
                    part[i : i + n, j : j + n] = _byte(part[i : i + n, j : j + n].reshape(-1, 3).mean(0))
        elif style == "blur" and not export:
            for k in range(3):
                part[..., k] = _byte(box_mean(part[..., k], 14))
        else:
            part[:] = 0
        if inside is not None:
            part[~inside[a:b, c:d]] = kept[~inside[a:b, c:d]]
    return out


def each_plane(planes: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A kernel on each gray plane (RGBA planes are reduced to gray first), a batch of rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                a = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels)
                gray = a[..., 0] if r.channels == 1 else luminance(a)
                made = kernel(gray)
                out.append((r.doc_id, made.shape[1], made.shape[0], 1, made.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "width", "height", "channels", "pixels"])

    return planes.select("doc_id", "width", "height", "channels", "pixels").mapInPandas(run, PLANES)


def skew_angles(planes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(r.doc_id, skew_angle(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width))) for r in rows.itertuples(index=False)], columns=["doc_id", "angle"])

    return planes.select("doc_id", "width", "height", "pixels").mapInPandas(run, "doc_id long, angle double")


def masked_planes(planes: DataFrame, boxes: DataFrame, style: str = "blackout", export: bool = True) -> DataFrame:
    """Images with their enabled boxes masked, turned where they have a ``rotation``; an image without boxes passes unchanged."""
    from pyspark.sql import functions as F

    turn = F.coalesce(F.col("rotation").cast("double"), F.lit(0.0)) if "rotation" in boxes.columns else F.lit(0.0)
    rects = boxes.filter("enabled").groupBy("doc_id").agg(F.collect_list(F.array("x", "y", "w", "h", turn)).alias("rects"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                a = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels)
                out.append((r.doc_id, r.width, r.height, r.channels, mask(a, [] if r.rects is None else [tuple(x) for x in r.rects], style, export).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "width", "height", "channels", "pixels"])

    return planes.join(rects, "doc_id", "left").select("doc_id", "width", "height", "channels", "pixels", "rects").mapInPandas(run, PLANES)
