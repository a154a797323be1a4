"""Pictures as arrays of grey values: statistics for routing, preprocessing for recognition, a PNG codec."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STATISTICS = "width double, height double, mean double, std double, minimum double, maximum double, dynamic_range double, dark_ratio double, laplacian_var double"
#: Longest side that is looked at, and the grey below which a pixel is dark.
LONGEST, DARK = 400, 80


def grey(pixels: np.ndarray) -> np.ndarray:
    """One plane of bytes from grey, RGB or RGBA values (luma of ITU-R 601)."""
    if pixels.ndim == 2:
        return pixels.astype(np.uint8)
    r, g, b = (pixels[..., k].astype(np.float64) for k in range(3))
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.uint8)


def smaller(plane: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """At most ``longest`` pixels a side, by the means of equal cells; smaller pictures stay."""
    h, w = plane.shape
    k = -(-max(h, w) // longest)
    if k <= 1:
        return plane
    padded = np.pad(plane.astype(np.float64), ((0, -h % k), (0, -w % k)), mode="edge")
    return np.floor(padded.reshape(padded.shape[0] // k, k, -1, k).mean(axis=(1, 3)) + 0.5).astype(np.uint8)


def laplacian(plane: np.ndarray) -> np.ndarray:
    """Four neighbours less four times the pixel; at the borders the picture is mirrored without its edge."""
    p = np.pad(plane.astype(np.float64), 1, mode="reflect" if min(plane.shape) > 1 else "edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def statistics(pixels: np.ndarray) -> dict[str, float]:
    """What routing looks at: size, mean, population deviation, range, share of dark pixels, variance of the Laplacian."""
    plane = smaller(grey(pixels))
    values = plane.astype(np.float64)
    low, high = float(values.min()), float(values.max())
    return {
        "width": float(pixels.shape[1]), "height": float(pixels.shape[0]), "mean": float(values.mean()), "std": float(values.std()), "minimum": low, "maximum": high,
        "dynamic_range": high - low, "dark_ratio": float((plane < DARK).mean()), "laplacian_var": float(laplacian(plane).var()),
    }


def image_statistics(pixels: Column, width: Column) -> Column:
    """``statistics`` of grey pictures given as bytes, row by row, and their width; null for what is no picture."""

    @F.pandas_udf(STATISTICS)
    def run(data: pd.Series, widths: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in STATISTICS.split(", ")]
        rows = [
            statistics(np.frombuffer(d, dtype=np.uint8).reshape(-1, int(w))) if d is not None and len(d) and w == w and w and len(d) % int(w) == 0 else dict.fromkeys(names)
            for d, w in zip(data, widths, strict=True)
        ]
        return pd.DataFrame(rows, columns=names).astype("float64")

    return run(pixels, width)


def otsu(plane: np.ndarray) -> int:
    """The grey that parts dark from light with the largest variance between both."""
    n = np.bincount(plane.reshape(-1), minlength=256).astype(np.float64)
    below, total = np.cumsum(n), n.sum()
    sums = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * below / total - sums) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def stretch(plane: np.ndarray, cut: float = 0.005) -> np.ndarray:
    """The greys between two quantiles over the whole range."""
    low, high = np.quantile(plane, [cut, 1 - cut])
    if high <= low:
        return plane
    return np.clip(np.round((plane.astype(np.float64) - low) * 255 / (high - low)), 0, 255).astype(np.uint8)


def denoise(plane: np.ndarray) -> np.ndarray:
    """The median of each pixel and its eight neighbours."""
    p = np.pad(plane, 1, mode="edge")
    around = np.stack([p[i : i + plane.shape[0], j : j + plane.shape[1]] for i in range(3) for j in range(3)])
    return np.median(around, axis=0).astype(np.uint8)


def skew(plane: np.ndarray, most: float = 15.0, step: float = 0.5) -> float:
    """Degrees by which lines of ink are turned: the turn at which the rows' amounts of ink differ most."""
    y, x = np.nonzero(plane <= otsu(plane))
    if len(x) < 100:
        return 0.0
    best, angle = -1.0, 0.0
    for a in np.arange(-most, most + step, step):
        rows = np.round(y - x * np.tan(np.radians(a))).astype(np.int64)
        spread = float(np.bincount(rows - rows.min()).astype(np.float64).var())
        if spread > best + 1e-9 or spread > best - 1e-9 and abs(a) < abs(angle):
            best, angle = spread, float(a)
    return angle


def deskew(plane: np.ndarray, least: float = 0.5) -> np.ndarray:
    """The picture turned back by its skew, if that is ``least`` degrees or more; nearest pixels, edges repeated."""
    angle = skew(plane)
    if abs(angle) < least:
        return plane
    h, w = plane.shape
    y, x = np.mgrid[:h, :w]
    cy, cx, t = (h - 1) / 2, (w - 1) / 2, np.radians(angle)
    sx = np.cos(t) * (x - cx) - np.sin(t) * (y - cy) + cx
    sy = np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy
    return plane[np.clip(np.round(sy), 0, h - 1).astype(int), np.clip(np.round(sx), 0, w - 1).astype(int)]


def preprocess(pixels: np.ndarray, tier: str | None = "light") -> np.ndarray:
    """For recognition: "skip" leaves the picture as it is, "light" stretches its greys and turns it upright, "heavy"
    takes noise away, parts ink from paper and turns it upright."""
    plane = grey(pixels)
    if tier == "skip":
        return plane
    if tier == "heavy":
        plane = denoise(plane)
        return deskew(np.where(plane <= otsu(plane), 0, 255).astype(np.uint8))
    if plane.min() > 25 or plane.max() < 230:
        plane = stretch(plane)
    return deskew(plane)


def write_png(pixels: np.ndarray) -> bytes:
    """Grey or RGB bytes as a PNG file."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[i].astype(np.uint8).tobytes() for i in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The bytes of a PNG file of 8 bits a channel without interlace; others raise ``ValueError``."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        raise ValueError("no PNG file")
    at, body, palette = 8, b"", None
    width = height = depth = kind = lace = 0
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part, dtype=np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += part
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth != 8 or lace or channels is None or not width or not height:
        raise ValueError("a PNG file of another form")
    rows = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + width * channels)
    out, before = np.zeros((height, width * channels), dtype=np.uint8), np.zeros(width * channels, dtype=np.uint8)
    for i, row in enumerate(rows):
        form, line = row[0], row[1:].copy()
        if form == 2:
            line += before
        elif form == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0, dtype=np.uint8).reshape(-1)
        elif form in (3, 4):
            for k in range(len(line)):
                a = int(line[k - channels]) if k >= channels else 0
                b, c = int(before[k]), int(before[k - channels]) if k >= channels else 0
                if form == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[k] = (int(line[k]) + guess) & 255
        elif form:
            raise ValueError("an unknown filter")
        out[i] = before = line
    if palette is not None:
        return palette[out]
    pixels = out.reshape(height, width, channels)
    return pixels[..., 0] if channels <= 2 else pixels[..., :3]
