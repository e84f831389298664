"""Preparation of images for recognition and for vision models.

Sizes and angles are expressions. Pixels are handled with numpy in Arrow batches: grey images are arrays of rows (width,
height, bytes), and codecs for files are optional.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirion.providers import MissingProvider

# Resolution, contrast, thresholds, and the defaults of the vision encoder.
TARGET_DPI, CONTRAST, THRESHOLD = 300, 1.5, 128
LEAST_ANGLE, LEAST_PIXELS = 0.5, 10
VISION_SIZE, JPEG_QUALITY = (1024, 1024), 55


def dpi_size(width: Column, height: Column, dpi: Column) -> Column:
    """Size at the target resolution; unchanged where the resolution is unknown or right already."""
    scaled = lambda n: (n * (F.lit(float(TARGET_DPI)) / dpi)).cast("int")
    same = (dpi <= 0) | (dpi == TARGET_DPI)
    return F.struct(F.when(same, width).otherwise(scaled(width)).alias("width"), F.when(same, height).otherwise(scaled(height)).alias("height"))


def vision_size(width: Column, height: Column, most: tuple[int, int] = VISION_SIZE) -> Column:
    """The largest size of the same shape that fits, never larger than the image."""
    ratio = F.least(F.lit(float(most[0])) / width, F.lit(float(most[1])) / height)
    fits = (width <= most[0]) & (height <= most[1])
    scaled = lambda n: F.when(fits, n).otherwise((n * ratio).cast("int"))
    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"))


def skew_correction(angle: Column, pixels: Column) -> Column:
    """The turn that straightens a page, from the angle of the rectangle around its dark pixels; 0 for none."""
    few = (pixels < LEAST_PIXELS) | (F.abs(F.when(angle < -45, -(angle + 90)).otherwise(-angle)) < LEAST_ANGLE)
    return F.when(few, 0.0).when(angle < -45, -(angle + 90)).otherwise(-angle)


def thresholded(pixels: Column, at: int = THRESHOLD) -> Column:
    """Grey values as black or white."""
    return F.transform(pixels, lambda p: F.when(p > at, 255).otherwise(0))


def otsu_threshold(grey: np.ndarray) -> int:
    """The value that splits the histogram with the largest variance between its parts."""
    counts = np.bincount(grey.ravel(), minlength=256).astype(float)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def contrasted(grey: np.ndarray, factor: float = CONTRAST) -> np.ndarray:
    """Values moved away from the mean by a factor."""
    mean = int(grey.mean() + 0.5)
    return np.clip(mean + factor * (grey.astype(float) - mean), 0, 255).astype(np.uint8)


def _around(grey: np.ndarray) -> np.ndarray:
    """The nine values around each pixel, edges repeated."""
    padded = np.pad(grey, 1, mode="edge")
    h, w = grey.shape
    return np.stack([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def opened(grey: np.ndarray) -> np.ndarray:
    """Erosion and then dilation over 3 by 3 pixels."""
    return _around(_around(grey).min(axis=0)).max(axis=0)


def median_filtered(grey: np.ndarray) -> np.ndarray:
    """Median over 3 by 3 pixels."""
    return np.sort(_around(grey), axis=0)[4]


def dark_angle(grey: np.ndarray) -> tuple[float, int]:
    """Angle in degrees (-90 to 0) of the smallest rectangle around the dark pixels, and their number."""
    ys, xs = np.nonzero(grey < THRESHOLD)
    if len(xs) < LEAST_PIXELS:
        return 0.0, len(xs)
    points = np.stack([xs, ys], axis=1).astype(float)
    angles = np.deg2rad(np.arange(-90, 0, 0.25))
    turn = np.stack([np.cos(angles), np.sin(angles)])
    along, across = points @ turn, points @ np.stack([-turn[1], turn[0]])
    area = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    return float(np.rad2deg(angles[area.argmin()])), len(xs)


def turned(grey: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its centre, nearest pixels, edges repeated."""
    h, w = grey.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    cx, cy = w // 2, h // 2
    sx = np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx
    sy = np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
    return grey[np.clip(np.rint(sy), 0, h - 1).astype(int), np.clip(np.rint(sx), 0, w - 1).astype(int)]


def deskewed(grey: np.ndarray) -> np.ndarray:
    angle, pixels = dark_angle(grey)
    turn = -(90 + angle) if angle < -45 else -angle
    return grey if pixels < LEAST_PIXELS or abs(turn) < LEAST_ANGLE else turned(grey, turn)


def resized(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest pixels at another size."""
    h, w = grey.shape
    return grey[(np.arange(height) * h // max(height, 1))[:, None], (np.arange(width) * w // max(width, 1))[None, :]]


def prepared(images: DataFrame, dpi: int = 72, full: bool = True) -> DataFrame:
    """Grey images (``width``, ``height``, ``pixels`` BINARY) ready for recognition, in one pass over Arrow batches.

    Resolution and contrast first; then, in full, deskewing, opening and Otsu's threshold, else the fixed threshold.
    """
    scale = 1.0 if dpi <= 0 or dpi == TARGET_DPI else TARGET_DPI / dpi

    def one(w: int, h: int, pixels: bytes) -> tuple[int, int, bytes]:
        grey = np.frombuffer(pixels, np.uint8).reshape(h, w)
        grey = contrasted(resized(grey, int(w * scale), int(h * scale)) if scale != 1 else grey)
        if full:
            grey = opened(deskewed(grey))
            grey = np.where(grey > otsu_threshold(grey), 255, 0).astype(np.uint8)
        else:
            grey = np.where(median_filtered(grey) > THRESHOLD, 255, 0).astype(np.uint8)
        return grey.shape[1], grey.shape[0], grey.tobytes()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [one(w, h, bytes(p)) for w, h, p in zip(part["width"], part["height"], part["pixels"], strict=True)]
            yield part.assign(width=[m[0] for m in made], height=[m[1] for m in made], pixels=[m[2] for m in made])

    return images.mapInPandas(run, images.schema)


def jpeg(image: bytes, most: tuple[int, int] = VISION_SIZE, quality: int = JPEG_QUALITY) -> bytes:
    """A JPEG of an image file within a size. Needs an imaging library, which is optional."""
    try:
        from PIL import Image
    except ImportError as error:
        raise MissingProvider("JPEG encoding needs an imaging library") from error
    import io

    picture = Image.open(io.BytesIO(image)).convert("RGB")
    ratio = min(most[0] / picture.width, most[1] / picture.height)
    if ratio < 1:  # sizes are cut to whole pixels, as in vision_size
        picture = picture.resize((int(picture.width * ratio), int(picture.height * ratio)), Image.Resampling.LANCZOS)
    out = io.BytesIO()
    picture.save(out, "JPEG", quality=quality, optimize=True)
    return out.getvalue()
