"""Colour, intensity and sharpness statistics of decoded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake import fixed_values as fv

PIXEL_COLUMNS = fv.COLOR_FEATURES + ("mean_pixel_intensity", "std_pixel_intensity", "blur_score_laplacian")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images decoded by Spark: origin, height, width, nChannels and BGR bytes."""
    loaded = spark.read.format("image").option("dropInvalid", True).load(path)
    return loaded.select(*[F.col(f"image.{c}").alias(c) for c in ("origin", "height", "width", "nChannels", "data")])


def _hsv(bgr: np.ndarray) -> np.ndarray:
    """8-bit hue (0-179), saturation and value (0-255)."""
    blue, green, red = bgr[..., 0], bgr[..., 1], bgr[..., 2]
    value = bgr.max(axis=2)
    span = value - bgr.min(axis=2)
    safe = np.where(span > 0, span, 1.0)
    hue = np.where(
        value == red, (green - blue) / safe, np.where(value == green, 2.0 + (blue - red) / safe, 4.0 + (red - green) / safe)
    )
    hue = np.where(span > 0, np.mod(hue * 30.0, 180.0), 0.0)
    saturation = np.where(value > 0, 255.0 * span / np.where(value > 0, value, 1.0), 0.0)
    return np.stack([np.rint(hue) % 180, np.rint(saturation), value], axis=2)


def _lab(bgr: np.ndarray) -> np.ndarray:
    """8-bit CIE Lab under D65: lightness scaled to 255, a and b shifted by 128."""
    unit = bgr[..., ::-1] / 255.0
    linear = np.where(unit <= 0.04045, unit / 12.92, ((unit + 0.055) / 1.055) ** 2.4)
    to_xyz = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = linear @ to_xyz.T / np.array([0.950456, 1.0, 1.088754])
    root = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16.0 / 116.0)
    light = np.where(xyz[..., 1] > 0.008856, 116.0 * np.cbrt(xyz[..., 1]) - 16.0, 903.3 * xyz[..., 1])
    a, b = 500.0 * (root[..., 0] - root[..., 1]), 200.0 * (root[..., 1] - root[..., 2])
    return np.clip(np.rint(np.stack([light * 255.0 / 100.0, a + 128.0, b + 128.0], axis=2)), 0, 255)


def image_statistics(bgr: np.ndarray, mask: np.ndarray | None = None) -> dict[str, float | None]:
    """All statistics of one decoded image; contrasts need a mask with both kinds."""
    pixels = bgr.astype(float)
    hsv, lab = _hsv(pixels), _lab(pixels)
    out: dict[str, float | None] = dict.fromkeys(PIXEL_COLUMNS)
    planes = {"b": pixels[..., 0], "g": pixels[..., 1], "r": pixels[..., 2], "h": hsv[..., 0], "s": hsv[..., 1], "v": hsv[..., 2],
              "lab_l": lab[..., 0], "lab_a": lab[..., 1], "lab_b": lab[..., 2]}
    for name, plane in planes.items():
        out[f"roi_{name}_mean"], out[f"roi_{name}_std"] = float(plane.mean()), float(plane.std())
    blue, green, red = pixels[..., 0], pixels[..., 1], pixels[..., 2]
    rg, yb = red - green, 0.5 * (red + green) - blue
    out["colorfulness"] = float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()))
    gray = np.rint(0.114 * blue + 0.587 * green + 0.299 * red)
    out["mean_pixel_intensity"], out["std_pixel_intensity"] = float(gray.mean()), float(gray.std())
    framed = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    laplacian = framed[:-2, 1:-1] + framed[2:, 1:-1] + framed[1:-1, :-2] + framed[1:-1, 2:] - 4.0 * gray
    out["blur_score_laplacian"] = float(laplacian.var())
    if mask is not None and mask.any() and not mask.all():
        inside, outside = pixels[mask].mean(axis=0), pixels[~mask].mean(axis=0)
        out["particle_mask_mean_rgb_contrast"] = float(np.abs(inside - outside).mean())
        out["particle_mask_mean_v_contrast"] = float(abs(hsv[..., 2][mask].mean() - hsv[..., 2][~mask].mean()))
    return out


def image_pixel_stats(images: DataFrame, key: str = "origin", mask: str | None = None) -> DataFrame:
    """Statistics of every image row (key, height, width, nChannels, data[, mask]).

    One image at a time inside each task; an optional mask column holds one byte
    per pixel. Resizing is left to the caller.
    """
    columns = [key, "height", "width", "nChannels", "data"] + ([mask] if mask else [])

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                shape = (row["height"], row["width"], row["nChannels"])
                bgr = np.frombuffer(row["data"], dtype=np.uint8).reshape(shape)
                bgr = np.repeat(bgr, 3, axis=2) if shape[2] == 1 else bgr[..., :3]
                flags = row[mask] if mask else None
                chosen = None if flags is None else np.frombuffer(flags, dtype=np.uint8).reshape(shape[:2]) > 0
                rows.append({key: row[key], **image_statistics(bgr, chosen)})
            if rows:
                yield pd.DataFrame(rows)

    kind = dict(images.dtypes)[key]
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in PIXEL_COLUMNS)
    return images.select(*columns).mapInPandas(stats, schema)
