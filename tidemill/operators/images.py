"""Perceptual prints of images, as Arrow UDFs over Spark's image source (BGR rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triangle(n_in: int, n_out: int) -> np.ndarray:
    """Weights of a triangle filter that resamples n_in to n_out places."""
    scale = n_in / n_out
    support = max(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) * scale
    w = np.maximum(0.0, 1 - np.abs(np.arange(n_in)[None, :] + 0.5 - centre[:, None]) / support)
    return w / w.sum(1, keepdims=True)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """x: height x width (x channels)."""
    rows = np.tensordot(triangle(x.shape[0], height), x.astype(float), axes=(1, 0))
    return np.moveaxis(np.tensordot(triangle(x.shape[1], width), rows, axes=(1, 1)), 0, 1)


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, 2) if channels == 1 else x[:, :, 2::-1][:, :, :3]


def dhash(rgb: np.ndarray) -> int:
    """64 bits: is a place brighter than its right neighbour, on 9 x 8 grey values, first bit highest."""
    grey = resized(rgb @ np.array([0.2126, 0.7152, 0.0722]), 8, 9)
    bits = (grey[:, :-1] > grey[:, 1:]).reshape(-1)
    h = int("".join("1" if b else "0" for b in bits), 2)
    return h - (1 << 64) if h >> 63 else h


def prints(images: DataFrame, side: int = 64) -> DataFrame:
    """origin, sig, v (side x side RGB in [0, 1]), width, height; null prints where an image can't be decoded."""

    def one(h, w, c, data):
        if not data or h <= 0 or w <= 0 or c not in (1, 3, 4):
            return None
        x = pixels(h, w, c, bytes(data))
        return dhash(x), [float(v) for v in (resized(x, side, side) / 255).reshape(-1)]

    f = F.udf(one, "struct<sig: long, v: array<float>>")
    i = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    p = i.select("origin", "width", "height", f("height", "width", "nChannels", "data").alias("p"))
    return p.select("origin", F.col("p.sig").alias("sig"), F.col("p.v").alias("v"), "width", "height")


def unreadable(printed: DataFrame) -> DataFrame:
    return printed.agg(F.count("*").alias("images"), F.count_if(F.col("sig").isNull()).alias("unreadable"))
