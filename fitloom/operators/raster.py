"""Raster work: perceptual hashes and subjects, in Arrow-backed batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, KEPT = 64, 16
_N = np.arange(SIDE)
#: The first KEPT rows of the cosine transform of SIDE points.
BASIS = np.cos(np.pi * (2 * _N[None, :] + 1) * np.arange(KEPT)[:, None] / (2 * SIDE))


def phash(pixels: np.ndarray) -> str:
    """256 bits in hexadecimal: low cosine coefficients of a 64 by 64 grey raster against their median."""
    low = np.round(BASIS @ pixels.reshape(SIDE, SIDE) @ BASIS.T, 6).reshape(-1)  # coefficients that are nothing stay so
    return np.packbits(low > np.median(low)).tobytes().hex()


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1 in the order of their first pixel."""
    h, w = mask.shape
    out = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        near = np.where(out == 0, big, out)
        for axis in (0, 1):
            for step in (1, -1):
                moved = np.roll(np.where(out == 0, big, out), step, axis)
                edge = [slice(None), slice(None)]
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = big
                near = np.minimum(near, moved)
        new = np.where(mask, near, 0)
        if (new == out).all():
            return np.searchsorted(np.unique(new[mask]), new) * mask + mask if mask.any() else new
        out = new


def measure(pixels: np.ndarray) -> tuple[int, int, float, float]:
    """(components, largest area, its fill of its box, the box's aspect) of what is brighter than the border's modal grey."""
    grid = pixels.reshape(SIDE, SIDE)
    border = np.concatenate([grid[0], grid[-1], grid[:, 0], grid[:, -1]])
    values, counts = np.unique(border.astype(int), return_counts=True)
    mask = np.abs(grid - values[counts.argmax()]) > 18
    found = label(mask)
    if not mask.any():
        return 0, 0, 0.0, 0.0
    sizes = np.bincount(found[mask])
    y, x = np.nonzero(found == sizes.argmax())
    h, w = int(np.ptp(y)) + 1, int(np.ptp(x)) + 1
    return int(found.max()), int(sizes.max()), round(float(sizes.max() / (h * w)), 6), round(w / h, 6)


def drawn(vectors: DataFrame) -> DataFrame:
    """(id, pixels): a vector of 64 numbers as an outer product, in greys of 0 to 255."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            pixels = []
            for v in rows["embedding"]:
                a = np.asarray(v, float)
                grid = np.outer(a, a)
                span = np.ptp(grid) or 1.0
                pixels.append(np.round((grid - grid.min()) / span * 255).astype(np.uint8).tobytes())
            yield pd.DataFrame({"id": rows["vec_id"], "pixels": pixels})

    return vectors.where(F.size("embedding") == SIDE).mapInPandas(run, "id long, pixels binary")


def hashes(rasters: DataFrame) -> DataFrame:
    """(id, phash)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"id": rows["id"], "phash": [phash(np.frombuffer(p, np.uint8).astype(float)) for p in rows["pixels"]]})

    return rasters.mapInPandas(run, "id long, phash string")


def subjects(rasters: DataFrame) -> DataFrame:
    """(id, n_components, area, fill, aspect)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [measure(np.frombuffer(p, np.uint8).astype(float)) for p in rows["pixels"]]
            yield pd.DataFrame(got, columns=["n_components", "area", "fill", "aspect"]).assign(id=rows["id"].to_numpy())[["id", "n_components", "area", "fill", "aspect"]]

    return rasters.mapInPandas(run, "id long, n_components long, area long, fill double, aspect double")
