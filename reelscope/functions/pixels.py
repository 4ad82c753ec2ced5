"""Frame preparation: area resize and conversion of 8-bit blue, green, red to hue (0 to 179), saturation and value (0 to 255)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Side of the image that frames are compared by.
SIDE = 128


def _shares(n: int, out: int) -> np.ndarray:
    """out rows of n weights: how much of each of n cells lies in each of out equal parts, over the part's size."""
    edges = np.linspace(0, n, out + 1)
    cells = np.arange(n)
    low, high = edges[:-1, None], edges[1:, None]
    return np.clip(np.minimum(cells + 1, high) - np.maximum(cells, low), 0, None) / (high - low)


def resized(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A height by width by channels image of 8 bits as side by side, each pixel the mean of the area that it covers, rounded half to even.

    Where the image is smaller than that, a pixel lies within one or two of the old ones and is their mean by area.
    """
    rows, columns = _shares(image.shape[0], side), _shares(image.shape[1], side)
    made = np.einsum("ih,hwc,jw->ijc", rows, image.astype(np.float64), columns, optimize=True)
    return np.clip(np.rint(np.round(made, 9)), 0, 255).astype(np.uint8)


def hue_saturation_value(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three planes of a blue, green, red image of 8 bits; halves are rounded up. A grey pixel has hue and saturation 0."""
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    top = np.maximum(np.maximum(b, g), r)
    spread = top - np.minimum(np.minimum(b, g), r)
    safe = np.maximum(spread, 1)
    turn = np.where(top == r, g - b, np.where(top == g, b - r + 2 * spread, r - g + 4 * spread))
    # half a turn is 180 steps of two degrees: 30 steps for each sixth
    hue = np.where(spread == 0, 0, (60 * turn + safe) // (2 * safe))
    return np.where(hue < 0, hue + 180, hue) % 180, np.where(top == 0, 0, (510 * spread + top) // (2 * np.maximum(top, 1))), top


def prepared(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value of a blue, green, red frame of any size at SIDE by SIDE."""
    return hue_saturation_value(resized(image))


def hsv(b: Column, g: Column, r: Column) -> Column:
    """The same conversion of one pixel as a struct h, s, v of int."""
    top = F.greatest(b, g, r)
    spread = top - F.least(b, g, r)
    safe = F.greatest(spread, F.lit(1))
    turn = F.when(top == r, g - b).when(top == g, b - r + 2 * spread).otherwise(r - g + 4 * spread)
    hue = F.when(spread == 0, 0).otherwise(F.floor((60 * turn + safe) / (2 * safe)))
    saturation = F.when(top == 0, 0).otherwise(F.floor((510 * spread + top) / (2 * F.greatest(top, F.lit(1)))))
    return F.struct(F.pmod(hue, F.lit(180)).cast("int").alias("h"), saturation.cast("int").alias("s"), top.cast("int").alias("v"))
