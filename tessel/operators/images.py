"""Gray images: one row holds an image as width, height and pixels (array<float> or array<double>, row by row).

A filter sees one image at a time, in numpy over Arrow batches, so there is no shuffle and the work spreads with the
rows. Beyond the border the nearest pixel counts. Integral images of pixel tables (image, y, x, value) are windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.runtime import ship_package

Image = np.ndarray
_RISE, _SOBEL, _SCHARR = (-1.0, 0.0, 1.0), (1.0, 2.0, 1.0), (3.0, 10.0, 3.0)


def _around(img: Image, ry: int, rx: int) -> Image:
    """View [y, x, dy, dx] of the (2 ry + 1) x (2 rx + 1) pixels around each."""
    padded = np.pad(img, ((ry, ry), (rx, rx)), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * ry + 1, 2 * rx + 1))


def convolve(img: Image, kernel: Image) -> Image:
    """Correlation with a kernel of odd sides."""
    kernel = np.asarray(kernel, dtype=np.float64)
    if kernel.ndim != 2 or not (kernel.shape[0] % 2 and kernel.shape[1] % 2):
        raise ValueError("a kernel has two odd sides")
    return np.einsum("yxij,ij->yx", _around(img, kernel.shape[0] // 2, kernel.shape[1] // 2), kernel)


def separable(img: Image, across: tuple[float, ...], down: tuple[float, ...]) -> Image:
    return convolve(convolve(img, np.array([across])), np.array([down]).T)


def gaussian_weights(sigma: float) -> tuple[float, ...]:
    """Weights out to 3 sigma, with sum 1."""
    r = int(np.ceil(3 * sigma))
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return tuple((w / w.sum()).tolist())


def gaussian(img: Image, sigma: float) -> Image:
    w = gaussian_weights(sigma)
    return separable(img, w, w)


def box(img: Image, radius: int) -> Image:
    w = (1 / (2 * radius + 1),) * (2 * radius + 1)
    return separable(img, w, w)


def median(img: Image, radius: int) -> Image:
    side = (2 * radius + 1) ** 2
    return np.median(_around(img, radius, radius).reshape(*img.shape, side), axis=2)


def sobel_x(img: Image) -> Image:
    return separable(img, _RISE, _SOBEL)


def sobel_y(img: Image) -> Image:
    return separable(img, _SOBEL, _RISE)


def scharr_x(img: Image) -> Image:
    return separable(img, _RISE, _SCHARR)


def scharr_y(img: Image) -> Image:
    return separable(img, _SCHARR, _RISE)


def gradient_magnitude(img: Image) -> Image:
    return np.hypot(sobel_x(img), sobel_y(img))


def gradient_direction(img: Image) -> Image:
    return np.arctan2(sobel_y(img), sobel_x(img))


def element(shape: str, size: int) -> Image:
    """Mask of a structuring element of odd size: rect, cross or ellipse."""
    d = np.abs(np.arange(size) - size // 2)
    if shape == "rect":
        return np.ones((size, size), dtype=bool)
    if shape == "cross":
        return (d[:, None] == 0) | (d[None] == 0)
    if shape == "ellipse":
        return d[:, None] ** 2 + d[None] ** 2 <= (size // 2 + 0.5) ** 2
    raise ValueError(f"no shape {shape}")


def _under(img: Image, shape: str, size: int) -> Image:
    return _around(img, size // 2, size // 2)[:, :, element(shape, size)]


def erode(img: Image, shape: str = "rect", size: int = 3) -> Image:
    return _under(img, shape, size).min(axis=2)


def dilate(img: Image, shape: str = "rect", size: int = 3) -> Image:
    return _under(img, shape, size).max(axis=2)


def opening(img: Image, shape: str = "rect", size: int = 3) -> Image:
    return dilate(erode(img, shape, size), shape, size)


def closing(img: Image, shape: str = "rect", size: int = 3) -> Image:
    return erode(dilate(img, shape, size), shape, size)


def morphological_gradient(img: Image, shape: str = "rect", size: int = 3) -> Image:
    return dilate(img, shape, size) - erode(img, shape, size)


def top_hat(img: Image, shape: str = "rect", size: int = 3) -> Image:
    return img - opening(img, shape, size)


def black_hat(img: Image, shape: str = "rect", size: int = 3) -> Image:
    return closing(img, shape, size) - img


def filtered(images: DataFrame, f: Callable[..., Image], **parameters) -> DataFrame:
    """images with f's pixels; a null or empty image stays, one whose pixels don't fill its sides raises."""
    ship_package(images.sparkSession)

    def run(parts: Iterator) -> Iterator:
        for pdf in parts:
            out = []
            for w, h, p in zip(pdf["width"], pdf["height"], pdf["pixels"], strict=True):
                out.append(p if p is None or not len(p) else f(np.asarray(p, dtype=np.float64).reshape(int(h), int(w)), **parameters).reshape(-1))
            yield pdf.assign(pixels=out)

    return images.mapInPandas(run, images.schema)


def components(images: DataFrame, key: str, eight: bool = False) -> DataFrame:
    """(key, component, area, x0, y0, x1, y1, cx, cy) of each connected region of non-zero pixels; numbered from 1 in the
    order in which rows of pixels meet them."""
    ship_package(images.sparkSession)
    kind = dict(images.dtypes)[key]

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            rows = []
            for k, w, h, p in zip(pdf[key], pdf["width"], pdf["height"], pdf["pixels"], strict=True):
                if p is None or not len(p):
                    continue
                label = regions(np.asarray(p).reshape(int(h), int(w)) != 0, eight)
                for c in range(1, label.max() + 1):
                    y, x = np.nonzero(label == c)
                    rows.append((k, c, len(x), x.min(), y.min(), x.max(), y.max(), x.mean(), y.mean()))
            yield pd.DataFrame(rows, columns=[key, "component", "area", "x0", "y0", "x1", "y1", "cx", "cy"])

    return images.select(key, "width", "height", "pixels").mapInPandas(run, f"`{key}` {kind}, component int, area long, x0 int, y0 int, x1 int, y1 int, cx double, cy double")


def regions(mask: Image, eight: bool = False) -> Image:
    """Numbers of connected regions (0: background): each pixel takes the least number around it until none changes."""
    most = mask.size + 1
    now = np.where(mask, np.arange(1, most).reshape(mask.shape), most)
    near = element("rect" if eight else "cross", 3)
    while True:
        after = np.where(mask, _around(now, 1, 1)[:, :, near].min(axis=2), most)
        after = np.where(mask, np.append(np.arange(1, most), most)[after - 1], most)
        flat = np.append(after.reshape(-1), most)
        after = np.where(mask, np.minimum(after, flat[after - 1]), most)
        if (after == now).all():
            break
        now = after
    numbers = np.unique(now[mask])
    return np.where(mask, np.searchsorted(numbers, now) + 1, 0)


def integral(pixels: DataFrame, image: str = "image", x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """pixels with total: the sum of value over 0 ... x and 0 ... y of the same image. A window is one row or one column
    of one image."""
    row = Window.partitionBy(image, y).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy(image, x).orderBy(y).rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("_row", F.sum(value).over(row)).withColumn("total", F.sum("_row").over(column)).drop("_row")


def pixel_table(images: DataFrame, key: str) -> DataFrame:
    """(key, y, x, value) of images."""
    p = images.select(key, "width", F.posexplode("pixels").alias("i", "value"))
    return p.select(key, F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "value")


def to_images(pixels: DataFrame, key: str) -> DataFrame:
    """(key, width, height, pixels) of a pixel table (key, y, x, value) that has every pixel; an image fits a row."""
    g = pixels.groupBy(key).agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("p"))
    return g.select(key, "width", "height", F.transform("p", lambda c: c["value"]).alias("pixels"))
