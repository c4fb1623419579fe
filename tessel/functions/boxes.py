"""Boxes (x0, y0, x1, y1) and detections."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Overlap by union; 0 where the union is."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def non_maximum(df: DataFrame, by: list[str], threshold: float, soft: float | None = None, least: float = 0.0) -> DataFrame:
    """Detections (id, x0, y0, x1, y1, score, by...) that no better one of their group overlaps by more than threshold.

    With soft, overlapping ones keep score * exp(-iou**2 / soft) instead, if that is over least. A group is one image
    (and class), so it fits a task."""
    import numpy as np
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        box, score = g[["x0", "y0", "x1", "y1"]].to_numpy(float), g["score"].to_numpy(float).copy()
        size = np.prod(np.maximum(box[:, 2:] - box[:, :2], 0), axis=1)
        left, kept = np.ones(len(g), dtype=bool), []
        while left.any():
            i = int(np.where(left, score, -np.inf).argmax())
            if score[i] <= least and soft:
                break
            kept.append(i)
            left[i] = False
            side = np.maximum(np.minimum(box[i, 2:], box[:, 2:]) - np.maximum(box[i, :2], box[:, :2]), 0)
            both = side.prod(axis=1)
            over = both / np.maximum(size + size[i] - both, 1e-12)
            if soft:
                score = np.where(left, score * np.exp(-(over**2) / soft), score)
            else:
                left &= over <= threshold
        return g.assign(score=score).iloc[kept]

    return df.groupBy(*by).applyInPandas(run, df.schema)


def unscale(b: Column, scale: Column, pad_x: Column, pad_y: Column) -> Column:
    """A box of a letterboxed image in the coordinates of the original."""
    return F.struct(((b["x0"] - pad_x) / scale).alias("x0"), ((b["y0"] - pad_y) / scale).alias("y0"), ((b["x1"] - pad_x) / scale).alias("x1"), ((b["y1"] - pad_y) / scale).alias("y1"))
