"""Squarified treemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A treemap is for the eye: one with more cells is refused.
MOST_CELLS = 100_000


def squarify(areas: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) of areas, given largest first, that fill the rectangle.

    A strip along the shorter side takes areas while its worst ratio of sides doesn't grow: with sum s along a side d, an
    area a has the ratio of d * d * a to s * s, either way round, so only the largest and the smallest matter."""
    out: list[tuple[float, float, float, float]] = []
    at = 0
    while at < len(areas) and min(w, h) > 0:
        d, s, best, to = min(w, h), 0.0, float("inf"), at
        while to < len(areas):
            more = s + areas[to]
            worst = max(d * d * areas[at] / more**2, more**2 / (d * d * areas[to]))
            if worst > best:
                break
            s, best, to = more, worst, to + 1
        thick, run = s / d, 0.0
        for a in areas[at:to]:
            side = a / thick
            out.append((x, y + run, thick, side) if w > h else (x + run, y, side, thick))
            run += side
        if w > h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        at = to
    return out


def treemap(df: DataFrame, by: list[str], key: str, value: str, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """(by..., key, x, y, w, h): cells of each chart, with areas in proportion to value, the larger first and of equals
    the smaller key. Values that are null, NaN or not above 0 have no cell."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, key]), "x double", "y double", "w double", "h double"])

    def run(g):
        import pandas as pd

        if len(g) > MOST_CELLS:
            raise ValueError(f"over {MOST_CELLS} cells")
        g = g.sort_values([value, key], ascending=[False, True])
        area = g[value].astype(float)
        cells = squarify((area * (width * height / area.sum())).tolist(), 0.0, 0.0, width, height)
        g = g.iloc[: len(cells)]
        return pd.concat([g[[*by, key]].reset_index(drop=True), pd.DataFrame(cells, columns=["x", "y", "w", "h"])], axis=1)

    return df.where(f"`{value}` > 0 AND NOT isnan(`{value}`)").select(*by, key, value).groupBy(*by).applyInPandas(run, schema)
