"""Order-dependent grouping of boxes: capped union-find, line buckets, line merging.

Each document's layer is one task's group: what joins depends on what joined
before, so these run over sorted rows in Python. A group is the components of one
layer of one page and so bounded by the page.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Components whose partners are looked up together.
BLOCK = 256


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt by key to as many partitions as shuffles have: the work on a group is much
    more than its bytes, by which adaptive execution would put groups together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@dataclass(frozen=True)
class Grouping:
    """Limits of the component grouping."""

    y_window: int = 64
    max_gap: int = 45
    y_tolerance: float = 22
    min_overlap: float = 0.18
    max_height_ratio: float = 3.7
    max_pair: tuple[int, int] = (370, 82)
    max_group: tuple[int, int] = (295, 98)
    satellite_gap: tuple[int, int] = (18, 20)
    satellite_center: float = 34
    satellite_ratio: float = 9.0


def connects(some: np.ndarray, others: np.ndarray, s: Grouping) -> np.ndarray:
    """(some, others): which components (rows of x1, y1, x2, y2, small, wide) belong together."""
    ax1, ay1, ax2, ay2, a_small, a_wide = some.T[:, :, None]
    x1, y1, x2, y2, small, wide = others.T[:, None, :]
    ha, hb = ay2 - ay1, y2 - y1
    apart = np.abs((ay1 + ay2) / 2 - (y1 + y2) / 2)
    ratio = np.maximum(ha, hb) / np.maximum(np.minimum(ha, hb), 1)
    between = np.maximum(ax1, x1) - np.minimum(ax2, x2), np.maximum(ay1, y1) - np.minimum(ay2, y2)
    # a small one near one that is neither small nor wide
    anchor_wide = np.where(small > 0, a_wide, wide)
    mark = (small != a_small) & (anchor_wide == 0) & (between[0] <= s.satellite_gap[0]) & (between[1] <= s.satellite_gap[1]) & (apart <= s.satellite_center) & (ratio <= s.satellite_ratio)
    right = x1 >= ax1  # of the other; equal starts count as right
    gap = np.where(right, x1 - ax2, ax1 - x2)
    shared = np.maximum(0, -between[1]) / np.maximum(np.minimum(ha, hb), 1)
    width, height = np.maximum(ax2, x2) - np.minimum(ax1, x1), np.maximum(ay2, y2) - np.minimum(ay1, y1)
    near = (gap <= s.max_gap) & (gap >= -np.maximum(ax2 - ax1, x2 - x1)) & (apart <= s.y_tolerance) & (shared >= s.min_overlap) & (ratio <= s.max_height_ratio)
    return mark | (near & (width <= s.max_pair[0]) & (height <= s.max_pair[1]) & (small + wide + a_small + a_wide == 0))


def grouped(boxes: np.ndarray, s: Grouping = Grouping()) -> np.ndarray:
    """Group of each component; a union that would outgrow the limit is left out.

    Edges come in order of (y1, x1) of both ends; a scan ends at the first
    component that starts beyond the window below."""
    n = len(boxes)
    boxes = np.asarray(boxes, float).reshape(n, 6)
    order = np.lexsort((boxes[:, 0], boxes[:, 1]))
    ranked = boxes[order]
    last = np.searchsorted(ranked[:, 1], ranked[:, 3] + s.y_window, "right")
    parent, bounds = list(range(n)), boxes[:, :4].tolist()

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for first in range(0, n, BLOCK):
        end = min(first + BLOCK, n)
        until = int(last[first:end].max())
        places = np.arange(first, until)
        after = (places > np.arange(first, end)[:, None]) & (places < last[first:end, None])
        for k, m in np.argwhere(connects(ranked[first:end], ranked[first:until], s) & after).tolist():
            i, j = int(order[first + k]), int(order[first + m])
            a, b = find(i), find(j)
            if a == b:
                continue
            x, y = bounds[a], bounds[b]
            merged = [min(x[0], y[0]), min(x[1], y[1]), max(x[2], y[2]), max(x[3], y[3])]
            if merged[2] - merged[0] <= s.max_group[0] and merged[3] - merged[1] <= s.max_group[1]:
                parent[b], bounds[a] = a, merged
    return np.array([find(i) for i in range(n)], int)


def component_groups(components: DataFrame, settings: Grouping = Grouping()) -> DataFrame:
    """Groups of (doc, layer, id, x1, y1, x2, y2, ink, small, wide), numbered top to bottom."""
    schema = "doc long, layer string, group_id int, components array<long>, x1 long, y1 long, x2 long, y2 long, ink long, density double, aspect double, satellites int"

    names = [c.split()[0] for c in schema.split(", ")]

    def of_layer(doc, layer, ids, boxes, ink) -> list[tuple]:
        root = grouped(boxes, settings)
        order = np.argsort(root, kind="stable")
        cuts = np.flatnonzero(np.diff(root[order])) + 1
        rows = []
        for at in np.split(order, cuts):
            own = boxes[at]
            (x1, y1), (x2, y2), n = own[:, :2].min(axis=0).tolist(), own[:, 2:4].max(axis=0).tolist(), int(ink[at].sum())
            w, h = x2 - x1, y2 - y1
            rows.append((doc, layer, 0, ids[at].tolist(), x1, y1, x2, y2, n, round(n / max(w * h, 1), 4), round(w / max(h, 1), 3), int(own[:, 4].sum())))
        rows.sort(key=lambda g: (g[5], g[4], g[3]))
        return [(doc, layer, k, *g[3:]) for k, g in enumerate(rows, 1)]

    def whole(pdf: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        ids, ink = pdf["id"].to_numpy(), pdf["ink"].to_numpy()
        boxes = pdf[["x1", "y1", "x2", "y2", "small", "wide"]].to_numpy(np.int64)
        docs, layers = pdf["doc"].tolist(), pdf["layer"].tolist()
        return pd.DataFrame([row for a, b in zip(starts[:-1], starts[1:], strict=True) for row in of_layer(docs[a], layers[a], ids[a:b], boxes[a:b], ink[a:b])], columns=names)

    def run(batches):
        held = None  # a layer whose rows may go on in the next batch
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            doc, layer = pdf["doc"].to_numpy(), pdf["layer"].to_numpy()
            starts = [0, *(np.flatnonzero((doc[1:] != doc[:-1]) | (layer[1:] != layer[:-1])) + 1).tolist()]
            if len(starts) > 1:
                yield whole(pdf, starts)
            held = pdf.iloc[starts[-1] :]
        if held is not None and len(held):
            yield whole(held, [0, len(held)])

    columns = ["doc", "layer", "id", "x1", "y1", "x2", "y2", "ink", "small", "wide"]
    return spread(components.select(*columns), "doc", "layer").sortWithinPartitions("doc", "layer", "id").mapInPandas(run, schema)


def _fresh(pdf: pd.DataFrame, keys: tuple[str, ...], before: tuple | None) -> np.ndarray:
    """Which rows have other keys than the row before them; ``before`` has the keys of the row
    before all. Nulls are one key."""
    fresh = np.zeros(len(pdf), bool)
    for k, name in enumerate(keys):
        own = pdf[name].to_numpy()
        null = pd.isna(own)
        fresh[1:] |= (own[1:] != own[:-1]) & ~(null[1:] & null[:-1])
        fresh[:1] |= before is None or not (own[0] == before[k] or (null[0] and pd.isna(before[k])))
    return fresh


def bucketed(y1: np.ndarray, y2: np.ndarray, starts: np.ndarray, max_center: float = 18.0, min_overlap: float = 0.45) -> np.ndarray:
    """Bucket of each group, from 1 in each document. Documents are stretches of the rows, in
    order, that begin at ``starts``; each step works on one group of all documents at once."""
    sizes = np.diff(np.append(starts, len(y1)))
    largest = np.argsort(-sizes, kind="stable")
    first, left = np.asarray(starts)[largest], sizes[largest]
    out, n = np.zeros(len(y1), np.int64), np.zeros(len(first), np.int64)
    low, high = np.zeros((2, len(first), 8), np.result_type(y1, y2))
    for t in range(int(left.max(initial=0))):
        docs = int(np.searchsorted(-left, -t, "left"))  # that have more than t groups
        at, have, own = first[:docs] + t, n[:docs], np.arange(docs)
        top, bottom = y1[at], y2[at]
        used = max(int(have.max()), 1)
        lo, hi = low[:docs, :used], high[:docs, :used]
        apart = np.abs(((top + bottom) / 2)[:, None] - (lo + hi) / 2)
        shared = np.maximum(0, np.minimum(bottom[:, None], hi) - np.maximum(top[:, None], lo)) / np.maximum(np.minimum((bottom - top)[:, None], hi - lo), 1)
        fits = ((apart <= max_center) | (shared >= min_overlap)) & (np.arange(used) < have[:, None]) & ~np.isnan(apart)
        apart = np.where(fits, apart, np.inf)
        k = apart.argmin(axis=1)
        new = ~fits[own, k]
        k = np.where(new, have, k)
        if used == low.shape[1]:
            low, high = (np.pad(x, ((0, 0), (0, used))) for x in (low, high))
        low[own, k] = np.where(new, top, np.minimum(low[own, k], top))
        high[own, k] = np.where(new, bottom, np.maximum(high[own, k], bottom))
        n[:docs] += new
        out[at] = k + 1
    return out


def line_buckets(groups: DataFrame, max_center: float = 18.0, min_overlap: float = 0.45, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each group's row of text: the nearest bucket that fits, whose box then grows; and the
    columns ``keep``."""
    schema = ", ".join(["doc long, id long, bucket int", *(f"{k} {groups.schema[k].dataType.simpleString()}" for k in keep)])

    def whole(frames: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(frames, ignore_index=True)
        starts = np.flatnonzero(_fresh(pdf, ("doc",), None))
        return pdf.assign(bucket=bucketed(pdf["y1"].to_numpy(), pdf["y2"].to_numpy(), starts, max_center, min_overlap))[["doc", "id", "bucket", *keep]]

    def run(batches):
        held: list[pd.DataFrame] = []  # a document whose rows may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            starts = np.flatnonzero(_fresh(pdf, ("doc",), (held[-1]["doc"].iloc[-1],) if held else None))
            if held and len(starts):
                yield whole([*held, pdf.iloc[: starts[-1]]])
                held = [pdf.iloc[starts[-1] :]]
            elif len(starts) > 1:
                yield whole([pdf.iloc[: starts[-1]]])
                held = [pdf.iloc[starts[-1] :]]
            else:
                held.append(pdf)
        if held:
            yield whole(held)

    rows = spread(groups.select(*dict.fromkeys(["doc", "id", "x1", "y1", "y2", *keep])), "doc")
    return rows.sortWithinPartitions("doc", "y1", F.col("y1") + F.col("y2"), "x1", "id").mapInPandas(run, schema)


def text_units(rows: DataFrame, max_gap: int = 60, max_width: int = 420) -> DataFrame:
    """Neighbours of a line joined left to right while gap and width allow it.

    Input (doc, bucket, id, x1, x2); output unit number and why it began."""
    schema = "doc long, bucket int, id long, unit int, reason string"

    def run(batches):
        before, unit, left, right = None, 0, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            units, reasons = [], []
            for fresh, x1, x2 in zip(_fresh(pdf, ("doc", "bucket"), before).tolist(), pdf["x1"].tolist(), pdf["x2"].tolist(), strict=True):
                if fresh:
                    unit, reason = 0, "first_in_line"
                else:
                    reason = "gap_too_wide" if x1 - right > max_gap else "unit_too_wide" if max(right, x2) - left > max_width else None
                if reason:
                    unit, left, right = unit + 1, x1, x2
                else:
                    right = max(right, x2)
                units.append(unit)
                reasons.append(reason or "merged")
            before = pdf["doc"].iloc[-1], pdf["bucket"].iloc[-1]
            yield pdf[["doc", "bucket", "id"]].assign(unit=units, reason=reasons)

    lines = spread(rows.select("doc", "bucket", "id", "x1", "x2"), "doc", "bucket")
    return lines.sortWithinPartitions("doc", "bucket", "x1", "x2", "id").mapInPandas(run, schema)


def greedy_matches(pairs: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """One-to-one nearest matches of (side 'a' or 'b', at) within a tolerance, a in order."""
    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", a long, b long"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        free, out = sorted(pdf.loc[pdf.side == "b", "at"].tolist()), []
        for a in sorted(pdf.loc[pdf.side == "a", "at"].tolist()):
            near = min(free, key=lambda b: (abs(a - b), b), default=None)
            if near is not None and abs(a - near) <= tolerance:
                free.remove(near)
                out.append((*key, a, near))
        return pd.DataFrame(out, columns=[*keys, "a", "b"])

    return pairs.groupBy(*keys).applyInPandas(run, schema)
