"""Text units whose facing borders show the same strokes are parts of one unit.

A border profile is 1 for each row (or column) in which a narrow band inside the
border has ink. Two profiles match where touched places of one have a partner in
the other within a tolerance, each partner once, in order. All of it works on one
page and layer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Box = tuple[int, int, int, int]


@dataclass(frozen=True)
class Limits:
    band: int = 2
    tolerance: int = 1
    least_aligned: int = 2
    most_gap: tuple[int, int] = (6, 6)
    least_overlap: float = 0.3
    most_size: tuple[int, int] = (400, 120)
    most_groups: int = 12


def touched(mask: np.ndarray, box: Box, side: str, band: int) -> list[int]:
    """Places along a border, in the page's coordinates, with ink in the band inside it."""
    h, w = mask.shape
    x1, y1, x2, y2 = max(box[0], 0), max(box[1], 0), min(box[2], w), min(box[3], h)
    part = mask[y1:y2, x1:x2]
    if not part.size:
        return []
    band = max(1, band)
    if side in ("left", "right"):
        return (np.flatnonzero((part[:, :band] if side == "left" else part[:, -band:]).any(axis=1)) + y1).tolist()
    if side in ("top", "bottom"):
        return (np.flatnonzero((part[:band] if side == "top" else part[-band:]).any(axis=0)) + x1).tolist()
    raise ValueError(f"no such side: {side}")


def matched(first: list[int], second: list[int], tolerance: int) -> list[tuple[int, int]]:
    """Each place of the first with the nearest free one of the second (the lower of two)."""
    free, out = sorted(second), []
    for a in first:
        near = min(free, key=lambda b: (abs(a - b), b), default=None)
        if near is not None and abs(a - near) <= tolerance:
            free.remove(near)
            out.append((a, near))
    return out


def joined(boxes: list[Box]) -> Box:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def fits(box: Box, groups: int, limits: Limits) -> bool:
    return box[2] - box[0] <= limits.most_size[0] and box[3] - box[1] <= limits.most_size[1] and groups <= limits.most_groups


def edge(mask: np.ndarray, a: dict, b: dict, direction: str, limits: Limits) -> dict | None:
    """What speaks for joining unit b at the right of (or below) unit a: gap, overlap,
    matched places and why not (blocked, null if nothing); none where b isn't near there."""
    along = 0 if direction == "right" else 1  # x or y
    p, q, other = a["box"], b["box"], 1 - along
    gap = q[along] - p[along + 2]
    if not 0 <= gap <= limits.most_gap[along]:
        return None
    shared = min(p[other + 2], q[other + 2]) - max(p[other], q[other])
    overlap = max(0, shared) / max(1, min(p[other + 2] - p[other], q[other + 2] - q[other]))
    out = {"first": a["id"], "second": b["id"], "direction": direction, "gap": gap, "overlap": round(overlap, 6), "matched": 0, "blocked": None}
    if overlap < limits.least_overlap:
        return out | {"blocked": f"{'vertical' if direction == 'right' else 'horizontal'}_overlap_too_weak"}
    if not fits(joined([p, q]), a["groups"] + b["groups"], limits):
        return out | {"blocked": "merged_unit_too_large"}
    sides = ("right", "left") if direction == "right" else ("bottom", "top")
    n = len(matched(touched(mask, p, sides[0], limits.band), touched(mask, q, sides[1], limits.band), limits.tolerance))
    return out | {"matched": n, "blocked": None if n >= limits.least_aligned else "profiles_do_not_align"}


def attached(mask: np.ndarray, units: list[dict], limits: Limits = Limits()) -> tuple[list[list[int]], list[dict], list[dict]]:
    """Units (id, box, groups, layer) of a page: the ids that belong together, by place, the
    edges that joined them, and those that were blocked.

    Of a pair's two directions the one of the smaller gap, then of more matches, counts.
    Edges are taken by gap, matches and ids, while what they join stays within limits."""
    ordered = sorted(units, key=lambda u: (u["box"][1], u["box"][0], u["id"]))
    edges, blocked = [], []
    for k, a in enumerate(ordered):
        for b in ordered[k + 1 :]:
            if a.get("layer") != b.get("layer"):
                continue
            found = [e for e in (edge(mask, a, b, d, limits) for d in ("right", "down")) if e]
            good = sorted((e for e in found if not e["blocked"]), key=lambda e: (e["gap"], -e["matched"]))
            if good:
                edges.append(good[0])
            else:
                blocked += found
    root, by = {u["id"]: u["id"] for u in units}, {u["id"]: u for u in units}
    accepted = []
    for e in sorted(edges, key=lambda e: (e["gap"], -e["matched"], e["first"], e["second"])):
        one, two = root[e["first"]], root[e["second"]]
        if one == two:
            continue
        both = [by[i] for i, r in root.items() if r in (one, two)]
        if not fits(joined([u["box"] for u in both]), sum(u["groups"] for u in both), limits):
            blocked.append(e | {"blocked": "profile_chain_limit_exceeded"})
            continue
        root = {i: min(one, two) if r in (one, two) else r for i, r in root.items()}
        accepted.append(e)
    parts: dict[int, list[int]] = {}
    for i, r in root.items():
        parts.setdefault(r, []).append(i)
    place = lambda ids: joined([by[i]["box"] for i in ids])[1::-1]
    return sorted((sorted(ids) for ids in parts.values()), key=place), accepted, blocked
