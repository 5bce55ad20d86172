"""Kernels that prepare pages and crops: turning, cleaning, cropping, recognition input.

Gray images are arrays of bytes, 0 is black; masks are boolean, true is ink.
"""

from __future__ import annotations

import numpy as np

from .images import components, otsu, projections, shifted, thinned, vertical_lines, without_small

Box = tuple[int, int, int, int]

# ---------------------------------------------------------------- pages


def quarter_turned(image: np.ndarray, degrees: int) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees."""
    if degrees not in (0, 90, 180, 270):
        raise ValueError(f"a page can't be turned by {degrees} degrees")
    return np.rot90(image, -degrees // 90)


def turned(image: np.ndarray, angle: float, least: float = 0.2, most: float = 10.0) -> np.ndarray:
    """Turned counterclockwise about the middle; the border goes on outside. Angles that
    are too small to matter or too large to be right change nothing."""
    if not least <= abs(angle) <= most:
        return image
    h, w = image.shape
    cy, cx, a = h // 2, w // 2, np.radians(angle)
    ys, xs = np.indices((h, w)) - np.array([cy, cx])[:, None, None]
    # where each pixel comes from
    y, x = np.clip(cy + np.sin(a) * xs + np.cos(a) * ys, 0, h - 1), np.clip(cx + np.cos(a) * xs - np.sin(a) * ys, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), y - y0, x - x0
    g = image.astype(float)
    out = (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy
    return np.rint(out).astype(np.uint8)


def _summed(values: np.ndarray, half: int) -> np.ndarray:
    """Sums over squares of side 2 * half + 1, the border going on outside."""
    padded = np.pad(values, half, mode="edge").cumsum(axis=0).cumsum(axis=1)
    padded = np.pad(padded, ((1, 0), (1, 0)))
    n = 2 * half + 1
    return padded[n:, n:] - padded[:-n, n:] - padded[n:, :-n] + padded[:-n, :-n]


def denoised(gray: np.ndarray, strength: float = 10.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: each pixel is the mean of those around it whose patches are alike."""
    g, reach, half = gray.astype(float), search // 2, patch // 2
    wide = np.pad(g, reach, mode="reflect" if min(g.shape) > reach else "edge")
    total, weights = np.zeros_like(g), np.zeros_like(g)
    h, w = g.shape
    for dy in range(search):
        for dx in range(search):
            other = wide[dy : dy + h, dx : dx + w]
            far = _summed((g - other) ** 2, half) / patch**2
            weight = np.exp(-far / strength**2)
            total += weight * other
            weights += weight
    return np.rint(total / weights).astype(np.uint8)


def locally_thresholded(gray: np.ndarray, block: int = 35, below: float = 14) -> np.ndarray:
    """Ink: pixels darker by ``below`` than the weighted mean of the block around them
    (Gaussian weights of the block's usual width)."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    at = np.arange(block) - block // 2
    weight = np.exp(-(at**2) / (2 * sigma**2))
    weight /= weight.sum()
    mean = np.pad(gray.astype(float), block // 2, mode="edge")
    mean = np.apply_along_axis(np.convolve, 0, mean, weight, "valid")
    mean = np.apply_along_axis(np.convolve, 1, mean, weight, "valid")
    return gray <= np.rint(mean) - below


def skew(mask: np.ndarray, most: float = 10.0, step: float = 0.25) -> float:
    """The angle (degrees, counterclockwise) that lays the rows of ink level: where
    the rows' sums of squared ink are largest. 0 without ink."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return 0.0
    best = (-1.0, 0.0, 0.0)
    for angle in np.arange(-most, most + step / 2, step):
        a = np.radians(angle)
        rows = np.rint(np.cos(a) * ys - np.sin(a) * xs).astype(int)
        n = np.bincount(rows - rows.min())
        best = max(best, (float((n.astype(float) ** 2).sum()), -abs(float(angle)), float(angle)))
    return best[2]


def margins(mask: np.ndarray, padding: int = 20) -> Box:
    """x1, y1, x2, y2 of the ink with some room, within the image; all of it without ink."""
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return 0, 0, w, h
    return max(int(xs.min()) - padding, 0), max(int(ys.min()) - padding, 0), min(int(xs.max()) + 1 + padding, w), min(int(ys.max()) + 1 + padding, h)


def prepared(gray: np.ndarray, degrees: int = 0, strength: float = 10.0, block: int = 35, below: float = 14, padding: int = 20) -> tuple[np.ndarray, float, Box]:
    """A page turned upright, cleaned, made black and white, laid level and cropped to its
    ink: the image, the angle found, and the crop's box."""
    page = np.where(locally_thresholded(denoised(quarter_turned(gray, degrees), strength), block, below), 0, 255).astype(np.uint8)
    angle = skew(page == 0)
    page = turned(page, angle)
    x1, y1, x2, y2 = box = margins(page < 255, padding)
    return page[y1:y2, x1:x2], angle, box


# ---------------------------------------------------------------- masks for printed text


def horizontal_lines(mask: np.ndarray, least: int) -> np.ndarray:
    """Ink in horizontal runs of at least ``least`` pixels."""
    return vertical_lines(mask.T, least).T


def closed(mask: np.ndarray, width: int = 2, height: int = 1) -> np.ndarray:
    """Gaps that a box of this size doesn't fit into are filled."""
    for n, axis in ((width, 0), (height, 1)):
        step = (1, 0) if axis == 0 else (0, 1)
        wide = np.pad(mask, n)
        grown = np.logical_or.reduce([shifted(wide, k * step[0], k * step[1]) for k in range(n)])
        wide = np.logical_and.reduce([shifted(grown, -k * step[0], -k * step[1]) for k in range(n)])
        mask = wide[n : n + mask.shape[0], n : n + mask.shape[1]]
    return mask


def printed_mask(black: np.ndarray, horizontal: np.ndarray | None = None, vertical: np.ndarray | None = None, least: int = 2, close: tuple[int, int] = (2, 1)) -> np.ndarray:
    """Ink for printed text: black ink without lines and specks, small gaps closed."""
    out = black.copy()
    for lines in (horizontal, vertical):
        if lines is not None:
            out &= ~lines
    return closed(without_small(out, least), *close)


# ---------------------------------------------------------------- crops


def clipped(box: Box, shape: tuple[int, int]) -> Box:
    """The box within an image, one pixel at least."""
    h, w = shape
    x1, y1 = min(max(box[0], 0), w - 1), min(max(box[1], 0), h - 1)
    return x1, y1, max(min(box[2], w), x1 + 1), max(min(box[3], h), y1 + 1)


def masked_crop(image: np.ndarray, masks: dict[str, np.ndarray], box: Box, keep) -> tuple[np.ndarray, Box]:
    """A crop that is white but where one of the masks has ink; absent masks keep nothing."""
    x1, y1, x2, y2 = box = clipped(box, image.shape[:2])
    crop = image[y1:y2, x1:x2]
    shown = np.zeros(crop.shape[:2], bool)
    for name in keep:
        if name in masks:
            shown |= masks[name][y1:y2, x1:x2]
    return np.where(shown if crop.ndim == 2 else shown[..., None], crop, 255).astype(image.dtype), box


def composed(layers: dict[str, np.ndarray], names, fallback: np.ndarray | None = None) -> np.ndarray:
    """Layers over one another, in order, each without its white; else the fallback."""
    some = [layers[n] for n in names if layers.get(n) is not None]
    if not some:
        if fallback is None:
            raise ValueError("neither a layer nor a fallback")
        return fallback
    out = np.full_like(some[0], 255)
    for layer in some:
        drawn = (layer < 255).any(axis=-1) if layer.ndim == 3 else layer < 255
        out[drawn] = layer[drawn]
    return out


def dark_on_white(gray: np.ndarray) -> np.ndarray:
    """Turned light for dark where the border is dark."""
    border = np.concatenate([gray[0], gray[-1], gray[:, 0], gray[:, -1]])
    return 255 - gray if border.mean() < 127.5 else gray


def for_recognition(gray: np.ndarray, scale: int = 3, border: int = 20) -> np.ndarray:
    """Dark on white, enlarged by whole pixels, framed in white, black and white by Otsu."""
    big = np.pad(np.kron(dark_on_white(gray), np.ones((scale, scale), np.uint8)), border, constant_values=255)
    return np.where(big <= otsu(big), 0, 255).astype(np.uint8) if big.min() < 255 else big


def _shares(have: int, want: int) -> np.ndarray:
    """(want, have) weights with which pixels along one side make up those of another size."""
    edges = np.arange(want + 1) * have / want
    low, high = np.maximum(edges[:-1, None], np.arange(have)), np.minimum(edges[1:, None], np.arange(have) + 1)
    return np.maximum(high - low, 0) * want / have


def fitted(gray: np.ndarray, side: int) -> np.ndarray:
    """Scaled by area so that the longer side fits, in the middle of a white square."""
    h, w = gray.shape
    if not h or not w:
        raise ValueError("an image without pixels")
    nh, nw = max(int(h * (side / max(h, w))), 1), max(int(w * (side / max(h, w))), 1)
    out = np.full((side, side), 255, np.uint8)
    y, x = (side - nh) // 2, (side - nw) // 2
    out[y : y + nh, x : x + nw] = np.rint(_shares(h, nh) @ gray.astype(float) @ _shares(w, nw).T)
    return out


# ---------------------------------------------------------------- words and segments


def column_bins(width: int, bins: int) -> list[tuple[int, int]]:
    """Ranges of columns, one a bin and a column at least."""
    edges = [round(k * width / bins) for k in range(bins + 1)]
    return [(a, max(b, a + 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


#: What ``bin_features`` gives for each bin, in order.
BIN_FEATURES = ("ink", "skeleton", "endpoints", "junctions", "top", "bottom", "centre", "span", "transitions", "slope")


def bin_features(mask: np.ndarray, bins: int) -> np.ndarray:
    """(bins, 10) features of ranges of columns: shares of ink, skeleton, its ends and
    logical junctions; where ink begins, ends and lies; changes down the columns; and how
    steeply the ink by column changes."""
    from .images import Skeleton

    h, w = mask.shape
    thin = thinned(mask)
    s = Skeleton.of(thin)
    ends, joints = np.zeros(w), np.zeros(w)
    np.add.at(ends, [x for x, _ in s.having("endpoint")], 1)
    np.add.at(joints, [round(sum(x for x, _ in c) / len(c)) for c in s.clusters()], 1)
    down = projections(mask)[1] / max(h, 1)
    slope = np.abs(np.gradient(down)) if w > 1 else np.zeros(w)
    out = np.zeros((bins, len(BIN_FEATURES)))
    for k, (a, b) in enumerate(column_bins(w, bins)):
        part = mask[:, a:b]
        ys, area, n = np.nonzero(part)[0], max(part.size, 1), max(b - a, 1)
        place = [ys.min() / max(h - 1, 1), ys.max() / max(h - 1, 1), ys.mean() / max(h - 1, 1), (ys.max() - ys.min() + 1) / h] if len(ys) else [0.0] * 4
        out[k] = [len(ys) / area, thin[:, a:b].sum() / area, ends[a:b].sum() / n, joints[a:b].sum() / n, *place, np.abs(np.diff(part.astype(int), axis=0)).sum() / area, slope[a:b].mean() if a < w else 0.0]
    return out


def split_row(mask: np.ndarray, least_height: int = 18, smooth: int = 3, least_ink: int = 20, most_of_top: float = 0.22, most_of_mean: float = 0.55) -> tuple[int | None, str]:
    """The row where two stacked lines of text come apart, or none, and why."""
    h = len(mask)
    if h < 2 * least_height:
        return None, "too_short_for_two_rows"
    if h - least_height <= least_height:
        return None, "no_valid_search_band"
    rows = np.convolve(projections(mask)[0], np.ones(smooth) / smooth, "same")
    at = least_height + int(np.argmin(rows[least_height : h - least_height]))
    if min(mask[:at].sum(), mask[at:].sum()) < least_ink:
        return None, "one_side_has_too_little_ink"
    if rows[at] / max(1.0, rows.max()) > most_of_top and rows[at] / max(1.0, rows.mean()) > most_of_mean:
        return None, "no_strong_horizontal_valley"
    return at, "horizontal_projection_valley"


def condition(gray: np.ndarray | None) -> tuple[str, bool, str, float, float, list[str]]:
    """What a segment's pixels tell of damage: condition, whether to repair, damage,
    confidence, severity, notes."""
    if gray is None or not gray.size:
        return "uncertain", True, "unknown", 0.15, 0.5, ["mask_unreadable"]
    border = np.concatenate([gray[0], gray[-1], gray[:, 0], gray[:, -1]])
    light = 255 - gray if np.median(border) > 128 else gray
    mask = light > otsu(light)
    label, n = components(mask)
    sizes = np.bincount(label.ravel(), minlength=n + 1)[1:]
    small, border = int((sizes <= 3).sum()), bool(mask[0].any() or mask[-1].any() or mask[:, 0].any() or mask[:, -1].any())
    empty = mask.sum() <= 2
    notes = [note for note, on in (("almost_empty_segment", empty), ("scanner_noise_like_small_components", small >= 2), ("ink_touches_segment_border", border), ("fragmented_components", n > 2)) if on]
    if empty:
        return "uncertain", True, "unknown", 0.30, 0.45, notes
    if small >= 2 and mask.mean() < 0.18:
        return "uncertain", False, "scanner_noise", 0.35, 0.45, notes
    if border:
        return "uncertain", True, "edge_crop_loss", 0.40, 0.45, notes
    if n > 1:
        return "uncertain", True, "light_cut", 0.38, 0.45, notes
    return "clean", False, "clean", 0.72, 0.0, [*notes, "image_condition_no_strong_damage_signal"]
