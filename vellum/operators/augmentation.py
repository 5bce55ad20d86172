"""Damages of many masks at once: what ``images.damaged`` gives for each, bit for bit.

Draws come from the generators that numpy seeds, here a step of all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .images import _COSINES, _QUANTA, _TRIED, AROUND, DAMAGES, _blurred, damaged, dilated, shifted

_32, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
# The multiplier of PCG64.
_HIGH_M, _LOW_M = np.uint64(2549297995355413924), np.uint64(4865540595714422341)


def _product(high, low):
    """128-bit numbers times the multiplier."""
    a, b, c, d = low >> _32, low & _LOW, _LOW_M >> _32, _LOW_M & _LOW
    bd, ad, bc = b * d, a * d, b * c
    middle = (bd >> _32) + (ad & _LOW) + (bc & _LOW)
    carried = a * c + (ad >> _32) + (bc >> _32) + (middle >> _32)
    return carried + high * _LOW_M + low * _HIGH_M, low * _LOW_M


def _sum(high, low, high2, low2):
    total = low + low2
    return high + high2 + (total < low), total


def _states(seeds: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit words of numpy's SeedSequence for each seed below 2^64."""
    const = 0x43B0D7E5

    def mixed(value, factor):
        nonlocal const
        value = value ^ np.uint32(const)
        const = const * factor & 0xFFFFFFFF
        value = value * np.uint32(const)
        return value ^ (value >> np.uint32(16))

    none = np.zeros(len(seeds), np.uint32)
    pool = [mixed(x, 0x931E8875) for x in ((seeds & _LOW).astype(np.uint32), (seeds >> _32).astype(np.uint32), none, none)]
    for source in range(4):
        for target in range(4):
            if source != target:
                x = np.uint32(0xCA01F9DD) * pool[target] - np.uint32(0x4973F715) * mixed(pool[source], 0x931E8875)
                pool[target] = x ^ (x >> np.uint32(16))
    const = 0x8B51F9DD
    words = [mixed(pool[k % 4], 0x58F38DED).astype(np.uint64) for k in range(8)]
    return [words[k] | (words[k + 1] << _32) for k in range(0, 8, 2)]


class Streams:
    """``Generator(PCG64(seed))`` of many seeds; draws are for those at ``at``."""

    def __init__(self, seeds):
        high, low, inc_high, inc_low = _states(np.asarray(seeds, np.uint64))
        one, top = np.uint64(1), np.uint64(63)
        self.inc = (inc_high << one) | (inc_low >> top), (inc_low << one) | one
        self.high, self.low = _sum(*_product(*_sum(*self.inc, high, low)), *self.inc)
        self.half, self.has_half = np.zeros(len(self.low), np.uint64), np.zeros(len(self.low), bool)

    def states(self):
        """As numpy's PCG64 takes them, before any draw."""
        for high, low, inc_high, inc_low in zip(*(x.tolist() for x in (self.high, self.low, *self.inc)), strict=True):
            yield {"bit_generator": "PCG64", "state": {"state": high << 64 | low, "inc": inc_high << 64 | inc_low}, "has_uint32": 0, "uinteger": 0}

    def _next(self, at):
        high, low = _sum(*_product(self.high[at], self.low[at]), self.inc[0][at], self.inc[1][at])
        self.high[at], self.low[at] = high, low
        x, by = high ^ low, high >> np.uint64(58)
        return (x >> by) | (x << ((np.uint64(64) - by) & np.uint64(63)))

    def _next_half(self, at):
        out, has = self.half[at], self.has_half[at]
        new = at[~has]
        word = self._next(new)
        out[~has], self.half[new] = word & _LOW, word >> _32
        self.has_half[at] = ~has
        return out

    def integers(self, at, low, high):
        """From ``low`` to ``high`` - 1; both are numbers or arrays beside ``at``."""
        n = np.broadcast_to(np.asarray(high, np.int64) - low, at.shape).astype(np.uint64)
        out, left = np.zeros(len(at), np.int64), np.flatnonzero(n > 1)
        while len(left):
            m, k = self._next_half(at[left]) * n[left], n[left]
            fine = (m & _LOW) >= ((_LOW + np.uint64(1)) - k) % k
            out[left[fine]] = (m[fine] >> _32).astype(np.int64)
            left = left[~fine]
        return out + low

    def random(self, at):
        return (self._next(at) >> np.uint64(11)).astype(float) * 2.0**-53

    def uniform(self, at, low, high):
        return low + (high - low) * self.random(at)

    def grids(self, at, shape):
        return np.stack([self.random(at) for _ in range(int(np.prod(shape)))], axis=1).reshape(len(at), *shape)


def _bled(masks, draws: Streams, at):
    ghost = np.where((draws.integers(at, 0, 2) > 0)[:, None, None], masks[:, :, ::-1], masks)
    (dx, dy), (h, w), far = (draws.integers(at, 3, 9) * np.where(draws.integers(at, 0, 2) > 0, 1, -1) for _ in range(2)), masks.shape[1:], 8
    wide = np.pad(ghost, ((0, 0), (far, far), (far, far)))
    moved = wide[np.arange(len(at))[:, None, None], (np.arange(h) + far - dy[:, None])[:, :, None], (np.arange(w) + far - dx[:, None])[:, None, :]]
    return masks | (draws.grids(at, (h, w)) < 0.28 * _blurred(moved, 2))


def _cropped(masks, draws: Streams, at):
    out, turns, share = masks.copy(), draws.integers(at, 0, 4), draws.uniform(at, 0.08, 0.22)
    for k in range(4):
        own = np.flatnonzero(turns == k)
        m = np.rot90(masks[own], k, (1, 2)).copy()
        used = m.any(axis=1)
        first, last = used.argmax(axis=1), used.shape[1] - 1 - used[:, ::-1].argmax(axis=1)
        cut = first + np.maximum(1, np.rint((last - first + 1) * share[own]).astype(int))
        m &= (np.arange(used.shape[1]) >= cut[:, None])[:, None, :]
        out[own] = np.rot90(m, -k, (1, 2))
    return out


_COS, _SIN = ({k: f(np.deg2rad(np.int64(k))) for k in range(-35, 36)} for f in (np.cos, np.sin))


def _overlapped(masks, draws: Streams, at):
    h, w = masks.shape[1:]
    columns, rows = masks.any(axis=1), masks.any(axis=2)
    low = np.stack([columns.argmax(axis=1), rows.argmax(axis=1)], axis=1)
    size = np.stack([w - columns[:, ::-1].argmax(axis=1), h - rows[:, ::-1].argmax(axis=1)], axis=1) - low
    off = lambda part: np.stack([draws.integers(at, -np.maximum(1, n // part), np.maximum(2, n // part + 1)) for n in size.T], axis=1)
    angles = draws.integers(at, -35, 36).tolist()
    middle = low + size / 2 + off(5)
    half = np.array([[_COS[a], _SIN[a]] for a in angles]).reshape(-1, 2) * np.maximum(8.0, 1.55 * size.max(axis=1))[:, None] / 2
    most = np.array([w - 1, h - 1])
    a, b = np.clip(np.rint(middle - half), 0, most), np.clip(np.rint(middle + half), 0, most)
    bend, t = np.clip(np.rint((a + b) / 2 + off(6)), 0, most), np.linspace(0, 1, 4 * (h + w))
    x, y = (np.rint((1 - t) ** 2 * a[:, k, None] + 2 * (1 - t) * t * bend[:, k, None] + t**2 * b[:, k, None]).astype(int) for k in (0, 1))
    out = masks.copy()
    out[np.arange(len(at))[:, None], y, x] = True
    return out


def _shrink(n: int, to: int) -> np.ndarray:
    edges = np.linspace(0, n, to + 1)
    share = np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, None)
    return share / share.sum(axis=1, keepdims=True)


def _compressed(masks, quality: int, rows: int, columns: int):
    h, w = masks.shape[1:]
    small = _shrink(h, rows) @ (255.0 * masks) @ _shrink(w, columns).T
    g = small[:, np.arange(h) * rows // h][:, :, np.arange(w) * columns // w]
    g = np.pad(g, ((0, 0), (0, -h % 8), (0, -w % 8)), mode="edge") - 128
    step = np.clip(np.floor((_QUANTA * (5000 / quality) + 50) / 100), 1, 255)
    parts = g.reshape(len(g), g.shape[1] // 8, 8, g.shape[2] // 8, 8).swapaxes(2, 3)
    parts = _COSINES.T @ (np.rint(_COSINES @ parts @ _COSINES.T / step) * step) @ _COSINES
    return parts.swapaxes(2, 3).reshape(g.shape)[:, :h, :w] + 128 > 127


def _compressed_all(masks, seeds):
    """A compression depends on the mask, the quality and the sides of the small image alone:
    those that tries share are made once. The first try is made for all, the others for the
    rest."""
    out, (h, w), (_, least, most) = masks.copy(), masks.shape[1:], _TRIED["compression_artifacts"]
    draws, of = Streams(seeds), np.unique(np.packbits(masks.reshape(len(masks), -1), axis=1), axis=0, return_inverse=True)[1].ravel()
    left = np.flatnonzero(masks.any(axis=(1, 2)))
    for tries in (1, 29):
        drawn = []
        for _ in range(tries):
            quality, scale = draws.integers(left, 12, 39), draws.uniform(left, 0.65, 0.9)
            drawn.append([quality, *(np.maximum(4, np.rint(n * scale)).astype(int) for n in (h, w))])
        plan = np.array(drawn).transpose(0, 2, 1).reshape(-1, 3)  # by try, then mask
        side = max(h, w, 4) + 1
        key = ((of[np.tile(left, tries)] * 40 + plan[:, 0]) * side + plan[:, 1]) * side + plan[:, 2]
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        source, plans = left[first % max(len(left), 1)], plan[first]
        made, how = np.zeros((len(first), h, w), bool), (plans[:, 0] * side + plans[:, 1]) * side + plans[:, 2]
        order = np.argsort(how, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(how[order])) + 1) if len(order) else []:
            made[some] = _compressed(masks[source[some]], *plans[some[0]].tolist())
        changed = (made ^ masks[source]).sum(axis=(1, 2))
        good = ((changed >= least) & (changed <= most * masks[source].sum(axis=(1, 2))))[same].reshape(tries, len(left))
        found = good.any(axis=0)
        out[left[found]] = made[same.reshape(tries, -1)[good.argmax(axis=0)[found], np.flatnonzero(found)]]
        left = left[~found]
    return out


_TRY: dict[str, Callable] = {"bleed_through": _bled, "edge_crop_loss": _cropped, "ink_overlap": _overlapped}


def _tried(masks, recipe: str, seeds):
    out, (_, least, most) = masks.copy(), _TRIED[recipe]
    draws, left = Streams(seeds), np.flatnonzero(masks.any(axis=(1, 2)))
    for _ in range(30):
        if not len(left):
            break
        before = masks[left]
        new = _TRY[recipe](before, draws, left)
        changed = (new ^ before).sum(axis=(1, 2))
        good = (changed >= least) & (changed <= most * before.sum(axis=(1, 2)))
        out[left[good]] = new[good]
        left = left[~good]
    return out


def _misjudged_all(masks, seeds):
    """Noise is drawn by numpy, as its normal numbers take any number of steps."""
    out, (_, least, most) = masks.copy(), _TRIED["threshold_failure"]
    h, w = masks.shape[1:]
    gray, inked = 255 * (0.5 * masks + 0.5 * _blurred(masks, 1)), masks.sum(axis=(1, 2)).tolist()
    bits = np.random.PCG64(0)
    rng = np.random.Generator(bits)
    for i, state in enumerate(Streams(seeds).states()):
        if not inked[i]:
            continue
        bits.state = state
        mask, own = masks[i], gray[i]
        for _ in range(30):
            noisy, mode = own + rng.normal(0, 30, (h, w)), int(rng.integers(0, 3))
            if mode < 2:
                new = noisy > int(rng.integers(*((145, 190), (25, 75))[mode]))
            else:
                most_slope, along = rng.uniform(25, 70), int(rng.integers(0, 2))
                slope = np.linspace(0, most_slope, (h, w)[along])
                new = noisy > int(rng.integers(90, 145)) + (slope[:, None] if along == 0 else slope)
            if least <= np.count_nonzero(new ^ mask) <= most * inked[i]:
                out[i] = new
                break
    return out


def damaged_all(masks: np.ndarray, recipe: str, seeds) -> np.ndarray:
    """``damaged`` of each of the masks (n, height, width) by the seed beside it."""
    if recipe not in DAMAGES:
        raise ValueError(f"unknown damage: {recipe}")
    n, (h, w), everyone = len(masks), masks.shape[1:], np.arange(len(masks))
    if not n or not h or not w:
        return np.array([damaged(m, recipe, int(s)) for m, s in zip(masks, seeds, strict=True)], bool).reshape(masks.shape)
    if recipe == "compression_artifacts":
        return _compressed_all(masks, seeds)
    if recipe == "threshold_failure":
        return _misjudged_all(masks, seeds)
    if recipe in _TRIED:
        return _tried(masks, recipe, seeds)
    if recipe == "blur":
        return sum((shifted(masks, dx, dy).astype(np.int8) for dx, dy in AROUND), masks.astype(np.int8)) >= 4
    draws = Streams(seeds)
    if recipe == "cut_line":
        y = draws.integers(everyone, 0, h)
        end = y + 1 + draws.integers(everyone, 0, 2)
        at = np.arange(h)
        return masks & ~((at >= y[:, None]) & (at < end[:, None]))[:, :, None]
    if recipe == "black_noise":
        return masks | (draws.grids(everyone, (h, w)) < 0.02)
    if recipe == "erosion":
        return masks & ~(dilated(~masks) & (draws.grids(everyone, (h, w)) < 0.3))
    yy, xx = np.mgrid[:h, :w]
    y, x = (draws.integers(everyone, 0, side)[:, None, None] for side in (h, w))
    return masks | (np.abs(np.hypot(yy - y, xx - x) - min(h, w) / 3) < 0.7)
