"""Personal data: patterns, and a character-level BiLSTM with CRF transitions.

Kinds: email, ip, card, phone. Pattern matches (leftmost, non-overlapping for
each kind) always stay. The network, trained in numpy on labelled spans of
invented sentences, adds what the patterns miss, such as telephone numbers
without a plus sign or cards with dots; an added span passes its kind's number
check, overlaps no other span and is decoded over whole texts: emission scores of
overlapping windows are blended by distance from the window's rim and one
Viterbi pass runs over each stretch of text.

All four kinds hold a digit or an at sign, so the network reads every character
within ``PAD`` of one, and no other; that leaves out nothing it could report.

Defined cases: null and empty texts have no spans; equal texts have equal spans;
spans of different pattern kinds may overlap and all stay; among added spans the
leftmost stays; offsets count code points and ends are exclusive; other columns
don't matter. Time and memory grow with the length of a text, not its square.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, table

KINDS = ("email", "ip", "card", "phone")
HIDDEN, STEPS, BATCH, WINDOW, STRIDE, PAD = 20, 260, 32, 72, 36, 36
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

# ---------------------------------------------------------------- patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(number)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def right(kind: str, said: str) -> bool:
    """Whether a match passes its kind's number check."""
    if kind == "ip":
        parts = said.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in parts)
    n = digits(said) if kind in ("card", "phone") else ""
    if kind == "card":
        return 14 <= len(n) <= 19 and luhn(n)
    return kind == "email" or 10 <= len(n) <= 15


def _emails(text: str):
    """As ``[A-Za-z0-9._%+-]+@`` and a domain, leftmost, in linear time."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            low = m.end()
            yield start, m.end()
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all pattern matches, sorted."""
    if not _TRIGGER.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if right(KINDS[k], m[0])]
    return sorted(out)


# ---------------------------------------------------------------- network

_CLASS = np.full(129, 30, np.int64)  # other ASCII
for _k, _c in enumerate(" \n@.-_+(),:/%"):
    _CLASS[ord(_c)] = _k
_CLASS[48:58] = 13
_CLASS[97:123] = np.repeat([14, 15, 16, 17, 18, 19], [5, 4, 4, 4, 4, 5])
_CLASS[65:91] = 20
_CLASS[61] = _CLASS[34] = 21
_CLASS[128] = 22  # beyond ASCII
CLASSES = 31


def classes(points: np.ndarray) -> np.ndarray:
    return _CLASS[np.minimum(points, 128)]


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for side in "fb":
        p["E" + side] = rng.normal(0, 0.2, (CLASSES, 4 * HIDDEN))
        p["E" + side][:, HIDDEN : 2 * HIDDEN] += 1.0  # gates remember at first
        p["U" + side] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
    p["W"], p["b"], p["A"] = rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS))
    return p


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, e: np.ndarray, u: np.ndarray):
    """Hidden states (T, B, H) and what the way back needs; x is (T, B)."""
    t, b = x.shape
    hs, cs, gates = np.zeros((t + 1, b, HIDDEN), e.dtype), np.zeros((t + 1, b, HIDDEN), e.dtype), np.empty((t, b, 4 * HIDDEN), e.dtype)
    for k in range(t):
        z = e[x[k]] + hs[k] @ u
        z[:, : 3 * HIDDEN] = _sigmoid(z[:, : 3 * HIDDEN])
        z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o, g = np.split(z, 4, axis=1)
        cs[k + 1] = f * cs[k] + i * g
        hs[k + 1] = o * np.tanh(cs[k + 1])
        gates[k] = z
    return hs, cs, gates


def _lstm_back(x, u, hs, cs, gates, dh_all):
    """Gradients of the embedding and recurrent weights."""
    de, du = np.zeros((CLASSES, 4 * HIDDEN)), np.zeros_like(u)
    dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
    for k in range(len(x) - 1, -1, -1):
        i, f, o, g = np.split(gates[k], 4, axis=1)
        th = np.tanh(cs[k + 1])
        dh = dh + dh_all[k]
        dc = dc + dh * o * (1 - th * th)
        dz = np.hstack([dc * g * i * (1 - i), dc * cs[k] * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)])
        np.add.at(de, x[k], dz)
        du += hs[k].T @ dz
        dh, dc = dz @ u.T, dc * f
    return de, du


def emissions(p: dict, x: np.ndarray):
    """Scores (T, B, TAGS) of each tag, and the passes' states."""
    forward = _lstm(x, p["Ef"], p["Uf"])
    backward = _lstm(x[::-1], p["Eb"], p["Ub"])
    h = np.concatenate([forward[0][1:], backward[0][1:][::-1]], axis=2)
    return h @ p["W"] + p["b"], h, forward, backward


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def loss_and_gradients(p: dict, x: np.ndarray, y: np.ndarray):
    """Mean negative log likelihood of the tags y (T, B) and its gradients."""
    s, h, forward, backward = emissions(p, x)
    t, b, _ = s.shape
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[0] = s[0]
    for k in range(1, t):
        alpha[k] = s[k] + _lse(alpha[k - 1][:, :, None] + p["A"], 1)
    for k in range(t - 2, -1, -1):
        beta[k] = _lse(p["A"] + (s[k + 1] + beta[k + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    at = np.arange(b)
    gold = sum(s[k, at, y[k]] for k in range(t)) + sum(p["A"][y[k - 1], y[k]] for k in range(1, t))
    ds = np.exp(alpha + beta - z[:, None])
    da = np.zeros_like(p["A"])
    for k in range(1, t):
        da += np.exp(alpha[k - 1][:, :, None] + p["A"] + (s[k] + beta[k])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(da, (y[k - 1], y[k]), -1.0)
    for k in range(t):
        ds[k, at, y[k]] -= 1
    ds, da = ds / b, da / b
    dh = ds @ p["W"].T
    g = {"W": np.einsum("tbh,tbk->hk", h, ds), "b": ds.sum(axis=(0, 1)), "A": da}
    g["Ef"], g["Uf"] = _lstm_back(x, p["Uf"], *forward, dh[:, :, :HIDDEN])
    g["Eb"], g["Ub"] = _lstm_back(x[::-1], p["Ub"], *backward, dh[::-1][:, :, HIDDEN:])
    return float((z - gold).mean()), g


def _number(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng):
    n = rng.choice("3456") + _number(rng, 14)
    n += next(d for d in "0123456789" if luhn(n + d))
    sep = rng.choice(["", "", " ", "-", "."])
    return sep.join(n[k : k + 4] for k in range(0, 16, 4))


def _email(rng):
    name = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    return f"{name(3, 9)}{rng.choice(['', '.', '_'])}{rng.choice(['', name(1, 6)])}{rng.choice(['', _number(rng, 2)])}@{name(3, 8)}{rng.choice(['', _number(rng, 1)])}.{rng.choice(['', name(3, 7) + '.'])}{rng.choice(['com', 'org', 'net', 'de'])}"


def _phone(rng):
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    plain = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])
    return rng.choice([f"+{rng.randint(1, 99)} {plain}", f"+{rng.randint(1, 99)}{a}{b}{c}", plain, plain])


def _ip(rng):
    return ".".join(str(rng.randint(0, 255)) for _ in range(4))


def _noise(rng):
    """What is none of the kinds."""
    return rng.choice([
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", lambda: str(rng.randint(0, 99999)), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(1, 999)},{_number(rng, 3)}.{_number(rng, 2)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 40]))),
        lambda: "AK" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(18)), lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: _number(rng, rng.randint(17, 26)), lambda: f"{rng.randint(0, 23)}:{_number(rng, 2)}",
    ])()


def labelled(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """An invented sentence and its spans (start, kind's number, end)."""
    text, spans = "", []
    while len(text) < WINDOW + 40:
        if rng.random() < 0.3:
            kind = rng.randrange(4)
            said = (_email, _ip, _card, _phone)[kind](rng)
            spans.append((len(text), kind, len(text) + len(said)))
        elif rng.random() < 0.2:
            said = _noise(rng)
        else:
            said = "".join(rng.choice("etaoinshrdlucmfwypvbgkäéñ") for _ in range(rng.randint(1, 10)))
            said = said.capitalize() if rng.random() < 0.1 else said
        text += said + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n"])
    return text, spans


def tags_of(spans, n: int) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, k, b in spans:
        y[a] = 1 + 2 * k
        y[a + 1 : b] = 2 + 2 * k
    return y


def sample(rng: random.Random, n: int):
    xs, ys = [], []
    for _ in range(n):
        text, spans = labelled(rng)
        at = rng.randrange(len(text) - WINDOW + 1)
        xs.append(classes(np.array([ord(c) for c in text]))[at : at + WINDOW])
        ys.append(tags_of(spans, len(text))[at : at + WINDOW])
    return np.array(xs).T, np.array(ys).T


@functools.lru_cache(maxsize=2)
def trained(seed: int = 7, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights after ``steps`` Adam steps on labelled windows; the same for each seed."""
    rng, words = np.random.default_rng(seed), random.Random(seed)
    p = initial(rng)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        _, g = loss_and_gradients(p, *sample(words, BATCH))
        norm = np.sqrt(sum((x * x).sum() for x in g.values()))
        rate = 0.02 * min(1.0, 2.2 * (1 - step / (steps + 1)) + 0.05)
        for k in p:
            d = g[k] * min(1.0, 5.0 / norm)
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in p.items()}


# ---------------------------------------------------------------- decoding


def zones(points: np.ndarray) -> list[tuple[int, int]]:
    """Stretches within PAD of a digit or an at sign, apart from each other."""
    at = np.flatnonzero(((points >= 48) & (points <= 57)) | (points == 64))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * PAD)
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    return [(max(0, int(a) - PAD), min(len(points), int(b) + PAD + 1)) for a, b in zip(first, last, strict=True)]


_RIM = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _blended(p: dict, stretches: list[np.ndarray]) -> list[np.ndarray]:
    """Emission scores (n, TAGS) of each stretch from its overlapping windows."""
    cuts = [(k, a) for k, s in enumerate(stretches) for a in range(0, max(1, len(s) - WINDOW + STRIDE), STRIDE)]
    total, weight = [np.zeros((len(s), TAGS), np.float32) for s in stretches], [np.zeros((len(s), 1), np.float32) for s in stretches]
    for c in range(0, len(cuts), 512):
        some = cuts[c : c + 512]
        x = np.full((WINDOW, len(some)), 1, np.int64)  # beyond an end: line feeds
        for j, (k, a) in enumerate(some):
            part = stretches[k][a : a + WINDOW]
            x[: len(part), j] = part
        s = emissions(p, x)[0]
        for j, (k, a) in enumerate(some):
            n = min(WINDOW, len(stretches[k]) - a)
            total[k][a : a + n] += s[:n, j] * _RIM[:n, None]
            weight[k][a : a + n] += _RIM[:n, None]
    return [t / w for t, w in zip(total, weight, strict=True)]


def viterbi(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    back, score = np.empty(s.shape, np.int8), s[0]
    for k in range(1, len(s)):
        step = score[:, None] + a
        back[k] = step.argmax(axis=0)
        score = step.max(axis=0) + s[k]
    out = np.empty(len(s), np.int64)
    out[-1] = score.argmax()
    for k in range(len(s) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def _runs(tags: np.ndarray):
    """(start, kind's number, end) of the spans in a tag sequence."""
    start = None
    for k, t in enumerate([*tags.tolist(), 0]):
        kind = (t - 1) // 2 if t else -1
        if start is not None and (kind != start[1] or t % 2 == 1):
            yield start[0], start[1], k
            start = None
        if start is None and t:
            start = (k, kind)


_FORM = {0: re.compile(r"[^\s@]+@[^\s@]+\.[^\s@.]+"), 1: re.compile(r"[0-9]+(\.[0-9]+){3}"), 2: re.compile(r"[0-9]([ .-]?[0-9])+"), 3: re.compile(r"\+?\(?[0-9][ ().0-9-]*[0-9]")}


def all_spans(texts: list[str], p: dict) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text, sorted by start, then kind."""
    base = [base_spans(t) for t in texts]
    points = {k: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for k, t in enumerate(texts) if _TRIGGER.search(t)}
    where = [(k, a, b) for k, cp in points.items() for a, b in zones(cp)]
    scores = _blended(p, [classes(points[k][a:b]) for k, a, b in where])
    more: dict[int, list] = {}
    for (k, a, _), s in zip(where, scores, strict=True):
        for x, kind, y in _runs(viterbi(s, p["A"])):
            said = texts[k][a + x : a + y].rstrip(".,;: \n")
            skip = len(said) - len(said.lstrip(" \n,;:"))
            said, x = said[skip:], a + x + skip
            beside = (texts[k][x - 1 : x] + texts[k][x + len(said) : x + len(said) + 1]) if kind else ""
            if _FORM[kind].fullmatch(said) and right(KINDS[kind], said) and not any(c.isalnum() for c in beside):
                more.setdefault(k, []).append((x, kind, x + len(said)))
    out = []
    for k, own in enumerate(base):
        spans = list(own)
        for x, kind, y in sorted(more.get(k, ())):
            if all(y <= a or b <= x for a, _, b in spans):
                spans.append((x, kind, y))
        out.append((own, sorted(spans)))
    return out


def said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _in_turn(texts: list, net):
    """``all_spans`` of some rows at a time, so that a kernel's arrays stay small."""
    for a in range(0, len(texts), BATCH_ROWS):
        yield from all_spans([t or "" for t in texts[a : a + BATCH_ROWS]], net)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            found = list(_in_turn(batch.column(1).to_pylist(), shared.value))
            counts = [[sum(k == kind for _, k, _ in own) for own, _ in found] for kind in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(said(own).encode()).hexdigest() for own, _ in found], pa.string()), pa.array([said(spans) for _, spans in found], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets (n_chars follows)."""
    shared, at = docs.sparkSession.sparkContext.broadcast(trained()), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for r, (_, spans) in enumerate(_in_turn(texts, shared.value)):
                out, end = [], 0
                for a, k, b in spans:
                    if b > end:  # of overlapping spans the rest of the later one goes too
                        out += [texts[r][end : max(a, end)], f"<{KINDS[k]}>"] if a >= end else []
                        end = b
                if spans:
                    texts[r] = "".join([*out, texts[r][end:]])
            cols = batch.columns
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    out = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
