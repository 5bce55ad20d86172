"""Hierarchical language identification: the family first, then one-versus-one
linear support vector machines between the languages of that family.

Features are hashed runs of one to three bytes of the lower-cased text (all that
is not a letter counts as one space), square-rooted and of unit length. Weights
are trained in numpy on a sample of about ``SAMPLE_ROWS`` labelled documents, as
many of each language and ``LEAST_ROWS`` at least where there are that many; whole texts are read for training and prediction.

Defined cases: a text that is null, empty or without letters is ``und`` with
score 0; null labels and null doc_ids are not learned from, and a null doc_id is
not held out; with no label to learn from everything is ``und``; ties go to the
label that sorts first; equal texts get equal results; other columns are ignored.

Size: the driver gets each label's count and the sample's feature vectors of 16 KB:
``SAMPLE_ROWS``, or ``LEAST_ROWS`` of each label if that is more. Every label is
learned, so the sample grows with the number of languages, not with the input.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices, table, utf8_view

DIM = 4096
SAMPLE_ROWS = 1200
#: Sample rows of a language at least, however many there are.
LEAST_ROWS = 6
#: Score below which the pipeline's stage rejects a document.
REJECT = 0.2

# Families of ISO 639-1 codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "sinitic": "zh",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.full(256, 32, np.uint8)
for _r in (range(97, 123), range(128, 256)):
    _LETTER[list(_r)] = list(_r)


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def features(column: pa.Array):
    """Yields (first row, last row, matrix of unit vectors) over a batch's texts."""
    data, offsets = utf8_view(pc.utf8_lower(column.fill_null("")))
    for a, b in slices(offsets):
        byte = _LETTER[data[offsets[a] : offsets[b]]].astype(np.int64)
        own = offsets[a : b + 1] - offsets[a]
        row = np.repeat(np.arange(b - a), np.diff(own))
        x = np.zeros((b - a) * DIM)
        gram = np.zeros(len(byte), np.int64)
        for n in (1, 2, 3):
            k = len(byte) - n + 1
            if k <= 0:
                break
            gram = gram[:k] * 257 + byte[n - 1 :]
            good = (row[:k] == row[n - 1 :]) & ~((byte[:k] == 32) & (byte[n - 1 :] == 32))
            slot = ((gram[good] + n * 0x51ED27) * 0x9E3779B1 >> 15) & (DIM - 1)
            x += np.bincount(row[:k][good] * DIM + slot, minlength=len(x))
        x = np.sqrt(x.reshape(b - a, DIM))
        yield a, b, (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 30.0) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by accelerated gradient
    steps; classes weigh the same whatever their sizes. y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y, w = y.astype(np.float32), np.zeros(x.shape[1], np.float32)
    v, step = w.copy(), np.float32(1.0 / (1.0 + 4.0 * c))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - np.float32(2 * c) * ((share * y * slack) @ x))
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w


def train(sample: list[tuple[str, bytes]]) -> dict:
    """The model: families, and for each of them its languages and pairwise weights."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return {"families": []}
    x = np.frombuffer(b"".join(f for _, f in sample), np.float32).reshape(len(sample), DIM)
    of = np.array([langs.index(lang) for lang, _ in sample])
    families = sorted({family(g) for g in langs})
    fam = np.array([families.index(family(g)) for g in langs])
    pick = lambda a, b, key: fit_svm(x[m := (key == a) | (key == b)], np.where(key[m] == a, 1.0, -1.0))
    levels = [(families, {p: pick(*p, fam[of]) for p in combinations(range(len(families)), 2)})]
    for f in range(len(families)):
        own = [k for k in range(len(langs)) if fam[k] == f]
        levels.append(([langs[k] for k in own], {(i, j): pick(own[i], own[j], of) for i, j in combinations(range(len(own)), 2)}))
    return {"families": levels}


def _vote(x: np.ndarray, names: list[str], pairs: dict) -> tuple[np.ndarray, np.ndarray]:
    """Winner by pairwise votes, then by summed margins; score: its mean probability."""
    n, k = len(x), len(names)
    if k == 1:
        return np.zeros(n, np.int64), np.ones(n)
    votes, chance = np.zeros((n, k)), np.zeros((n, k))
    for (i, j), w in pairs.items():
        p = 1 / (1 + np.exp(-4 * (x @ w[:-1] + w[-1]).astype(np.float64)))
        votes[:, i] += p >= 0.5
        votes[:, j] += p < 0.5
        chance[:, i] += p
        chance[:, j] += 1 - p
    best = (votes + chance / (2 * k)).argmax(axis=1)
    return best, chance[np.arange(n), best] / (k - 1)


def predict(x: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    (families, pairs), *levels = model["families"]
    top, score = _vote(x, families, pairs)
    out = np.empty(len(x), object)
    for f, (names, own) in enumerate(levels):
        at = np.flatnonzero(top == f)
        best, p = _vote(x[at], names, own)
        out[at] = np.array(names, object)[best]
        score[at] *= p
    return out.tolist(), score


def learn(docs: DataFrame, may_learn) -> dict:
    """A model from rows of (text, lang, doc_id) where ``may_learn`` holds."""
    labelled = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy("lang").collect()}
    if not counts:
        return {"families": []}
    each = max(LEAST_ROWS, SAMPLE_ROWS // len(counts))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * each / n + 20 / n))])
    luck = F.xxhash64("doc_id", F.lit("language"))
    near = labelled.filter(F.pmod(luck, F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(luck, "text"))
    sample = near.withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", "text")

    def run(batches):
        for batch in batches:
            rows = [v.tobytes() for _, _, x in features(batch.column(1)) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "x"])

    return train(sorted((r[0], bytes(r[1])) for r in sample.mapInArrow(run, "lang string, x binary").collect()))


def identify(docs: DataFrame, model: dict, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of ``docs``, and the predicted language and score under ``names``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    taken = docs.select(*keep, F.col("text").alias(free_name(keep, "read")))
    at = len(keep)
    types = [T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]

    def run(batches):
        for batch in batches:
            text = batch.column(at)
            langs, scores = ["und"] * len(text), np.zeros(len(text))
            known = pc.match_substring_regex(text.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            if shared.value["families"]:
                for a, b, x in features(text):
                    langs[a:b], scores[a:b] = predict(x, shared.value)
            langs = [g if k else "und" for g, k in zip(langs, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(langs, pa.string()), pa.array(np.where(known, np.clip(scores, 0, 1), 0.0))], [*keep, *names])

    return taken.mapInArrow(run, T.StructType(types))


def held_out(modulus: int, fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(4, 2))
    model = learn(docs, ~F.col("held_out") & F.col("doc_id").isNotNull())
    return identify(docs, model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is not found (und or a score under REJECT)."""
    model = learn(docs.withColumn("held_out", held_out(4, 2)), ~F.col("held_out") & F.col("doc_id").isNotNull())
    lang, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "lang_score")
    found = identify(docs, model, docs.columns, (lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= REJECT)).select(*docs.columns)
