"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all characters
from U+0080. An item of at least ``n`` words gives its windows of ``n`` words, a
shorter one a single window of all its words, one without words nothing.

Defined cases: null and empty texts have no words and stay clean; repeated rows
are judged one by one; ties between items that share a window count for each of
them; null item ids are ignored; an empty benchmark leaves everything clean;
columns of the input that clash with added ones are kept and the added one gets
leading underscores.

Very long texts are judged as a whole, alone in their kernel call.

Size: items reach the tasks in blocks of at most ``BLOCK_CHARS`` characters (a longer
item is a block of its own), as arrays of at most ``BYTES_PER_CHAR`` bytes a
character and 1 MB for each window length. A worker holds one block: where there are
more, the documents with what is marked so far are stored between two of them. No
step shuffles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import discard, free_name, slices, store, table, utf8_view

WINDOW = 10
BLOCK_CHARS = 4 << 20
#: A word has a character and a blank or more; it takes 8 bytes of hash and four numbers.
BYTES_PER_CHAR = 16
#: A document with at least this share of hit words goes; else its hit spans go.
DROP_SHARE = 0.5


class _Index:
    """Windows of one block of items: sorted hashes by window length with the place of the
    words to verify and the item."""

    def __init__(self, items, n: int):
        texts = [(i, t) for i, t in items if i is not None and t]
        self.ids = np.array([i for i, _ in texts], np.int64)
        data, offsets = utf8_view(pa.array([t for _, t in texts], pa.string()))
        low = W.LOWER[data]
        starts, ends, rows = W.split(low, offsets, W.WORD)
        hashed = W.hashes(low, starts, ends)
        # words one blank apart, so that a window is one run of bytes
        size = ends - starts
        self.starts = (np.cumsum(size + 1) - size - 1).astype(np.int32)
        self.ends = (self.starts + size).astype(np.int32)
        self.said = np.full(int(size.sum() + len(size)), 32, np.uint8)
        rank = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.said[np.repeat(self.starts, size) + rank] = low[np.repeat(starts, size) + rank]
        words = np.bincount(rows, minlength=len(texts))
        self.by_length = {}
        for length in np.unique(np.minimum(words[words > 0], n)).tolist():
            h = W.windows(hashed, length)
            fits = np.minimum(words, n) == length
            first = np.flatnonzero((rows[: len(h)] == rows[length - 1 :]) & fits[rows[: len(h)]])
            first = first[np.argsort(h[first], kind="stable")]
            seen = np.zeros(1 << 20, bool)
            seen[(h[first] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_length[length] = (h[first], first.astype(np.int32), rows[first].astype(np.int32), seen)

    def nbytes(self) -> int:
        own = (self.ids, self.starts, self.ends, self.said)
        return sum(x.nbytes for x in (*own, *(y for z in self.by_length.values() for y in z)))

    def scan(self, low, starts, ends, rows, hashed):
        """Yields (first word, length, items) of each verified occurrence."""
        for length, (wanted, first, item, seen) in self.by_length.items():
            h = W.windows(hashed, length)
            if not len(h):
                continue
            at = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] & (rows[: len(h)] == rows[length - 1 :]))
            lower, upper = np.searchsorted(wanted, h[at]), np.searchsorted(wanted, h[at], "right")
            for i, x, y in zip(at[lower < upper].tolist(), lower[lower < upper].tolist(), upper[lower < upper].tolist(), strict=True):
                said = b" ".join(low[s:e].tobytes() for s, e in zip(starts[i : i + length], ends[i : i + length], strict=True))
                same = [k for k in range(x, y) if self.said[self.starts[first[k]] : self.ends[first[k] + length - 1]].tobytes() == said]
                if same:
                    yield i, length, set(self.ids[item[same]].tolist())


def _blocks(benchmark: DataFrame):
    """Items streamed to the driver, at most BLOCK_CHARS characters at a time."""
    block, chars = [], 0
    for r in benchmark.toLocalIterator():
        if block and chars + len(r[1] or "") > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((r[0], r[1]))
        chars += len(r[1] or "")
    yield block


def mark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with four more columns; the second result gives their names.

    n_words, hits (word positions hit), cuts (character-free byte spans of runs of
    hit words, [start, end, start, end, ...]), items (ids with an occurring window).
    """
    names = {k: free_name(docs.columns, k) for k in ("n_words", "hits", "cuts", "items")}
    fields = [T.StructField(names["n_words"], T.LongType())] + [T.StructField(names[k], T.ArrayType(T.LongType())) for k in ("hits", "cuts", "items")]
    before = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    at, text_at, out = len(before), docs.columns.index("text"), docs
    for nth, block in enumerate(_blocks(benchmark.select("item_id", "text"))):
        if nth:
            last, out = out, store(out, "marked")
            discard(last)
            shared.unpersist()
        shared, first = spark.sparkContext.broadcast(_Index(block, n)), nth == 0

        def run(batches, shared=shared, first=first):
            index = shared.value
            for batch in batches:
                data, offsets = utf8_view(batch.column(text_at))
                counts, hits, cuts, items = [], [], [], []
                for a, b in slices(offsets):
                    low = W.LOWER[data[offsets[a] : offsets[b]]]
                    own = offsets[a : b + 1] - offsets[a]
                    starts, ends, rows = W.split(low, own, W.WORD)
                    bounds = np.searchsorted(rows, np.arange(b - a + 1))
                    hit, by_row = np.zeros(len(starts), bool), {}
                    if not first:
                        for r in range(a, b):
                            hit[np.array(batch.column(at + 1)[r].as_py(), np.int64) + bounds[r - a]] = True
                            if had := batch.column(at + 3)[r].as_py():
                                by_row[r - a] = set(had)
                    for i, length, found in index.scan(low, starts, ends, rows, W.hashes(low, starts, ends)):
                        hit[i : i + length] = True
                        by_row.setdefault(int(rows[i]), set()).update(found)
                    for r in range(b - a):
                        where = np.flatnonzero(hit[bounds[r] : bounds[r + 1]])
                        counts.append(int(bounds[r + 1] - bounds[r]))
                        hits.append(where.tolist())
                        runs = np.split(where, np.flatnonzero(np.diff(where) > 1) + 1) if len(where) else []
                        cuts.append([int(x) for run in runs for x in (starts[bounds[r] + run[0]] - own[r], ends[bounds[r] + run[-1]] - own[r])])
                        items.append(sorted(by_row.get(r, ())))
                made = [pa.array(counts, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (hits, cuts, items))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *made], [*batch.schema.names[:at], *(f.name for f in fields)])

        out = out.mapInArrow(run, T.StructType(before + fields))
    return out, names


def judge(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked, c = mark(spark, docs.select("doc_id", "text"), benchmark.select(F.col("item_id").cast("long"), "text"), n)
    joined = F.concat_ws(",", F.sort_array(F.transform(c["items"], lambda x: x.cast("string"))))
    hit = F.size(c["hits"]).cast("long")
    return marked.select("doc_id", F.col(c["n_words"]).alias("n_words"), hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _without(text, cuts):
    """A text without byte spans [start, end, start, end, ...]."""
    raw, n = F.encode(text, "UTF-8"), F.size(cuts)
    first = lambda k: F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.get(cuts, 2 * k - 1))
    last = lambda k: F.when(2 * k == n, F.octet_length(raw).cast("bigint")).otherwise(F.get(cuts, 2 * k))
    kept = F.transform(F.sequence(F.lit(0), (n / 2).cast("int")), lambda k: F.substring(raw, (first(k) + 1).cast("int"), (last(k) - first(k)).cast("int")))
    return F.decode(F.aggregate(kept, F.lit(b""), lambda done, part: F.concat(done, part)), "UTF-8")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` without contamination: hit spans are cut out of the texts (n_chars, where
    there is one, follows), and documents go of which at least DROP_SHARE was hit."""
    marked, c = mark(spark, docs, benchmark.select(F.col("item_id").cast("long"), "text"), n)
    kept = marked.filter(F.size(c["hits"]) < F.greatest(F.lit(1.0), F.col(c["n_words"]) * DROP_SHARE))
    out = kept.withColumn("text", F.when(F.size(c["cuts"]) > 0, _without(F.col("text"), F.col(c["cuts"]))).otherwise(F.col("text"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS u, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) t(i)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT u, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, n, unnest(range(1, len(w) - n + 2)) t(i)),
h AS (SELECT u, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT u, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, n)) t(j) GROUP BY u),
q AS (SELECT u, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (u) LEFT JOIN q USING (u)
"""
