"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Tokens are lower-cased words between white space and one end per text. The
probability of a word w after v is

    l2(b) c(v, w) / c(v)  +  l1(b) c(w) / N  +  l0(b) / (V + 1)

where b is the bucket of the context's frequency, floor(log2 c(v)) + 1 (0: never
seen). The weights of each bucket are learned by expectation-maximisation on
deleted counts: every training token is held out once, from counts without it.

How the counts meet the texts: texts are gathered into chunks of about
``CHUNK_BYTES``; a chunk sends each of its distinct n-grams once, as packed arrays
of 64-bit hashes with its training counts, one array for each of ``FAN`` ranges of
the hash. While a range would hold more than ``OWNER_TOKENS``, the arrays of FAN
chunks meet in a task that parts them by the next FAN ranges, so each level has at
most FAN rows a chunk, however many chunks and ranges there are. The last range's
owner adds up, and totals go back the same way in the order they were asked. A
common word costs each chunk one entry, so no owner is hot. All tokens of the input
take part in every step; the driver only gets sums over a fixed grid of cells.

Defined cases: a null or empty text is its end alone; null doc_ids are not held
out, so their texts are learned from; repeated rows count as often as they come; a
very long text is a chunk of its own; equal scores are left as they are; an empty
table gives no rows; without training texts all weight is uniform; other columns
don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import discard, in_batches, slices, store, table, utf8_view
from .language_id import held_out

CHUNK_BYTES = 4 << 20
#: Tokens of the input per owner, and bits of the hash by which a level parts n-grams.
OWNER_TOKENS, FAN_BITS = 4_000_000, 9
BUCKETS, GRID, ROUNDS = 34, 96, 60
END, BEGIN = np.uint64(0x5DEECE66D1234567), np.uint64(0x27BB2EE687B0B0FD)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw)), kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes as steps, byte by byte of all of them, whose upper bytes shrink to little."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _pack(steps.view(np.uint8).reshape(-1, 8).T)


def _unpack_sorted(raw: bytes) -> np.ndarray:
    planes = _unpack(raw, np.uint8).reshape(8, -1)
    return np.add.accumulate(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


CHUNK = "doc_ids array<long>, held binary, sizes binary, vocabulary binary, codes binary, tokens long"


def _chunks(most: int):
    """Texts as codes into a sorted vocabulary of hashes, many to a row."""

    def flush(some):
        ids, held = sum((x[0] for x in some), []), np.concatenate([x[1] for x in some])
        sizes, tokens = np.concatenate([x[2] for x in some]).astype(np.uint32), np.concatenate([x[3] for x in some])
        vocabulary, codes = np.unique(tokens, return_inverse=True)
        row = [[ids], [_pack(held)], [_pack(sizes)], [_pack_sorted(vocabulary)], [_pack(codes.astype(np.uint32))], [len(tokens)]]
        types = [pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["doc_ids", "held", "sizes", "vocabulary", "codes", "tokens"])

    def run(batches):
        some, size = [], 0
        for batch in batches:
            data, offsets = utf8_view(batch.column(2))
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(offsets):
                low, own = W.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                starts, ends, rows = W.split(low, own, W.NOT_SPACE)
                bounds = np.searchsorted(rows, np.arange(b - a + 1))
                tokens = np.insert(W.hashes(low, starts, ends), bounds[1:], END)
                some.append((ids[a:b], held[a:b], np.diff(bounds) + 1, tokens))
                size += len(low) + 8 * (b - a)
                if size >= most:
                    yield flush(some)
                    some, size = [], 0
        if some:
            yield flush(some)

    return run


def _bigrams(vocabulary: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each token and the one before it in its text."""
    now = vocabulary[codes]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[np.cumsum(sizes, dtype=np.int64) - sizes] = BEGIN
    with np.errstate(over="ignore"):
        return W.mix(before * np.uint64(0x9E3779B97F4A7C15) + W.mix(now))


def _opened(row: dict):
    sizes, held = _unpack(row["sizes"], np.uint32).astype(np.int64), _unpack(row["held"], bool)
    return _unpack_sorted(row["vocabulary"]), _unpack(row["codes"], np.uint32).astype(np.int64), sizes, held


def home(chunks: np.ndarray, level: int, many: int, bits: int) -> np.ndarray:
    """The group in which chunks meet at a level; groups of one level stay together at the next."""
    group = np.asarray(chunks).astype(np.uint64)
    for k in range(2, level + 1):
        group = W.mix(group + np.uint64(k)) % np.uint64(max(1, -(-many >> bits * (k - 1))))
    return group.astype(np.int64)


ASKED = "part long, kind int, home long, members array<long>, sizes binary, grams binary, counts binary"


def _requests(many: int, bits: int):
    """Of each chunk and range its n-grams in order, with their training counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, codes, sizes, held = _opened(row)
                learned = np.repeat(~held, sizes)
                grams, inverse = np.unique(_bigrams(vocabulary, codes, sizes), return_inverse=True)
                at = int(home([row["chunk"]], 2, many, bits)[0])
                out = []
                for kind, keys, where in ((1, vocabulary, codes), (2, grams, inverse)):
                    counts = np.bincount(where[learned], minlength=len(keys)).astype(np.uint32)
                    bounds = [0, *np.searchsorted(keys >> np.uint64(64 - bits), np.arange(1, 1 << bits, dtype=np.uint64)).tolist(), len(keys)]
                    for part, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        if b > a:
                            out.append((part, kind, at, [row["chunk"]], _pack(np.array([b - a], np.uint32)), _pack_sorted(keys[a:b]), _pack(counts[a:b])))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], _names(ASKED))

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _joined(rows: pd.DataFrame, column: str, kind):
    """The arrays of all rows one after another, and the member of each entry."""
    sizes = np.concatenate([_unpack(x, np.uint32) for x in rows["sizes"]]).astype(np.int64)
    values = np.concatenate([_unpack(x, kind) if kind else _unpack_sorted(x) for x in rows[column]])
    return values, np.repeat(np.arange(len(sizes)), sizes), len(sizes)


def _spread(level: int, many: int, bits: int):
    """One range's arrays of a group of chunks, parted by the ranges of the next level."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = np.concatenate([np.asarray(m, np.int64) for m in pdf["members"]])
        keys, member, n = _joined(pdf, "grams", None)
        counts = np.concatenate([_unpack(x, np.uint32) for x in pdf["counts"]])
        sub = ((keys >> np.uint64(64 - bits * level)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        bounds = np.searchsorted(sub[order], np.arange((1 << bits) + 1))
        part, kind = int(pdf["part"].iloc[0]), int(pdf["kind"].iloc[0])
        up = int(home(members[:1], level + 1, many, bits)[0])
        out = []
        for q, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:
                at = order[a:b]
                out.append(((part << bits) | q, kind, up, members, _pack(np.bincount(member[at], minlength=n).astype(np.uint32)), _pack_sorted(keys[at]), _pack(counts[at])))
        return pd.DataFrame(out, columns=_names(ASKED))

    return run


TOLD = "part long, kind int, home long, members array<long>, sizes binary, totals binary, distinct long, learned long"


def _own(level: int, many: int, bits: int):
    """Totals of the n-grams of one range, for each request in its order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, rows in pdf.groupby("kind"):
            keys = [_unpack_sorted(x) for x in rows["grams"]]
            counts = np.concatenate([_unpack(x, np.uint32) for x in rows["counts"]])
            each, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(inverse, counts, len(each)).astype(np.uint64)
            distinct, learned = int((totals > 0).sum()), int(totals.sum())
            for row, part in zip(rows.itertuples(), np.split(inverse, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                at = int(home(row.members[:1], level, many, bits)[0])
                out.append((row.part, int(kind), at, row.members, row.sizes, _pack(totals[part]), distinct, learned))
                distinct = learned = 0
        return pd.DataFrame(out, columns=_names(TOLD))

    return run


def _gathered(level: int, many: int, bits: int):
    """Totals of a group of chunks from the ranges of a level, as the level before asked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        members = np.asarray(pdf["members"].iloc[0], np.int64)
        totals, at, _ = _joined(pdf, "totals", np.uint64)
        member = at % len(members)  # every row has all members of the group, in one order
        group = home(members, level - 1, many, bits)
        part, kind = int(pdf["part"].iloc[0]) >> bits, int(pdf["kind"].iloc[0])
        order = np.argsort(member, kind="stable")
        sizes = np.bincount(member, minlength=len(members))
        ends = np.cumsum(sizes)
        out, k = [], 0
        while k < len(members):  # a group of the level before is a run of members
            last = k + int(np.argmax(np.append(group[k:] != group[k], True)))
            own = totals[order[ends[k] - sizes[k] : ends[last - 1]]]
            out.append((part, kind, int(group[k]), members[k:last], _pack(sizes[k:last].astype(np.uint32)), _pack(own), 0, 0))
            k = last
        return pd.DataFrame(out, columns=_names(TOLD))

    return run


COUNTED = "doc_ids array<long>, held binary, sizes binary, codes binary, words binary, pairs binary"


def _counted(batches):
    """Chunks with the training counts of their words, and of each token's bigram."""
    for batch in batches:
        for row in batch.to_pylist():
            vocabulary, codes, sizes, _ = _opened(row)
            by = {1: [], 2: []}
            for part in sorted(row["parts"], key=lambda x: x["part"]):
                by[part["kind"]].append(_unpack(part["totals"], np.uint64))
            inverse = np.unique(_bigrams(vocabulary, codes, sizes), return_inverse=True)[1]
            pairs = np.concatenate(by[2])[inverse]
            end = np.concatenate(by[1])
            made = [[row["doc_ids"]], [row["held"]], [row["sizes"]], [row["codes"]], [_pack(end)], [_pack(pairs)]]
            types = [pa.list_(pa.int64()), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types, strict=True)], _names(COUNTED))


def _token_counts(row: dict, ends: int):
    """c(v, w), c(v), c(w) of each token, and the texts' sizes and folds."""
    sizes, held = _unpack(row["sizes"], np.uint32).astype(np.int64), _unpack(row["held"], bool)
    word = _unpack(row["words"], np.uint64)[_unpack(row["codes"], np.uint32)].astype(np.float64)
    pair = _unpack(row["pairs"], np.uint64).astype(np.float64)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(sizes) - sizes] = ends  # as many texts begin as end
    return pair, context, word, sizes, held


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that never came, else 1 + floor(log2 of its frequency)."""
    return np.minimum(np.where(context > 0, np.frexp(context)[1], 0), BUCKETS - 1).astype(np.int64)


def estimates(pair, context, word, total: int):
    """Bigram and unigram maximum-likelihood estimates."""
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(1, total)


def _cell(p: np.ndarray) -> np.ndarray:
    """Half-octave of a probability; the last one is for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(-2 * np.log2(np.maximum(p, 1e-300)), GRID - 2).astype(np.int64), GRID - 1)


def _deleted(total: int, ends: int):
    """Per chunk: number and summed estimates of the training tokens in each cell."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pair, context, word, sizes, held = _token_counts(row, ends)
                on = np.repeat(~held, sizes)
                p2, p1 = estimates(pair[on] - 1, context[on] - 1, word[on] - 1, total - 1)
                cell = (bucket(context[on] - 1) * GRID + _cell(p2)) * GRID + _cell(p1)
                used, at = np.unique(cell, return_inverse=True)
                made = [used, np.bincount(at, minlength=len(used)), np.bincount(at, p2, len(used)), np.bincount(at, p1, len(used))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["cell", "n", "p2", "p1"])

    return run


def learn_weights(cells: list[tuple[int, int, float, float]], distinct: int) -> np.ndarray:
    """Weights (BUCKETS, 3) of bigram, unigram and uniform estimates by EM.

    A bucket without held-out tokens takes the weights of the bucket below it."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    p0 = 1.0 / (distinct + 1)
    by: dict[int, list] = {}
    for cell, n, p2, p1 in cells:
        by.setdefault(cell // (GRID * GRID), []).append((n, p2 / n, p1 / n))
    for b in range(BUCKETS):
        if b not in by:
            weights[b] = weights[b - 1] if b else weights[b]
            continue
        n, p2, p1 = np.array(sorted(by[b])).T
        p = np.stack([p2, p1, np.full(len(n), p0)])
        w = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.7, 0.3])
        for _ in range(ROUNDS):
            mixed = w[:, None] * p
            w = (mixed / np.maximum(mixed.sum(axis=0), 1e-300) * n).sum(axis=1) / n.sum()
            w = np.maximum(w, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
            w /= w.sum()
        weights[b] = w
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(total: int, distinct: int, ends: int, weights: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pair, context, word, sizes, held = _token_counts(row, ends)
                p2, p1 = estimates(pair, context, word, total)
                w = weights[bucket(context)]
                p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (distinct + 1)
                base = np.log10((word + 1) / (total + 1.0 * (distinct + 1)))
                first = np.cumsum(sizes) - sizes
                made = [row["doc_ids"], held, sizes, np.add.reduceat((word > 0).astype(np.int64), first), [total] * len(sizes), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)]
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types, strict=True)], _names(SCORED))

    return run


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, owner_tokens: int = OWNER_TOKENS, bits: int = FAN_BITS) -> DataFrame:
    """One row per document of (doc_id, text, held_out): see SCORED."""
    spark = docs.sparkSession
    with in_batches(spark):
        chunks = store(docs.select("doc_id", "held_out", "text").mapInArrow(_chunks(chunk_bytes), CHUNK).select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")
    many, tokens = chunks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    owners = max(1, -(-tokens // owner_tokens))
    levels = max(1, -(-(owners - 1).bit_length() // bits))
    with in_batches(spark, 1):  # a row is a whole chunk
        asked = chunks.select("chunk", "sizes", "held", "vocabulary", "codes").mapInArrow(_requests(many, bits), ASKED)
        for level in range(2, levels + 1):
            asked = asked.groupBy("kind", "part", "home").applyInPandas(_spread(level, many, bits), ASKED)
        told = store(asked.repartition(owners, "part").groupBy("part").applyInPandas(_own(levels, many, bits), TOLD), "totals")
        distinct, total = told.filter("kind = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("learned"), F.lit(0))).first()
        ends = docs.filter(~F.col("held_out")).count()
        answers = told
        for level in range(levels, 1, -1):
            answers = answers.withColumn("above", F.shiftright("part", bits)).groupBy("kind", "above", "home").applyInPandas(_gathered(level, many, bits), TOLD)
        parts = answers.groupBy(F.col("home").alias("chunk")).agg(F.collect_list(F.struct("kind", "part", "totals")).alias("parts"))
        counted = store(chunks.drop("tokens").join(parts, "chunk").drop("chunk").mapInArrow(_counted, COUNTED), "counted")
        for df in (chunks, told):
            discard(df)
        cells = counted.mapInArrow(_deleted(total, ends), "cell long, n long, p2 double, p1 double")
        sums = cells.groupBy("cell").agg(F.sum("n"), F.sum("p2"), F.sum("p1")).collect()  # at most BUCKETS * GRID * GRID
        weights = learn_weights([tuple(r) for r in sums], distinct)
        out = store(counted.mapInArrow(_scored(total, distinct, ends, weights), SCORED), "scores")
        discard(counted)
    return out


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select(F.col("doc_id").cast("long"), "text", held_out(7, 2).alias("held_out")))
