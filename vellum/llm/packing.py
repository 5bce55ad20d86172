"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document becomes the ids of its tokens and one end id; only what is longer
than a sequence is cut, into pieces of the full length and one rest. Full pieces
fill sequences of their own. Rests are dealt evenly into shards of about
``SHARD`` pieces, and each shard is packed by ``ISLANDS`` populations that live
in different tasks: crossover injects whole well-filled sequences of one parent,
removes the sequences that hold duplicates of their pieces, and best-fits the
displaced pieces, longest first. After each epoch every island sends its best
packing to the next one. Pieces of badly filled sequences of all shards meet in
another round.

Defined cases: null and empty texts are one piece that holds the end id; null
doc_ids and repeated rows are pieces like any other; an empty table gives no
rows; columns beside doc_id and text are ignored; very long texts are tokenised as a
whole; pieces of equal length go in order of their number, packings of equal score in
order of their island. A sequence's pieces follow one
another without gaps from offset 0.

Size: the only shuffles deal out rows of a few numbers a piece; a task holds one
shard. Shards, epochs and islands don't depend on the data beyond their count.
"""

from __future__ import annotations

import bisect
import json
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import in_batches, slices, store, table, utf8_view

CAPACITY = 2048
SHARD = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 30
POPULATION = 4
#: Sequences filled less than this are taken apart and meet those of other shards.
WELL_FILLED = 0.97
#: Words whose ids a worker remembers; at this number it begins anew.
WORDS_KEPT = 400_000
END = b"\0\0\0\0"
PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"

_TAIL = np.zeros(256, bool)
_TAIL[list(b".,!?;:")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_words: dict = {}


def _letters_only(word: str) -> bool:
    """Letters that stay letters in lower case."""
    return word.isalpha() and word.lower().isalpha()


def _cuts_safely(tokenizer) -> bool:
    """Whether a tokenizer's settings are those that ``Words`` relies on."""
    said = json.loads(tokenizer.to_str())
    model = said["model"]
    rules = (said["normalizer"], said["pre_tokenizer"], said["post_processor"], [t["content"] for t in said["added_tokens"]])
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    return rules == (NORMAL, SPLIT, None, SPECIAL) and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and plain


# The settings of word_bpe_49k.json.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
SPECIAL = ["<|startoftext|>", "<|endoftext|>"]


class Texts:
    """Ids of whole texts by any tokenizer, without special tokens."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw = data.tobytes()
        return [np.array(self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


class Words:
    """Ids of words by the tokenizer, without special tokens, each word once.

    The tokenizer lowers case, drops white space and never joins across it, so
    texts are cut at ASCII white space; it also ends a token where one of
    ``.,!?;:`` follows an ASCII letter or digit, so they are cut there too. Words
    of letters alone end in one token that is marked as an end, so that many can
    be tokenised as one text. A table of word hashes leads to the ids.
    """

    def __init__(self, tokenizer, most: int = WORDS_KEPT):
        self.tokenizer, self.most = tokenizer, most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self):
        self.table, self.ids, self.filled = W.Numbering(), np.zeros(1 << 16, np.uint32), 0
        self.at = np.zeros((1 << 14, 2), np.int64)

    def _letters(self, words: list[bytes]) -> list[np.ndarray]:
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or len(ids) != ends[-1]:
            return self._any(words)
        return np.split(ids, ends[:-1])

    def _any(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _learn(self, hashed: np.ndarray, words: list[bytes]) -> None:
        plain = np.array([w.isalpha() or _letters_only(w.decode()) for w in words], bool)
        found: list = [None] * len(words)
        letters, others = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        for a in range(0, len(letters), 500):
            some = letters[a : a + 500]
            for k, ids in zip(some, self._letters([words[k] for k in some]), strict=True):
                found[k] = ids
        for k, ids in zip(others, self._any([words[k] for k in others]), strict=True):
            found[k] = ids
        sizes = np.array([len(x) for x in found], np.int64)
        first, n = self.table.size, self.filled + int(sizes.sum())
        while n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(words) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.filled : n] = np.concatenate(found)
        self.at[first : first + len(words), 0] = self.filled + np.cumsum(sizes) - sizes
        self.at[first : first + len(words), 1] = sizes
        self.filled = n
        self.table.add(hashed, np.arange(first, first + len(words), dtype=np.int32))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        # special tokens' strings are found before case is lowered
        low = data if b"<|" in data.tobytes() else W.LOWER[data]
        cut = np.zeros(len(low), bool)
        cut[1:] = _TAIL[low[1:]] & _ALNUM[low[:-1]]
        starts, ends, rows = W.split(low, offsets, W.NOT_SPACE, cut)
        hashed = W.hashes(low, starts, ends)
        if self.table.size > self.most:
            self._forget()
        number = self.table.find(hashed)
        new = np.flatnonzero(number < 0)
        if len(new):
            value, first = np.unique(hashed[new], return_index=True)
            raw = low.tobytes()
            self._learn(value, [raw[starts[k] : ends[k]] for k in new[first].tolist()])
            number[new] = self.table.find(hashed[new])
        at, size = self.at[number, 0], self.at[number, 1]
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(at - before, size) + np.arange(int(size.sum()))]
        bounds = np.append(before, len(ids))[np.searchsorted(rows, np.arange(len(offsets)))]
        return np.split(ids, bounds[1:-1]) if len(offsets) > 1 else []


def token_ids(column: pa.Array, path: str):
    """The ids of each text of a column, in slices of bounded size."""
    if path not in _words:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _words[path] = Words(tokenizer) if _cuts_safely(tokenizer) else Texts(tokenizer)
    data, offsets = utf8_view(column)
    for a, b in slices(offsets):
        yield from _words[path](data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; uid is unique among the rows once they are stored."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), token_ids(batch.column(1), path), strict=True):
                raw = ids.astype("<u4").tobytes() + END
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a : a + 4 * capacity]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, SCHEMA.types, strict=True)], SCHEMA.names)

    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE.removeprefix("uid long, "))
    return cut.select(F.monotonically_increasing_id().alias("uid"), "*")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def best_fit(order, lengths, bins: list[list[int]], fills: list[int], capacity: int) -> None:
    """Put each piece, in this order, where it leaves the least room."""
    room = sorted((capacity - f, b) for b, f in enumerate(fills))
    for item in order:
        size = lengths[item]
        at = bisect.bisect_left(room, (size, -1))
        if at == len(room):
            b = len(bins)
            bins.append([item])
            fills.append(size)
            left = capacity - size
        else:
            left, b = room.pop(at)
            left -= size
            bins[b].append(item)
            fills[b] += size
        bisect.insort(room, (left, b))


def fitness(fills, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones (mean squared fill)."""
    return -len(fills), sum((f / capacity) ** 2 for f in fills) / max(1, len(fills))


class Packing:
    def __init__(self, bins, fills, capacity):
        self.bins, self.fills, self.score = bins, fills, fitness(fills, capacity)

    def labels(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out

    @classmethod
    def of(cls, labels: np.ndarray, lengths, capacity):
        bins: list[list[int]] = [[] for _ in range(int(labels.max()) + 1)] if len(labels) else []
        for i, b in enumerate(labels.tolist()):
            bins[b].append(i)
        return cls(bins, [sum(lengths[i] for i in x) for x in bins], capacity)


def cross(a: Packing, b: Packing, lengths, capacity: int, rng: random.Random) -> Packing:
    """Whole well-filled sequences of ``a`` enter ``b``; what they displace is best-fitted."""
    ranked = sorted(range(len(a.bins)), key=a.fills.__getitem__, reverse=True)
    pool = ranked[: max(1, len(ranked) // 2)]
    injected = [a.bins[k] for k in rng.sample(pool, rng.randint(1, max(1, len(pool) // 2)))]
    held = {i for items in injected for i in items}
    bins, fills, loose = [list(x) for x in injected], [sum(lengths[i] for i in x) for x in injected], []
    survivors = [(f, x) for f, x in zip(b.fills, b.bins, strict=True)]
    clean = []
    for f, items in survivors:
        if held.isdisjoint(items):
            clean.append((f, items))
        else:
            loose += [i for i in items if i not in held]
    clean.sort(key=lambda x: x[0])
    weak = clean[: min(len(clean), rng.randint(0, 4))]  # mutation: some badly filled ones open up
    loose += [i for _, items in weak for i in items]
    for f, items in clean[len(weak) :]:
        bins.append(list(items))
        fills.append(f)
    best_fit(sorted(loose, key=lambda i: (-lengths[i], i)), lengths, bins, fills, capacity)
    return Packing(bins, fills, capacity)


def first_packings(lengths, capacity: int, rng: random.Random, size: int) -> list[Packing]:
    out = []
    for k in range(size):
        noise = 0 if k == 0 else 0.15 * k
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i] * (1 + noise * rng.random()), i))
        bins: list[list[int]] = []
        fills: list[int] = []
        best_fit(order, lengths, bins, fills, capacity)
        out.append(Packing(bins, fills, capacity))
    return out


def evolve(population: list[Packing], lengths, capacity: int, rng: random.Random, generations: int) -> list[Packing]:
    least = -(-sum(lengths) // capacity)
    for _ in range(generations):
        population.sort(key=lambda p: p.score, reverse=True)
        if len(population[0].bins) <= least:
            break
        a, b = rng.sample(population, 2)
        for parents in ((a, b), (b, a)):
            child = cross(*parents, lengths, capacity, rng)
            if child.score > population[-1].score:
                population[-1] = child
                population.sort(key=lambda p: p.score, reverse=True)
    return sorted(population, key=lambda p: p.score, reverse=True)


def _epoch(capacity: int, epoch: int):
    return lambda key, pdf: _island(key, pdf, capacity, epoch)


def _island(key, pdf: pd.DataFrame, capacity: int, epoch: int) -> pd.DataFrame:
    """One epoch of one island; its rows hold the shard's lengths and the packings so far."""
    shard, island = int(key[0]), int(key[1])
    rng = random.Random(1_000_003 * shard + 101 * island + epoch)
    sizes = np.frombuffer(pdf["lengths"].iloc[0], np.int32)
    lengths = sizes.tolist()
    had = sorted({bytes(x) for raw in pdf["packings"] if raw is not None for x in raw})
    population = [Packing.of(np.frombuffer(x, np.int32), lengths, capacity) for x in had]
    population += first_packings(lengths, capacity, rng, max(0, POPULATION - len(population)))
    population = evolve(sorted(population, key=lambda p: p.score, reverse=True)[:POPULATION], lengths, capacity, rng, GENERATIONS)
    return pd.DataFrame({"shard": [shard], "island": [island], "lengths": [sizes.tobytes()], "packings": [[p.labels(len(lengths)).tobytes() for p in population]], "n_bins": [len(population[0].bins)], "score": [population[0].score[1]]})


STATE = "shard long, island int, lengths binary, packings array<binary>, n_bins long, score double"
PLACED = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, shard long, sequence long, offset long, fill long"


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("uid")
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "lengths": [pdf["length"].to_numpy(np.int32).tobytes()]})


def _placed(pieces_: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    pdf = pieces_.sort_values("uid").reset_index(drop=True)
    pdf["sequence"] = np.frombuffer(best["labels"].iloc[0], np.int32).astype(np.int64)
    pdf["offset"] = pdf.groupby("sequence")["length"].cumsum() - pdf["length"]
    pdf["fill"] = pdf.groupby("sequence")["length"].transform("sum")
    return pdf[[c.split()[0] for c in PLACED.split(", ")]]


def pack_rests(rests: DataFrame, capacity: int, epochs: int, round_: int) -> DataFrame:
    """Rows of PLACED for rows of PIECE that are shorter than a sequence."""
    spark = rests.sparkSession
    shards = max(1, -(-rests.count() // SHARD))
    dealt = rests.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(shards)))
    lengths = dealt.select("shard", "uid", "length").groupBy("shard").applyInPandas(_gathered, "shard long, lengths binary")
    islands = lengths.select("shard", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "lengths", F.lit(None).cast("array<binary>").alias("packings"))
    tasks = min(shards * ISLANDS, int(spark.conf.get("spark.sql.shuffle.partitions")))  # rows are few, but each is long work
    for epoch in range(epochs):
        state = store(islands.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch), STATE), "islands")
        elites = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), "lengths", F.slice("packings", 1, 1).alias("packings"))
        islands = state.select("shard", "island", "lengths", "packings").unionByName(elites)
    best = state.groupBy("shard").agg(F.min_by(F.element_at("packings", 1), F.struct("n_bins", -F.col("score"), "island")).alias("labels"))
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(_placed, PLACED)


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with in_batches(spark):
        cut = store(pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), capacity), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # a full piece's number is even, a packed sequence's odd: the uid of its first piece
    full = cut.filter(F.col("length") == capacity).select(*columns, (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = store(pack_rests(cut.filter(F.col("length") < capacity), capacity, EPOCHS, 0), "packed", light=8)
    well = F.col("fill") >= WELL_FILLED * capacity
    rest = first.filter(~well).select(*[c.split()[0] for c in PIECE.split(", ")])
    second = pack_rests(rest, capacity, 1, 1)

    def numbered(df):
        key = F.min(F.struct("offset", "uid"))
        ids = df.groupBy("shard", "sequence").agg((key.getField("uid") * 2 + 1).alias("sequence_id"))
        return df.join(ids, ["shard", "sequence"]).select(*columns, "sequence_id", "offset")

    return full.unionByName(numbered(first.filter(well))).unionByName(numbered(second))


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
