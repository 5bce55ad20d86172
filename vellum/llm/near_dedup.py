"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the multiset of its windows of five words (one window of all words if
there are fewer; words as in ``words.WORD``). Two texts are linked if the
weighted Jaccard similarity of their multisets is 0.8 or more; classes are what
links connect.

Signatures: a window of weight w owns the weights [0, w). That axis is cut into
dyadic shells [0,1), [1,2), [2,4), ...; each shell has a Poisson process with
its width as rate, whose points carry a component and, by coin flips down the
shell's binary tree, a weight level. A component keeps the earliest point among
all levels below w. Points come in order of time, so a text is finished when the
next points of all its shells are later than the latest of its components.
Components of two texts agree with probability equal to the similarity.

Candidates share a band and agree in ``AGREE`` of the components, which a pair of
similarity 0.8 misses with probability under 1e-6. Copies (equal word sequences)
are one node. Every bucket first tests one leader against its members, then
another one against the members of other classes. What then still lies in
different classes of one bucket meets in tiles of bounded size: components first,
and texts of those alone that agree with a member of another class. A tile lets
out links between classes only, one less than it has classes at most, so no link
inside a bucket is lost, and large groups of copies never become all pairs. Links
become classes by contraction: each round works on the classes that still have
links between them. Large buckets are dealt out in parts of ``PART`` members.

Defined cases: null texts and texts without words have a class of their own;
class_id is the least doc_id of the class that isn't null (null where all are); rows with
equal doc_ids are judged by their texts; ties between leaders go to the larger
fingerprint, which changes no class; very long texts are taken alone, as a whole; an
empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import MOST_ROWS, discard, free_name, in_batches, slices, store, table, utf8_view

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
#: Components of 120 in which a pair of similarity 0.8 agrees, but for one in a million.
AGREE = 73
#: Members of a bucket that a task compares with as many others.
TILE = 256
#: Members of a bucket that stay together where no pair of them is compared.
PART = 1024
_LOW52 = np.uint64((1 << 52) - 1)


def bags(data: np.ndarray, offsets: np.ndarray):
    """Per distinct window: row, 52-bit hash, count; and each row's number of words.

    A window's row takes the 12 bits over its hash, as ``slices`` gives no more rows."""
    n = len(offsets) - 1
    if n > MOST_ROWS:
        raise ValueError(f"{n} rows, not {MOST_ROWS}")
    low = W.LOWER[data]
    starts, ends, rows = W.split(low, offsets, W.WORD)
    hashed = W.hashes(low, starts, ends)
    bounds = np.searchsorted(rows, np.arange(n + 1))
    counts = np.diff(bounds)
    h = W.windows(hashed, SHINGLE)
    whole = rows[: len(h)] == rows[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    keys = [(rows[: len(h)][whole].astype(np.uint64) << np.uint64(52)) | (h[whole] & _LOW52)]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(counts == size)
        if len(short):
            with np.errstate(over="ignore"):
                value = np.full(len(short), size, np.uint64)
                for j in range(size):
                    value = W.mix(value * np.uint64(31) + hashed[bounds[short] + j])
            keys.append((short.astype(np.uint64) << np.uint64(52)) | (value & _LOW52))
    key = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(52)).astype(np.int64), key & _LOW52, weight, counts


def prints(data: np.ndarray, offsets: np.ndarray) -> list:
    """A 128-bit digest of each text's words, or None where it has none."""
    low = W.LOWER[data]
    inside = W.WORD[low]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # and what stands behind a word
    said = np.where(inside, low, 32).astype(np.uint8)[kept]
    at = np.concatenate(([0], np.cumsum(kept)))[offsets]
    plain = (said[a:b].tobytes().strip() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    return [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in plain]


def signatures(rows: np.ndarray, hashed: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """(n, m) arrival times; rows without windows stay at infinity."""
    best = np.full(n * m, np.inf)
    # one process per window and shell that its weight reaches
    shells = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1, 1)
    of = np.repeat(np.arange(len(rows)), shells)
    shell = np.arange(len(of)) - np.repeat(np.cumsum(shells) - shells, shells)
    low = np.where(shell > 0, np.left_shift(1, np.maximum(shell - 1, 0)), 0)
    width = np.where(shell > 0, low, 1)
    with np.errstate(over="ignore"):
        seed = W.mix(hashed[of] * np.uint64(0x9E3779B97F4A7C15) + shell.astype(np.uint64))
    row, most, clock = rows[of], weight[of], np.zeros(len(of))
    point = 0
    while len(row):
        steps = int(np.clip(65536 // len(row), 1, 64))
        with np.errstate(over="ignore"):
            s = W.mix(seed[:, None] + np.arange(point + 1, point + steps + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        gap = -np.log(((s >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0) / width[:, None]
        when = clock[:, None] + np.cumsum(gap, axis=1)
        part = ((s & np.uint64(0xFFFF)) * np.uint64(m)) >> np.uint64(16)
        place = row[:, None] * m + part.astype(np.int64)
        if (width > 1).any():
            level = low[:, None] + ((((s >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64) * width[:, None]) >> 16)
            inside = level < most[:, None]
            np.minimum.at(best, place[inside], when[inside])
        else:
            np.minimum.at(best, place.ravel(), when.ravel())
        latest = best.reshape(n, m).max(axis=1)
        clock = when[:, -1]
        on = clock < latest[row]
        seed, row, most, clock, low, width = seed[on], row[on], most[on], clock[on], low[on], width[on]
        point += steps
    return best.reshape(n, m)


def band_hashes(best: np.ndarray) -> np.ndarray:
    bits = best.view(np.uint64).reshape(len(best), BANDS, ROWS)
    out = np.zeros((len(best), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            out = W.mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return out.view(np.int64)


def marks(best: np.ndarray) -> np.ndarray:
    """A byte of each component."""
    return (W.mix(best.view(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)


SKETCH = "doc_id long, key string, node binary, bands array<long>, marks binary"


def _sketch(batches):
    for batch in batches:
        data, offsets = utf8_view(batch.column(2))
        nodes, bands, marked = [], [], []
        for a, b in slices(offsets):
            some, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            rows, h, w, _ = bags(some, own)
            best = signatures(rows, h, w, b - a)
            made, bytes_of = band_hashes(best), marks(best)
            for r, node in enumerate(prints(some, own)):
                nodes.append(node)
                bands.append(made[r] if node else None)
                marked.append(bytes_of[r].tobytes() if node else None)
        made = [pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marked, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "key", "node", "bands", "marks"])


def similarities(data_a, offsets_a, data_b, offsets_b) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in each row, exactly."""
    n = len(offsets_a) - 1
    (ra, ha, wa, _), (rb, hb, wb, _) = bags(data_a, offsets_a), bags(data_b, offsets_b)
    ka, kb = (ra.astype(np.uint64) << np.uint64(52)) | ha, (rb.astype(np.uint64) << np.uint64(52)) | hb
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(ra[ia], np.minimum(wa[ia], wb[ib]), n)
    total = np.bincount(ra, wa, n) + np.bincount(rb, wb, n) - both
    return np.where(total > 0, both / np.maximum(total, 1), 0.0)


def _verify(batches):
    for batch in batches:
        (da, oa), (db, ob) = utf8_view(batch.column(2)), utf8_view(batch.column(3))
        found = [similarities(da[oa[a] : oa[b]], oa[a : b + 1] - oa[a], db[ob[a] : ob[b]], ob[a : b + 1] - ob[a]) for a, b in slices(oa + ob)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found) if found else [], pa.float64())], ["a", "b", "similarity"])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of a binary column whose values all have that width."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _agree(batches):
    """Pairs (a, b) whose marks agree in enough places."""
    for batch in batches:
        alike = (_bytes(batch.column(2), COMPONENTS) == _bytes(batch.column(3), COMPONENTS)).sum(axis=1) >= AGREE
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike))


def components(links: DataFrame) -> DataFrame:
    """(node, label): one label for the nodes that links (a, b) connect, itself one of them.

    Every node takes its least neighbour's least neighbour; links between what is
    then still apart are the next round's."""
    edges = store(links.select(*_pair("a", "b")).filter("a <> b").distinct(), "links", light=16)
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        far = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = store(near.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("to")), "steps", light=16)
        rest = edges
        for end in ("a", "b"):
            rest = rest.join(step.withColumnsRenamed({"node": end, "to": f"to_{end}"}), end)
        rest = store(rest.select(*_pair("to_a", "to_b")).filter("a <> b").distinct(), "links", light=16)
        known = step.withColumnRenamed("to", "label") if labels is None else _moved(labels, step)
        known = store(known, "labels", light=16)
        for df in (edges, step, labels):
            discard(df)
        edges, labels = rest, known
        if not edges.limit(1).count():
            discard(edges)
            return labels


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _moved(labels: DataFrame, step: DataFrame) -> DataFrame:
    """``labels``, each label that has a step replaced by where that goes."""
    return labels.join(step.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after links (a, b) between nodes or labels, of which some had no label yet."""
    between = links
    for end in ("a", "b"):
        known = labels.withColumnsRenamed({"node": end, "label": "of"})
        between = between.join(known, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    step = components(between).withColumnRenamed("label", "to")
    own = step.select("node", F.col("node").alias("label"))
    out = store(_moved(labels.unionByName(own).distinct(), step), "labels", light=16)
    for df in (labels, step):
        discard(df)
    return out


def _parts(size: str):
    return F.ceil(F.col(size) / PART).cast("int")


def _part(size: str):
    """The part of a bucket that a node belongs to."""
    return F.pmod(F.xxhash64("node"), _parts(size)).cast("int").alias("part")


def _each_part(per_bucket: DataFrame) -> DataFrame:
    """A row for each part of each bucket, to be joined with its members."""
    return per_bucket.withColumn("part", F.explode(F.sequence(F.lit(0), _parts("size") - 1))).drop("size")


TILED = "bucket long, x int, y int, band int, node binary, label binary, odd boolean"


def _tiled(left: DataFrame) -> DataFrame:
    """Members of the buckets as rows of tiles: those outside of a bucket's largest class
    ("odd") meet all its members, TILE by TILE."""
    across, down = (F.ceil(n / TILE).cast("int") for n in (F.col("size"), F.col("size") - F.col("main.n")))
    place = F.xxhash64("node", F.lit("tile"))
    of = ("bucket", "band", "node", "label")
    member = left.select(*of, F.lit(False).alias("odd"), F.pmod(place, across).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), down - 1)).alias("y"))
    odd = left.filter("label <> main.label").select(*of, F.lit(True).alias("odd"), F.explode(F.sequence(F.lit(0), across - 1)).alias("x"), F.pmod(place, down).cast("int").alias("y"))
    return member.unionByName(odd).select(*[c.split()[0] for c in TILED.split(", ")])


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def _groups(batches, keys: int = 3):
    """Tables of the rows with equal first columns, which come one after another."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        bounds = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(of[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(tile: pa.Table):
    """Rows of members and of odd ones, labels as numbers; then for each odd row the
    members' rows of other labels that agree with it, but in no earlier band."""
    odd = tile["odd"].to_numpy(zero_copy_only=False).astype(bool)
    label = tile["label"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    mark = _bytes(tile["marks"].combine_chunks(), COMPONENTS)
    band = tile["band"][0].as_py()
    bands = pc.list_flatten(tile["bands"].combine_chunks()).to_numpy(zero_copy_only=False).reshape(-1, BANDS)[:, :band]
    members = np.flatnonzero(~odd)
    for o in np.flatnonzero(odd).tolist():
        alike = ((mark[members] == mark[o]).sum(axis=1) >= AGREE) & (label[members] != label[o])
        some = members[alike]
        some = some[~(bands[some] == bands[o]).any(axis=1)]
        if len(some):
            yield o, some, label


def _survivors(batches):
    """Rows of the tiles that have a candidate of another class."""
    for tile in _groups(batches):
        on = np.zeros(tile.num_rows, bool)
        for o, some, _ in _candidates(tile):
            on[o] = on[some] = True
        if on.any():
            yield from tile.select([c.split()[0] for c in TILED.split(", ")]).filter(pa.array(on)).to_batches()


def _links(batches):
    """Labels (a, b) that a pair of similar texts links, a spanning forest of each tile."""
    for tile in _groups(batches):
        names, bag = tile["label"].to_pylist(), {}
        data, offsets = utf8_view(tile["text"])
        for a, b in slices(offsets):
            rows, hashed, weight, _ = bags(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = np.searchsorted(rows, np.arange(b - a + 1))
            bag |= {a + r: (hashed[at[r] : at[r + 1]], weight[at[r] : at[r + 1]]) for r in range(b - a)}
        root = list(range(tile.num_rows))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for o, some, label in _candidates(tile):
            (h, w), total = bag[o], bag[o][1].sum()
            for k in some.tolist():
                x, y = find(label[o]), find(label[k])
                if x == y:
                    continue
                hk, wk = bag[k]
                at = np.minimum(np.searchsorted(h, hk), len(h) - 1)
                both = np.minimum(w[at], wk)[h[at] == hk].sum()
                if both >= SIMILAR * (total + wk.sum() - both):
                    root[x] = y
                    out.append((names[o], names[k]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class)."""
    with in_batches(docs.sparkSession):
        return _classes(docs)


def _classes(docs: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", F.md5("text").alias("key"), "text")
    sketch = store(keyed.mapInArrow(_sketch, SKETCH), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")
    nodes = store(sketch.filter("node is not null").groupBy("node").agg(first, F.any_value("bands").alias("bands"), F.any_value("marks").alias("marks")), "nodes", light=8)

    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", "band", F.xxhash64("band", "hash").alias("bucket"))
    sizes = store(banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes", light=8)
    shared = store(banded.join(sizes, "bucket").select("*", _part("size")), "shared", light=8)
    # texts near the middle of a group share bands with most others: the best leaders
    weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = shared.join(weights, "node")
    leaders = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("leader"), F.any_value("size").alias("size"))
    buckets = store(weighed.join(_each_part(leaders), ["bucket", "part"]), "buckets", light=8)

    seen = weights.select("node").join(nodes.select("node", "rep.doc_id", "rep.key"), "node")
    t = keyed.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "text")
    texts = store(seen.join(t, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text").dropDuplicates(["node"]), "texts")

    def with_both(pairs: DataFrame, of: DataFrame, what: str) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(of.select(F.col("node").alias(end), F.col(what).alias(f"{what}_{end}")), end)
        return pairs.select("a", "b", f"{what}_a", f"{what}_b")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose texts are similar."""
        alike = with_both(pairs, nodes, "marks").mapInArrow(_agree, "a binary, b binary")
        verified = with_both(alike, texts, "text").mapInArrow(_verify, "a binary, b binary, similarity double")
        return store(verified.filter(F.col("similarity") >= SIMILAR).select("a", "b"), "tested", light=8)

    def mixed(labels: DataFrame) -> DataFrame:
        """Buckets of three or more whose members have several classes, with the largest."""
        known = buckets.filter("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        per = known.groupBy("bucket", "label", "size").agg(F.count("*").alias("n"))
        main = per.groupBy("bucket", "size").agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
        return store(known.join(_each_part(main), ["bucket", "part"]), "mixed", light=8)

    star = linked(buckets.filter("node <> leader").select(*_pair("node", "leader")).distinct())
    labels = components(star)
    left = mixed(labels)
    if left.limit(1).count():
        # a second leader: the weightiest member outside the largest class
        second = left.filter("label <> main.label").groupBy("bucket").agg(F.max(F.struct("weight", "node", "label")).alias("lead"), F.any_value("size").alias("size"))
        pairs = left.join(_each_part(second), ["bucket", "part"]).filter("label <> lead.label and node <> leader and lead.node <> leader")
        labels = merged(labels, linked(pairs.select(*_pair("node", "lead.node")).distinct()))
        discard(left)
        left = mixed(labels)
    if left.limit(1).count():
        near = _by_tile(_tiled(left).join(nodes.select("node", "bands", "marks"), "node")).mapInArrow(_survivors, TILED)
        near = store(near, "near", light=8)
        whole = near.join(nodes.select("node", "bands", "marks"), "node").join(texts, "node")
        of = [*(c.split()[0] for c in TILED.split(", ")), "bands", "marks", "text"]
        found = _by_tile(whole.select(*of)).mapInArrow(_links, "a binary, b binary")
        labels = merged(labels, store(found.distinct(), "rest", light=8))
        discard(near)

    member = nodes.select("node", "rep.doc_id").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "doc_id")
    least = store(member.groupBy("label").agg(F.min("doc_id").alias("class_id")), "least", light=8)
    known = store(member.join(least, "label").select("node", "class_id"), "classes", light=8)
    for df in (sizes, shared, buckets, texts, nodes, star, left, least, labels):
        discard(df)
    out = sketch.select("doc_id", "node").join(known, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one with the least doc_id, nulls last, and
    of its rows with equal doc_ids that of the least number. A text without words is a
    class of its own, row by row."""
    number, group = free_name(docs.columns, "row_number"), free_name(docs.columns, "class_node")
    rows = store(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    # the number stands in for the doc_id, so that rows with equal ids are told apart
    own = F.col("doc_id").cast("long")
    found = classes(rows.select(F.col(number).alias("doc_id"), "text")).withColumnsRenamed({"doc_id": number, "class_id": group})
    ids = rows.select(number, own.alias("id"))
    first = found.join(ids, number).groupBy(group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", number)).alias("first"))
    return rows.join(first.select(F.col(f"first.{number}").alias(number)), number, "left_semi").select(*docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
