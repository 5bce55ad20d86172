"""URL filters: path rules, then a Bloom filter cascade over the corpus's hosts.

A rule (host, path) fits its host and all subdomains if the url's path starts
with the rule's; the longest one wins. Urls that no rule fits are judged by a
list of hosts. A cascade holds the list exactly: level 1 encodes the listed
hosts, level 2 the other hosts of the corpus that pass level 1, level 3 the
listed hosts that pass level 2, and so on until nothing passes wrongly. Membership is
then a few bit tests on the row's own host: no join, exact for each host of the
universe it was built over. All of it is DataFrame expressions.

The list of the query: hosts with more than half of their pages blocked by rules.

Defined cases: a null url, or one without ``://``, has an empty host and path,
which no rule fits and no list holds (allow); repeated rows are judged one by
one; rules that fit with equal length are one host and path, so they don't tie; a very
long url is judged as a whole; an empty table gives no rows; an empty list allows
all; other columns are ignored, and names that clash are not used.

Size: hosts are counted with map-side combination. A filter takes ``BITS`` bits a
key and travels with the tasks as one value; beyond ``MOST_BITS`` the hosts are
split by hash into shards, each with a cascade of its own; hosts and pages are then
stored by shard once, so that each row is read once more, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

BITS, HASHES = 12, 6
MOST_BITS = 1 << 26

# Fixed values: (verdict, host, path) of the rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule's text and verdict, or nulls."""
    said = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        said, verdict = F.when(fits, F.lit(h + p)).otherwise(said), F.when(fits, F.lit(v)).otherwise(verdict)
    return said, verdict


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(HASHES)]


def build(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the filter of the column ``key``, as an array of 64-bit words."""
    place = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("at"))
    set_ = place.select((F.col("at") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    zero = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_.unionByName(zero).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def passes(made: DataFrame, key: Column, level: int, bits: int) -> Column:
    words = made.select("words").scalar()
    tests = [F.getbit(F.get(words, (at / 64).cast("int")), (at % 64).cast("int")) == 1 for at in _places(key, level, bits)]
    return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Exact membership among the rows of ``universe`` (key, listed), keys distinct."""

    def __init__(self, universe: DataFrame, name: str = "cascade"):
        self.levels: list[tuple[DataFrame, int]] = []
        encode, against, level = universe.filter("listed").select("key"), universe.filter("not listed").select("key"), 1
        count = encode.count()
        while count:
            bits = 64 * max(1, -(-count * BITS // 64))
            made = store(build(encode, level, bits), f"{name}-{level}")
            self.levels.append((made, bits))
            wrong = store(against.filter(passes(made, F.col("key"), level, bits)), f"{name}-wrong-{level}")
            encode, against, level, count = wrong, encode, level + 1, wrong.count()

    def holds(self, key: Column) -> Column:
        inside: Column | None = None
        for level in range(len(self.levels), 0, -1):
            made, bits = self.levels[level - 1]
            one = passes(made, key, level, bits)
            inside = one if inside is None else one & ~inside
        return F.lit(False) if inside is None else inside


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": verdict})
    counts = parsed.filter("host <> ''").groupBy(F.col("host").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    universe = store(counts.select("key", (F.col("blocked") * 2 > F.col("n")).alias("listed")), "hosts")
    shards = max(1, -(-universe.count() * BITS // MOST_BITS))
    if shards > 1:  # each shard then reads its own rows alone
        shard = lambda c: F.pmod(F.xxhash64(c, F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
        spread = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
        universe = store(universe.select("*", shard("key")).repartition("shard"), "hosts-by-shard", by="shard")
        salted = parsed.select("*", shard("host")).repartition("shard", F.pmod(F.xxhash64("page_id"), F.lit(spread)))
        parsed = store(salted, "pages-by-shard", by="shard")
    out = []
    for k in range(shards):
        own = (lambda df: df.filter(F.col("shard") == k)) if shards > 1 else (lambda df: df)  # noqa: B023
        cascade = Cascade(own(universe), f"cascade-{k}")
        listed = (F.col("host") != "") & cascade.holds(F.col("host"))
        out.append(own(parsed).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(listed, "block").otherwise("allow")).alias("verdict")))
    return reduce(DataFrame.unionByName, out)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


SQL = r"""
WITH r(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
a AS (SELECT page_id, row_number() OVER () AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
f AS (SELECT u, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM b, r WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY u),
j AS (SELECT b.*, rule, v FROM b LEFT JOIN f USING (u)),
l AS (SELECT host, sum((v = 'block')::INT) * 2 > count(*) AS listed FROM j GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN j.host <> '' AND listed THEN 'block' ELSE 'allow' END) AS verdict FROM j JOIN l USING (host)
"""
