"""URL filters: rules by host and path, and a domain list held in a Bloom filter cascade.

A cascade is exact on a known universe of keys. Level 1 encodes the listed keys; level 2 those other keys of
the corpus that pass level 1 by mistake; level 3 the listed keys that pass level 2, and so on until no mistake is left.
A key's answer is given by the first level that lacks it. The universe is every distinct host of the corpus with all its
parent domains.

The levels grow with the list, not with the corpus. They are built as tables of blocks by bit aggregates, whatever the length of the list,
and nothing of them is collected above ``MAX_BITS``. Up to that they are constants of the projection and probing needs no join;
those of a longer list stay tables, and each distinct key of the corpus is asked of one block a level. The levels, their bits
and the answers are the same either way.

Defined cases: a null url or one without ``://`` has empty host and path, and is allowed; an empty list lists
nothing; repeated rows are judged alike; of rules of equal length the first in code-point order wins. Columns named host,
path, rule or verdict are replaced, others pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, lower_ascii, read

#: (verdict, host, path), fixed values of the contract
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BLOCKED = ("ads-track.example.com", "cheap-pills.example.net", "spam-farm.example.org")
PROBES = 3
BITS_PER_KEY = 8
BLOCK_BITS = 1 << 15  # most bits of a block, the bitmap of Spark's aggregate
MAX_BITS = 1 << 22  # of all levels, up to which they are constants


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """The host and all its parent domains; none for an empty host."""
    parts = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


@dataclass
class Level:
    """One Bloom filter of a cascade as a table (block, bits): a key has its ``PROBES`` bits in one block."""

    number: int
    blocks: int
    size: int  # bits of a block
    table: DataFrame

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number)), F.lit(self.blocks))

    def places(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.size)) for i in range(PROBES)])

    def whole(self) -> bytes:
        """All blocks in one."""
        data = bytearray(self.blocks * self.size // 8)
        for r in self.table.toLocalIterator():
            data[r["block"] * self.size // 8 : (r["block"] + 1) * self.size // 8] = r["bits"]
        return bytes(data)


def _all_set(places: Column, data: Column) -> Column:
    """Whether the bits of all places are set."""

    def one(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (place % 8).cast("int")) == 1

    return F.forall(places, one)


def _level(store: Store, keys: DataFrame, count: int, number: int) -> Level:
    bits = 64
    while bits < min(BITS_PER_KEY * count, BLOCK_BITS):
        bits *= 2
    level = Level(number, max(1, -(-BITS_PER_KEY * count // BLOCK_BITS)), bits, keys)
    places = keys.select(level.block(F.col("key")).alias("block"), F.explode(level.places(F.col("key"))).alias("place"))
    maps = places.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    level.table = store.table(f"bits-{number}", maps.select("block", F.substring("bits", F.lit(1), F.lit(bits // 8)).alias("bits")))
    return level


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """The keys whose bits a level has, by a join with its blocks."""
    asked = keys.select("key", level.block(F.col("key")).alias("block")).join(level.table, "block")
    return asked.where(_all_set(level.places(F.col("key")), F.col("bits"))).select("key")


def cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """The levels for column ``key`` of both tables, for lists of any length."""
    store = Store(universe.sparkSession, "cascade")
    universe = universe.select("key").distinct()
    listed = store.table("listed", listed.select("key").distinct().join(universe, "key", "left_semi"))
    inside, outside = listed, store.table("others", universe.join(listed, "key", "left_anti"))
    levels: list[Level] = []
    while (count := inside.count()) > 0:
        levels.append(_level(store, inside, count, len(levels) + 1))
        inside, outside = store.table(f"wrong-{len(levels)}", _passing(outside, levels[-1])), inside
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed; the levels are constants of the expression."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        data, start = F.lit(bytearray(level.whole())), level.block(key) * level.size
        has = _all_set(F.transform(level.places(key), lambda p: p + start), data)  # noqa: B023
        answer = F.when(~has, F.lit(level.number % 2 == 0)).otherwise(answer)
    return answer


def members(keys: DataFrame, levels: list[Level]) -> DataFrame:
    """The listed ones of distinct keys of the universe; the levels stay tables, asked one after the other."""
    store = Store(keys.sparkSession, "members")
    left, found = store.table("asked", keys.select("key")), keys.select("key").where("false")
    for level in levels:
        passed = store.table(f"passed-{level.number}", _passing(left, level))
        if level.number % 2 == 0:
            found = found.union(left.join(passed, "key", "left_anti"))
        left = passed
    return found.union(left) if len(levels) % 2 else found


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict: the rule's, else block for listed domains, else allow."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    address = F.col(f"`{url}`")
    hosts = pages.select(host_of(address).alias("host")).distinct()
    universe = hosts.select(F.explode(domains(F.col("host"))).alias("key"))
    levels = cascade(universe, listed)
    rows = pages.select(*[F.col(f"`{c}`") for c in names], host_of(address).alias("host"), path_of(address).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if sum(level.blocks * level.size for level in levels) > MAX_BITS:
        store = Store(pages.sparkSession, "hosts")
        own = hosts.select("host", F.explode(domains(F.col("host"))).alias("key"))
        bad = own.join(members(universe.distinct(), levels), "key").select(F.col("host").alias("_host")).distinct()
        bad = store.table("listed", bad)
        rows, hit = rows.join(bad, F.col("host") == F.col("_host"), "left"), F.col("_host").isNotNull()
    else:
        hit = F.exists(domains(F.col("host")), lambda k: member(k, levels))
    return rows.select(
        *[F.col(f"`{c}`") for c in names], "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every page's url."""
    listed = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}')" for k in BLOCKED) + " AS t(key)")
    return judge(read(spark, sf, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


def _sql_cases(rules: tuple, what: int) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    value = (lambda r: r[1] + r[2]) if what else (lambda r: r[0])
    return " ".join(
        f"WHEN (host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}') THEN '{value(r)}'" for r in ordered
    )


OP6_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
)
SELECT page_id, host, path, CASE {_sql_cases(RULES, 1)} END AS rule,
       CASE {_sql_cases(RULES, 0)}
            {" ".join(f"WHEN host = '{d}' OR host LIKE '%.{d}' THEN 'block'" for d in BLOCKED)} ELSE 'allow' END AS verdict
FROM parts
"""
