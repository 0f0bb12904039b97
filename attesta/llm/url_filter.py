"""URL filters: allow and block rules, and a Bloom filter cascade for listed hosts.

Rules name a host, which also stands for its subdomains, and the beginning of a
path; the longest rule that fits gives the verdict.  Where none fits, a host is
blocked if it is listed: by default, if a block rule hits any of its pages.

The list is kept as a Bloom filter cascade over all hosts of the corpus.  The
first level holds the listed hosts, the second the other hosts that the first
lets through, the third the listed hosts that the second lets through, and so on
until nothing passes wrongly.  The first level that refuses a host decides, so
membership is exact for every host of the corpus, and no join with hosts is
needed: the levels are binary literals in the scan's own expressions.

DataFrame functions only.  A level of over MOST_BYTES is dealt by the hosts' hash
into shards of 4,096 bytes, a small table whose shard a host's own hash picks; up
to BROADCAST_BYTES it is sent to all tasks, as measured.

Rows: a null URL or one without "://" has empty host and path and falls under no
rule; URLs of any length are read whole; of rules of one length that fit
the last by name counts; repeated rows give repeated rows; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import stored

BITS_A_KEY, HASHES = 8, 4
#: Largest level that is sent along as a literal, and as a table; bits in a shard of a larger one.
MOST_BYTES, BROADCAST_BYTES, SHARD_BITS = 4 << 20, 64 << 20, 32_768
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def level_bits(count: int) -> int:
    return 1 << max(10, math.ceil(math.log2(max(1, count) * BITS_A_KEY)))


def bitmap(keys: DataFrame, key: str, level: int, bits: int) -> bytes:
    """The level's bits, made by native bitmap aggregation, 32,768 bits a row."""
    at = keys.select(F.explode(F.array(*positions(F.col(key), level, bits))).alias("at")).select((F.col("at") + 1).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = bytearray(max(4096, bits // 8))
    for row in rows:  # at most MOST_BYTES / 4096 rows
        start = (row.bucket - 1) * 4096
        out[start : start + len(row.bits)] = row.bits
    return bytes(out)


def _set(data: Column, key: Column, level: int, bits: int) -> Column:
    out = F.lit(True)
    for at in positions(key, level, bits):
        byte = F.conv(F.hex(F.substring(data, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return out


@dataclass(frozen=True)
class Level:
    """One level: a literal, or a table (__shard, __bits) of ``shards`` bitmaps."""

    number: int
    bits: int
    held: bytes | None = None
    table: DataFrame | None = None
    shards: int = 0

    def marked(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` and whether their key passes."""
        if self.table is None:
            return rows.withColumn(name, _set(F.lit(bytearray(self.held)), F.col(key), self.number, self.bits))
        table = F.broadcast(self.table) if self.shards * SHARD_BITS // 8 <= BROADCAST_BYTES else self.table
        passes = F.col("__shard").isNotNull() & _set(F.col("__bits"), F.col(key), self.number, SHARD_BITS)
        return rows.join(table, shard_of(F.col(key), self.number, self.shards) == F.col("__shard"), "left").select(*rows.columns, passes.alias(name))


def shard_of(key: Column, level: int, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-level)), F.lit(shards))


def _level(keys: DataFrame, key: str, number: int, count: int, most_bytes: int) -> Level:
    bits = level_bits(count)
    if bits // 8 <= most_bytes:
        return Level(number, bits, held=bitmap(keys, key, number, bits))
    shards = -(-count * BITS_A_KEY // SHARD_BITS)
    at = keys.select(shard_of(F.col(key), number, shards).alias("__shard"), F.explode(F.array(*positions(F.col(key), number, SHARD_BITS))).alias("at"))
    table = at.groupBy("__shard").agg(F.bitmap_construct_agg("at").alias("__bits"))
    return Level(number, SHARD_BITS, table=stored(table, "level"), shards=shards)


def cascade(hosts: DataFrame, most_bytes: int = MOST_BYTES) -> list[Level]:
    """The levels over ``hosts`` (host, listed), one row a host."""
    levels: list[Level] = []
    left = {True: hosts.filter("listed").select("host"), False: hosts.filter("NOT listed").select("host")}
    side, count = True, left[True].count()
    while count:
        levels.append(_level(left[side], "host", len(levels) + 1, count, most_bytes))
        side = not side
        left[side] = levels[-1].marked(left[side], "host", "passes").filter("passes").select("host")
        count = left[side].count()
    return levels


def with_listed(rows: DataFrame, levels: list[Level], name: str) -> DataFrame:
    """``rows`` (with a column host) and whether the host is listed: the first level that refuses it decides."""
    columns, out = rows.columns, F.lit(len(levels) % 2 == 1)
    for level in levels:
        rows = level.marked(rows, "host", f"{name}_{level.number}")
    for level in reversed(levels):
        out = F.when(~F.col(f"{name}_{level.number}"), F.lit(level.number % 2 == 0)).otherwise(out)
    return rows.select(*columns, out.alias(name))


def url_filter(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict) of every page."""
    host, path = parts(F.col(url))
    judged = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": name, "ruled": verdict})
    hosts = stored(judged.groupBy("host").agg(F.coalesce(F.max(F.col("ruled") == "block"), F.lit(False)).alias("listed")), "hosts")
    judged = with_listed(judged, cascade(hosts, most_bytes), "listed")
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(key, "host", "path", "rule", verdict.alias("verdict"))
