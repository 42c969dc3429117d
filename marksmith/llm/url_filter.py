"""URL filter: host rules, then exact list membership by a cascade of Bloom filters; DataFrame operations only.

The list is a table of domains; a host is listed when it, or a domain above it, is there. The cascade knows
every host of the corpus, which one join labels when it is built. Level 0 encodes the listed hosts; level 1
the hosts not listed that level 0 lets through by mistake; level 2 the listed ones that level 1 lets
through, and so on until a level has no mistakes. A host's number of levels passed, even or odd, is then its
exact membership, and judging a url needs no join: the filters are bit words in the expression itself.

A cascade's words may take ``MAX_FILTER_BYTES``. Where the listed hosts need more, hosts are dealt to shards
by their hash, each with a cascade of its own below that bound, and each shard's urls are judged by theirs.

Defined results: a null url, or one without ``://``, has empty host and path and no rule, and is
allowed. A null or empty domain of the list fits nothing; repeated ones count once. Urls may be of any
length. Repeated rows are judged alike. An empty table gives an empty table, an empty list blocks nothing.
Only the id and the url are read, so extra columns may have any names.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: The domains that the registered query lists.
LISTED_DOMAINS = (
    "ads-track.example.com",
    "adult-x.example.net",
    "casino-win.example.com",
    "cheap-pills.example.com",
    "free-bets.example.com",
    "spam-farm.example.com",
)

#: The bit words of a cascade may take this much; listed hosts that need more are dealt to several cascades.
MAX_FILTER_BYTES = 16 << 20
FALSE_POSITIVES = 1 / 64


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null when none fits."""
    found = F.lit(None)
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def domains_of(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def labelled_hosts(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """(host, listed) of the distinct hosts of ``universe`` (host); ``listed`` (domain) is the list."""
    hosts = universe.select("host").distinct()
    domains = listed.select(F.col("domain").alias("above")).where("above <> ''").distinct()
    above = hosts.where("host <> ''").select("host", F.explode(F.array_distinct(domains_of(F.col("host")))).alias("above"))
    hit = above.join(domains, "above", "left_semi").select("host").distinct().withColumn("listed", F.lit(True))
    return hosts.join(hit, "host", "left").select("host", F.coalesce("listed", F.lit(False)).alias("listed"))


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded to one constant by the optimizer
        tests = [F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in self.positions(key)]
        every = tests[0]
        for test in tests[1:]:
            every = every & test
        return every


HASHES = max(1, round(-math.log2(FALSE_POSITIVES)))


def level_bytes(keys: int) -> int:
    """What the words of a level for so many keys take."""
    return 8 * max(1, math.ceil(keys * HASHES / math.log(2) / 64))


def _level(keys: DataFrame, count: int, seed: int) -> Level:
    bits = 8 * level_bytes(count)
    empty = Level((), bits, HASHES, seed)
    found = (
        keys.select(F.explode(F.array(*empty.positions(F.col("host")))).alias("p"))
        .groupBy((F.col("p") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("mask"))
    )
    words = [0] * (bits // 64)
    for row in found.collect():  # at most bits / 64 rows, which the shards keep below MAX_FILTER_BYTES
        words[row["word"]] = row["mask"]
    return Level(tuple(words), bits, HASHES, seed)


def build(hosts: DataFrame) -> list[Level]:
    """The cascade for ``hosts`` (host, listed)."""
    levels: list[Level] = []
    inside, outside = hosts.where("listed").select("host"), hosts.where("NOT listed").select("host")
    left = inside.count()
    while left:
        levels.append(_level(inside, left, len(levels)))
        # what this level lets through by mistake is what the next one encodes
        inside, outside = outside.where(levels[-1].passes(F.col("host"))), inside
        left = inside.count()
    return levels


def shard_of(host: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), host), F.lit(shards))


def build_shards(hosts: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> list[list[Level]]:
    """A cascade for each of as many shards of ``hosts`` (host, listed) as keep every cascade below the bound.

    The first level is sized by the listed hosts, the next by a share of FALSE_POSITIVES of the others, and each
    further pair of levels is that much smaller again.
    """
    listed, others = hosts.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    needed = 1.1 * (level_bytes(listed) + level_bytes(math.ceil(others * FALSE_POSITIVES))) if listed else 0
    shards = max(1, math.ceil(needed / max_bytes))
    return [build(hosts.where(shard_of(F.col("host"), shards) == k)) for k in range(shards)]


def is_member(levels: list[Level], host: Column) -> Column:
    """Exact for every host of the universe that the cascade was built over."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        answer = F.when(levels[k].passes(host), answer).otherwise(F.lit(k % 2 == 1))
    return answer


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row: the longest rule's verdict, else block for hosts listed by ``listed`` (domain)."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    cascades = build_shards(checkpointed(labelled_hosts(rows, listed)), max_bytes)
    judged = None
    for k, levels in enumerate(cascades):
        own = rows.where(shard_of(F.col("host"), len(cascades)) == k) if len(cascades) > 1 else rows
        own = own.withColumn("by_list", F.when(is_member(levels, F.col("host")), "block").otherwise("allow"))
        judged = own if judged is None else judged.unionByName(own)
    return (
        judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.col("by_list")).alias("verdict"))
    )


def domain_table(spark: SparkSession, domains=LISTED_DOMAINS) -> DataFrame:
    """A list given in code as a table (domain)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain"))
