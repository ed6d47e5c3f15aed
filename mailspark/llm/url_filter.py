"""URL filter: rules first, then a Bloom filter cascade over the corpus's host keys.

A key is a host or one of its parent domains.  The cascade is built over the
complete set of keys that occur in the corpus (the universe): level 1 encodes
the listed keys, level 2 the unlisted keys that level 1 lets through by
mistake, level 3 the listed keys that level 2 lets through, and so on until a
level has no mistakes.  For every key of that universe the answer is exact, and
no page is joined with the list.

A key is carried as a 128-bit hash, chained from the last label to the first, so
that all keys of a host cost one step a label however many labels it has; that
hash stands for the key.  The universe is cut into shards by it.  Every shard holds about
``SHARD_KEYS`` distinct keys, so one task builds one shard's levels in bounded
memory, however long the list is.  Looking up broadcasts the finished filters
when their measured size is at most ``BROADCAST_BYTES``; beyond that the
distinct keys are judged shard by shard and the verdicts go back over an
equi-join, which adaptive execution splits for hot hosts.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and has no key, so it is allowed.  An empty path fits no rule whose
path is ``/``.  Repeated rows are judged alike; an empty table gives an empty
result; further columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, drop_scratch, scratch

#: Distinct keys of one shard, about.
SHARD_KEYS = 200_000
#: Filters up to this size are broadcast; larger ones are probed shard by shard.
BROADCAST_BYTES = 64 << 20
#: Level 1 lets this share of the unlisted keys through; each later level half.
FIRST_FPR, LATER_FPR = 1 / 256, 0.5
MAX_LEVELS = 64

LEVELS_SCHEMA = "shard long, level int, n_bits long, n_hashes int, bits binary"


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``: both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    return (
        df.withColumn("host", F.translate(F.regexp_extract("_rest", r"(?s)^[^/?#]*", 0), upper, lower))
        .withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def rule_column(rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The longest fitting rule's string (``value`` 1) or verdict (0); null if none fits."""
    out = F.lit(None).cast("string")
    # later whens are weaker: the longest rule stands first
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        out = F.when(fits & F.col("path").startswith("/" + path), F.lit((verdict, rule)[value])).otherwise(out)
    return out


def suffix_hashes(host: str) -> list[bytes]:
    """128-bit hashes of a host and its parent domains, longest first; none of an empty host."""
    out, after = [], bytes(16)
    for label in reversed(host.split(".")) if host else ():
        after = xxhash.xxh3_128_digest(label.encode() + after)
        out.append(after)
    return out[::-1]


def _two_numbers(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return h[:, 0], h[:, 1]


def _own_hash(names: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each whole name; an empty one has the hash of an empty label."""
    return _two_numbers([(suffix_hashes(x) or suffix_hashes(".")[1:])[0] for x in names])


def _hash_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        h1, h2 = _own_hash(f["key"])
        yield pd.DataFrame({"h1": h1, "h2": h2})


def _hash_hosts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of at most ``batches``' size or one host: (g1, g2) of the host with (h1, h2) of each of its keys."""
    for f in batches(frames, column="host"):
        digests = [suffix_hashes(x) for x in f["host"]]
        n = [len(d) for d in digests]
        h1, h2 = _two_numbers([x for d in digests for x in d])
        g1, g2 = _two_numbers([d[0] for d in digests])
        yield pd.DataFrame({"g1": np.repeat(g1, n), "g2": np.repeat(g2, n), "h1": h1, "h2": h2})


def keys_of_hosts(judged: DataFrame) -> DataFrame:
    """(g1, g2, h1, h2): the hash of each distinct host and that of each of its keys."""
    hosts = judged.select("host").where("host <> ''").distinct()
    return hosts.mapInPandas(_hash_hosts, "g1 long, g2 long, h1 long, h2 long")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, n_bits: int, n_hashes: int) -> np.ndarray:
    """Bit numbers of each key on a level: double hashing, salted by the level."""
    a = _mixed(h1.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    b = _mixed(h2.view(np.uint64) ^ np.uint64(level)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(n_hashes, dtype=np.uint64)) % np.uint64(n_bits)


def _contains(level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    number, n_bits, n_hashes, bits = level
    at = _positions(h1, h2, number, n_bits, n_hashes)
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """The cascade of one shard: (level, bits, hashes, bit array) from 1 on; none if nothing is listed."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, int, int, np.ndarray]] = []
    while len(inside):
        number = len(levels) + 1
        if number > MAX_LEVELS:
            raise ValueError("the cascade does not end: two keys of the universe have the same 128-bit hash")
        rate = FIRST_FPR if number == 1 else LATER_FPR
        n_hashes = max(1, round(-math.log2(rate)))
        n_bits = max(64, math.ceil(len(inside) * n_hashes / math.log(2)))
        bits = np.zeros(n_bits // 8 + 1, np.uint8)
        at = _positions(h1[inside], h2[inside], number, n_bits, n_hashes).ravel()
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        levels.append((number, n_bits, n_hashes, bits))
        inside, outside = outside[_contains(levels[-1], h1[outside], h2[outside])], inside
    return levels


def probe(levels, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """True for listed keys: a key leaves at the first level that lacks it, and is listed if that level is even."""
    listed = np.zeros(len(h1), bool)
    at = np.arange(len(h1))
    for level in levels:
        at = at[_contains(level, h1[at], h2[at])]
        listed[at] = level[0] % 2 == 1
    return listed


def build_cascade(universe: DataFrame, shards: int) -> DataFrame:
    """universe: distinct (h1, h2) with ``listed``.  One row per shard and level."""

    def build(f: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(f.h1.to_numpy(), f.h2.to_numpy(), f.listed.to_numpy(bool))
        return pd.DataFrame(
            [(f["shard"].iloc[0], n, m, k, bits.tobytes()) for n, m, k, bits in levels],
            columns=["shard", "level", "n_bits", "n_hashes", "bits"],
        )

    sharded = universe.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(build, LEVELS_SCHEMA)


def _by_shard(rows) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["level"]):
        out.setdefault(r["shard"], []).append((r["level"], r["n_bits"], r["n_hashes"], np.frombuffer(bytes(r["bits"]), np.uint8)))
    return out


def _probe_all(by_shard: dict[int, list], shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out, shard = np.zeros(len(h1), bool), h1 % shards  # numpy's % of a negative number is not negative, as pmod
    for s in np.unique(shard):
        if levels := by_shard.get(int(s)):
            at = np.flatnonzero(shard == s)
            out[at] = probe(levels, h1[at], h2[at])
    return out


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    listed: DataFrame,
    id_col: str = "page_id",
    url: str = "url",
    broadcast_bytes: int = BROADCAST_BYTES,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every page.

    rules: (allow or block, ``host/path``), a short list of settings.  listed: a
    DataFrame with a column ``key`` of blocked hosts or domains.  A page is
    ``listed`` if its host or a parent domain is; that decides where no rule fits.
    """
    spark = pages.sparkSession
    judged = host_and_path(pages.select(F.col(id_col), F.col(url).alias("url")))
    listed = listed.select("key").where("key is not null").distinct().mapInPandas(_hash_keys, "h1 long, h2 long")
    keys = keys_of_hosts(judged).select("h1", "h2").distinct()
    universe = scratch(
        keys.join(listed.distinct().withColumn("listed", F.lit(True)), ["h1", "h2"], "left").select(
            "h1", "h2", F.coalesce("listed", F.lit(False)).alias("listed")
        ),
        "url-universe",
    )
    shards = max(1, math.ceil(universe.count() / shard_keys))
    cascade = scratch(build_cascade(universe, shards), "url-cascade")
    size = cascade.agg(F.sum(F.length("bits")).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast(_by_shard(cascade.collect()))
        drop_scratch(universe)

        @F.pandas_udf("boolean")
        def any_listed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for hosts in parts:
                at, names = pd.factorize(hosts)
                hit = np.zeros(len(names), bool)
                for k, name in enumerate(names):
                    if name:
                        hit[k] = _probe_all(held.value, shards, *_two_numbers(suffix_hashes(name))).any()
                yield pd.Series(hit[at])

        out = judged.withColumn("listed", any_listed("host"))
    else:

        def judge(key: tuple, f: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
            hit = probe(next(iter(_by_shard(levels.to_dict("records")).values()), []), f.h1.to_numpy(), f.h2.to_numpy())
            return pd.DataFrame({"h1": f.h1, "h2": f.h2, "hit": hit})

        @F.pandas_udf("g1 long, g2 long")
        def own_hash(hosts: pd.Series) -> pd.DataFrame:
            g1, g2 = _own_hash(hosts)
            return pd.DataFrame({"g1": g1, "g2": g2})

        sharded = universe.withColumn("shard", F.pmod("h1", F.lit(shards)))
        verdict = sharded.groupBy("shard").cogroup(cascade.groupBy("shard")).applyInPandas(judge, "h1 long, h2 long, hit boolean")
        hosts = keys_of_hosts(judged).join(verdict, ["h1", "h2"]).groupBy("g1", "g2").agg(F.max("hit").alias("listed"))
        named = judged.withColumn("g", own_hash("host")).select(F.struct(*judged.columns).alias("page"), "g.*")
        out = named.join(hosts, ["g1", "g2"], "left").select("page.*", F.when(F.col("page.host") != "", F.col("listed")).alias("listed"))
    by_rule = rule_column(rules, 0)
    return out.select(
        F.col(id_col),
        "host",
        "path",
        rule_column(rules, 1).alias("rule"),
        F.coalesce(by_rule, F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
    )
