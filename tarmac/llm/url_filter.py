"""URL filter: a cascade of Bloom filters gives exact membership without joins.

Rules are ``host/path`` keys. The key universe of a corpus is every key that one of its urls
could be listed under: each suffix of its host at a label boundary, with each prefix of its
path as long as some rule's path. Level 1 encodes the listed keys; level 2 the keys of the
universe that level 1 lets through although they are not listed; level 3 the listed keys that
level 2 lets through; and so on, until a level lets nothing wrong through. A key's membership
is then the parity of the first level that refuses it: exact over the whole universe.

Level 1 is sized by both sets: it lets through about as many wrong keys as there are listed ones,
and each later level half of what it is shown. So the bits grow with the listed keys, times the logarithm
of how many unlisted keys come to one of them, whatever the size of the corpus.

Every level is a bitmap built by grouped bit positions. It enters the plan as a literal array, so
judging a url is a projection over the scan: no join, no shuffle, no Python. Rules so many that level 1
would take more than ``LITERAL_BITS`` are looked up by an exact join of the distinct hosts and paths instead.

Nulls, empty urls and urls without ``://`` have an empty host and path, match no rule and get
the default verdict. Repeated rows get equal results; columns other than the two named are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import ascii_lower, broadcast_if_small, stored

#: bits of a level (128 KB) up to which it is a literal of the plan
LITERAL_BITS = 1 << 20
#: keys (some tens of bytes each) up to which a side of a join is broadcast
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    key: str

    @property
    def host(self) -> str:
        return self.key.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.key.split("/", 1)[1]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def candidate_keys(host: Column, path: Column, path_lengths: Sequence[int], max_labels: int) -> Column:
    """Keys a url could be listed under: host suffixes of up to ``max_labels`` labels (no rule has
    more) with path prefixes of the rules' lengths."""
    labels = F.split(host, r"\.")
    hosts = [F.when(F.size(labels) >= k, F.substring_index(host, ".", -k)) for k in range(1, max_labels + 1)]
    keys = [F.when(F.char_length(path) >= n, F.concat(h, F.substring(path, 1, n)))
            for h in hosts for n in path_lengths]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*keys)))


def _bit(position: Column) -> Column:
    """The position's bit within its 64-bit word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))


@dataclass(frozen=True)
class Level:
    """A bitmap of 64-bit words; a key has ``hashes`` positions, steps of one hash from another one."""

    seed: int
    hashes: int
    words: np.ndarray

    def positions(self, key: Column) -> Column:
        return _positions(key, self.seed, self.hashes, len(self.words) * 64)

    def passes(self, key: Column) -> Column:
        bitmap = F.lit(self.words)
        return F.forall(self.positions(key), lambda p: F.get(bitmap, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0)


def _positions(key: Column, seed: int, hashes: int, bits: int) -> Column:
    first, step = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
    # the hashes are cut to the bits before they are combined: nothing overflows
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)),
                       lambda i: F.pmod(F.pmod(first, F.lit(bits)) + i * F.pmod(step, F.lit(bits)), F.lit(bits)))


def sized(inside: int, outside: int, first: bool) -> tuple[int, int]:
    """Hashes and bits (whole words) of a level for ``inside`` keys, so that of ``outside`` others about as many as
    the keys pass (first level), or half (later ones)."""
    hashes = max(1, math.ceil(math.log2(max(outside, 1) / max(inside, 1)))) if first else 1
    return hashes, 64 * max(1, math.ceil(inside * hashes / math.log(2) / 64))


def _level(keys: DataFrame, seed: int, hashes: int, bits: int) -> Level:
    """The level of ``keys``: ``bits / 64`` words come to the driver at most."""
    words = np.zeros(bits // 64, dtype=np.int64)
    rows = (keys.select(F.explode(_positions(F.col("key"), seed, hashes, bits)).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(_bit(F.col("p"))).alias("v"))
            .collect())
    for r in rows:
        words[r.w] = r.v
    return Level(seed, hashes, words)


class Cascade:
    """Levels of a Bloom filter cascade; :meth:`listed` is an exact membership test over the
    universe the cascade was built for."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most: int | None = None) -> "Cascade | None":
        """``listed`` and ``universe`` hold a column ``key``; the listed keys outside the universe
        are encoded as well. Both are deduplicated and written before their hashes are combined, and what a level
        lets through wrongly is written once. None if level 1 would have more than ``most`` bits."""
        listed = stored(listed.select("key").distinct(), "listed-keys")
        others = stored(universe.select("key").distinct().join(broadcast_if_small(listed, BROADCAST_KEYS), "key", "left_anti"), "other-keys")
        levels: list[Level] = []
        inside, outside = listed, others  # keys the next level must let through, and refuse
        shown = others.count()
        while True:
            count = inside.count()
            if count == 0:
                return cls(levels)
            hashes, bits = sized(count, shown, not levels)
            if bits > (LITERAL_BITS if most is None else most):
                return None
            levels.append(_level(inside, len(levels), hashes, bits))
            wrong = stored(outside.where(levels[-1].passes(F.col("key"))), "wrong-keys")
            inside, outside, shown = wrong, inside, count

    def listed(self, key: Column) -> Column:
        """The first level that refuses a key tells: an even number of passed levels, not listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self.levels[level].passes(key), out).otherwise(F.lit(level % 2 == 1))
        return out


def _judged_by_join(keyed: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    """The way for rules that are too many for literals: each distinct host and path meets its rules in a join."""
    rules = stored(rules, "rules")
    keys = keyed.select("host", "path", "_keys").distinct().select("host", "path", F.explode("_keys").alias("key"))
    best = F.max_by(F.struct("key", "_verdict"), F.struct(F.char_length("key"), F.col("key")))
    fits = stored(keys.join(broadcast_if_small(rules, BROADCAST_KEYS), "key").groupBy("host", "path").agg(best.alias("_rule")), "rules-that-fit")
    return keyed.join(broadcast_if_small(fits, BROADCAST_KEYS), ["host", "path"], "left").select(
        id_col, "host", "path", F.col("_rule.key").alias("rule"), F.coalesce("_rule._verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``id, host, path, rule, verdict`` of every row: the longest rule that fits, by the cascade."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    lengths = sorted({len(r.path) for r in rules})
    labels = max((r.host.count(".") + 1 for r in rules), default=1)
    rows = pages.select(F.col(id_col), F.col(url_col)).select(
        id_col, host.alias("host"), path.alias("path"))
    keyed = rows.select("*", candidate_keys(F.col("host"), F.col("path"), lengths, labels).alias("_keys"))
    if not rules:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    listed = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, _verdict string").dropDuplicates(["key"])
    cascade = Cascade.build(listed, keyed.select(F.explode("_keys").alias("key")))
    if cascade is None:
        return _judged_by_join(keyed, listed, id_col, default)
    fits = F.filter("_keys", cascade.listed)
    best = F.element_at(F.array_sort(F.transform(fits, lambda k: F.struct(
        (-F.char_length(k)).alias("n"), k.alias("key")))), 1)["key"]
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.verdict)])
    judged = keyed.select(id_col, "host", "path", F.when(F.size(fits) > 0, best).alias("rule"))
    return judged.select(id_col, "host", "path", "rule",
                         F.coalesce(F.element_at(verdicts, F.col("rule")), F.lit(default)).alias("verdict"))
