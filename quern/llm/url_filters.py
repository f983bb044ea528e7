"""URL filters: a temporal join of captures with dated lists, in DataFrame functions only.

A list is a log of dated entries: a key (a host with all its subdomains, or a host and path prefix) goes
on a list or comes off it. Entries of a key become validity intervals that end where the next begins. A
capture asks for each of its own keys the entry in force at its fetch time (an as-of join), and the most
specific key in force decides; an `allow` entry frees what a wider `block` entry would stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import BROADCAST_ROWS, cut, small

#: Specificity of a path prefix besides its segments: more than any host has labels.
PATH_DEPTH = 1 << 24


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a trailing dot; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(host, r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column, labels: list[int] | None = None, segments: list[int] | None = None) -> Column:
    """(key, specificity) pairs of a URL: its host's suffixes from the right, then host and path prefixes.

    Of all suffixes and prefixes, or of those with the given numbers of labels and path segments.
    """
    host, path = host_of(url), path_of(url)
    parts = F.split(host, r"\.")
    n = F.size(parts)
    steps = F.sequence(F.lit(1), n) if labels is None else F.filter(_numbers(labels), lambda k: k <= n)
    hosts = F.transform(steps, lambda k: F.struct(F.array_join(F.slice(parts, n - k + 1, k), ".").alias("key"), k.alias("depth")))
    names = F.filter(F.split(path, "/"), lambda p: p != "")
    steps = F.filter(F.sequence(F.lit(0), F.size(names)), lambda k: k > 0) if segments is None else F.filter(_numbers(segments), lambda k: k <= F.size(names))
    prefixes = F.transform(steps, lambda k: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(names, 1, k), "/")).alias("key"), (k + PATH_DEPTH).alias("depth")))
    return F.when(host == "", F.array().cast("array<struct<key:string,depth:int>>")).otherwise(F.concat(hosts, prefixes))


def _numbers(of: list[int]) -> Column:
    return F.array(*map(F.lit, of)).cast("array<int>")


def depths(valid: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of labels of the host keys of a list and of segments of its path keys; keys of other depths can't match."""
    slashes, dots = (F.length("_key") - F.length(F.replace(F.col("_key"), F.lit(c))) for c in "/.")
    rows = valid.select((slashes > 0).alias("path"), F.when(slashes > 0, slashes).otherwise(dots + 1).alias("n")).distinct().collect()
    return sorted(r.n for r in rows if not r.path), sorted(r.n for r in rows if r.path)


def normal_key(key: Column) -> Column:
    """A list's key in the form that captures are asked for: no scheme, user, port, query or fragment, the host in lower
    case without dots at its ends, path segments parted by one slash. Null where no host is left."""
    bare = F.regexp_replace(F.trim(key), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/]*)", 1)), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^[*.]+|\.+$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(/.*)$", 1), "/+", "/"), "/$", "")
    return F.when(host != "", F.concat(host, path))


def key_faults(entries: DataFrame) -> DataFrame:
    """(list, key) of entries whose key has no host: they can't match any capture."""
    return entries.filter(F.col("key").isNotNull() & normal_key(F.col("key")).isNull()).select("list", "key").distinct()


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, at) to (list, key, action, since, until): in force from `at` to the key's next entry on that list.

    Keys are brought to one form first (`normal_key`), so `http://B.C:80/` is `b.c`; those without a host are left out
    (`key_faults` lists them). Entries with a null in any of the four say nothing and are left out. Of several entries of a key at
    one time the one whose action sorts last holds, so a block wins over an allow, and a removal over both.
    Repeated entries are one.
    """
    whole = entries.select("list", normal_key(F.col("key")).alias("key"), "action", "at").dropna()
    one = whole.groupBy("list", "key", "at").agg(F.max("action").alias("action"))
    nxt = F.lead("at").over(Window.partitionBy("list", "key").orderBy("at"))
    return one.withColumn("until", nxt).filter("action <> 'remove'").select("list", "key", "action", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """Every row of `captures` with blocked, by_list and by_key.

    A null or malformed URL has no keys and a null fetch time meets no interval: such rows are not
    blocked. With equal specificity a block wins, then the list that sorts first. Captures are first brought
    down to distinct (URL, fetch time). The list's intervals are broadcast if they are counted few enough;
    else they are joined by key, which Spark splits when a key is hot.
    """
    valid = intervals(entries).select(F.col("list").alias("_list"), F.col("key").alias("_key"), F.col("action").alias("_action"), "since", "until")
    valid = cut(valid, "intervals")
    n = valid.count()
    labels, segments = depths(valid)
    captures = captures.drop("blocked", "by_list", "by_key")
    rows = captures.select(F.struct(*captures.columns).alias("_row"), F.col(url).alias("_cu"), F.col(at).alias("_ct"))
    asked = rows.select(F.col("_cu").alias("_url"), F.col("_ct").alias("_at")).filter("_url IS NOT NULL AND _at IS NOT NULL").distinct()
    keyed = asked.select("_url", "_at", F.explode_outer(keys_of(F.col("_url"), labels, segments)).alias("_k"))
    met = keyed.join(small(valid, n), (F.col("_k.key") == F.col("_key")) & (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    # the most specific key first, then block before allow, then the list's name
    best = met.groupBy("_url", "_at").agg(F.min(F.struct((-F.col("_k.depth")).alias("d"), F.when(F.col("_action") == "block", 0).otherwise(1).alias("a"), F.col("_list").alias("l"), F.col("_key").alias("k"))).alias("_b"))
    # rows without a URL or a time match nothing: each is dealt by a number of its own, not all by one null
    deal = F.when(F.col("_cu").isNull() | F.col("_ct").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    rows = rows.withColumn("_deal", deal)
    joined = rows.join(best.withColumn("_one", F.lit(-1).cast("long")), (F.col("_cu") == F.col("_url")) & (F.col("_ct") == F.col("_at")) & (F.col("_deal") == F.col("_one")), "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in captures.columns], F.coalesce(F.col("_b.a") == 0, F.lit(False)).alias("blocked"), F.col("_b.l").alias("by_list"), F.col("_b.k").alias("by_key"))
