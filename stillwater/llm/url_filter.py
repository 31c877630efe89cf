"""URL filters: a blocked Bloom filter before an exact join (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_SHARE, cut, free_name, lookup

#: Bits of a block (four 64-bit words) and bits that an entry sets in its block, one in each word.
BLOCK_BITS, WORDS = 256, 4
#: Listed entries for each block; about 0.1 % of the keys that are not listed pass.
PER_BLOCK = 16


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), "(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def bloom_blocks(keys: DataFrame, key_col: str, blocks: int) -> DataFrame:
    """The blocks that have bits: ``block, w0 .. w3``; an aggregate that combines before it shuffles."""
    hashed = keys.select(_block(F.col(key_col), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key_col)))))
    return hashed.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each url by the longest listed rule that fits it.

    ``rules`` has ``host, path, verdict``.  A rule fits its host and all
    subdomains if the path of the url starts with the rule's.  The keys of a
    url are the endings of its host at a dot, each with the beginnings of its
    path that have the length of some rule's path.  A blocked Bloom filter of
    the listed keys (built by an aggregate, four bits in one block for each key) passes the few keys
    that may be listed to a hash join that compares them in full.  The filter
    and the rules are broadcast if the list has at most ``BROADCAST_ROWS``
    rows; else both joins shuffle, and keys are made distinct first, so that a
    url or host that many rows share meets the list once.

    Returns all columns of ``pages`` with ``host, path, rule, verdict`` set
    (columns of these names are replaced, others may have any name);
    without a rule that fits, ``rule`` is null and ``verdict`` is ``default``.
    Null urls and urls without ``://`` have an empty host and path, which no
    rule fits.  Repeated rows are judged each, an empty table gives an empty
    result, an empty list leaves all to the default.  Of equally long rules the larger in text order wins.
    """
    listed = rules.select(F.concat("host", "path").alias("_rule"), "verdict", F.length("path").alias("_n")).filter(F.col("_rule").isNotNull())
    listed = listed.groupBy("_rule").agg(F.min("verdict").alias("_verdict"), F.max("_n").alias("_n"))
    n = listed.count()
    small = F.broadcast if n <= BROADCAST_ROWS else lambda x: x
    lengths = sorted(r[0] for r in listed.select("_n").distinct().collect())  # no more than a url has characters
    blocks = max(1, -(-n // PER_BLOCK))
    bits = bloom_blocks(listed, "_rule", blocks)

    parsed = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    urls = parsed.filter(F.col("host") != "").groupBy("host", "path").agg(F.count("*").alias("_rows"))
    labels = F.split("host", "\\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.lit(x) for x in lengths)), lambda x: x <= F.length("path"))
    keys = F.flatten(F.transform(endings, lambda h: F.transform(starts, lambda x: F.concat(h, F.substring(F.col("path"), F.lit(1), x)))))
    probe = urls.select("host", "path", "_rows", F.explode(F.array_distinct(keys)).alias("_key"))
    masks = _masks(F.col("_key"))
    may = probe.withColumn("block", _block(F.col("_key"), blocks)).join(small(bits), "block")
    for i, m in enumerate(masks):
        may = may.filter(F.col(f"w{i}").bitwiseAND(m) == m)
    hit = may.select("host", "path", "_rows", "_key").join(small(listed), F.col("_key") == F.col("_rule"))
    longest = F.max_by(F.struct("_rule", "_verdict"), F.struct(F.length("_rule"), F.col("_rule")))
    # urls that a rule fits, and those without one that many rows share
    found = urls.join(hit.groupBy("host", "path").agg(longest.alias("_longest")), ["host", "path"], "left")
    best, many = free_name(pages, "_best"), pages.count() / HOT_SHARE
    table = cut(found.filter(F.col("_longest").isNotNull() | (F.col("_rows") > many)).select("host", "path", F.col("_longest").alias(best), F.col("_rows").alias("n_rows")))
    out = lookup(parsed, table, ["host", "path"], "n_rows", matching=F.col("host") != "")
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*own, "host", "path", F.col(best)["_rule"].alias("rule"), F.coalesce(F.col(best)["_verdict"], F.lit(default)).alias("verdict"))
