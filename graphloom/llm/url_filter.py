"""URL filter: rules by host and path, and a list of canonical URLs held in a blocked Bloom filter. DataFrame functions only.

Every listed canonical URL sets 8 bits in one block of 512 bits (8 words of 64 bits, one bit in each); the filter is
the OR of its rows by block, built by an aggregation. A page's URL that lacks a bit of its block can't be listed. The
possible hits go to an exact hash join with the list, which removes false positives. The filter has a block for every
32 listed URLs (16 bits each; about one false hit in 1500); it is broadcast if that is within a checked bound and
joined by block otherwise, then with each distinct URL once. Hits go back to pages with hot URLs apart, and pages
without a URL don't take part in joins.

Canonical form: scheme, port, credentials and fragment dropped; host in lower case without final dots and a leading
mirror label (www., m.); tracking parameters dropped and the rest of the query sorted; final slashes, index pages and
page suffixes dropped.

Defined results: a null URL, or one without ://, has empty host and path, no canonical form and no rule, and is
allowed; repeated rows give repeated results; an empty list allows all, an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, keyed_join, kept, scratch, stage

#: (verdict, host, path): the host and its subdomains, paths that start so. The longest host + path wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_WORDS = 8
_PER_BLOCK = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't change a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")
#: Leading host labels that stand for the same site.
MIRRORS = ("www", "m")


def _rest(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column, mirrors: tuple[str, ...] = MIRRORS, tracking: tuple[str, ...] = TRACKING) -> Column:
    """host + path + sorted query; null where the URL has no host."""
    rest = F.coalesce(_rest(url), F.lit(""))
    name = F.regexp_replace(F.regexp_replace(host(url), r"^[^@]*@|:\d*$", ""), r"\.+$", "")
    name = F.regexp_replace(name, f"^(?:{'|'.join(mirrors)})\\.", "") if mirrors else name
    where = F.regexp_replace(F.regexp_replace(path(url), r"(?:/index)?(?:\.html?|\.php)$", ""), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    drop = "^(?:" + "|".join(tracking) + ")(?:=|$)"
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(drop)))
    return F.when(name != "", F.concat(name, where, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_of(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        hit = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        fits = F.when(hit, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _bits(url: Column) -> list[Column]:
    """The bit of each of a block's words that the URL sets."""
    h = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(_WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocked Bloom filter of the canonical URLs in column `url`."""
    bits = [b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("url")))]
    each = listed.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *bits)
    return each.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def listed_hits(pages: DataFrame, url: str, listed: DataFrame) -> DataFrame:
    """The distinct values of pages' canonical URL column that `listed` (column url) holds."""
    listed = stage(listed.where(F.col("url").isNotNull()).select("url").distinct(), "listed")
    blocks = max(1, listed.count() // _PER_BLOCK)
    table = stage(bloom(listed, blocks), "bloom")
    asked = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("u"))
    small = fits_broadcast(table)
    asked = asked if small else asked.distinct()  # so that a page's URL, however often it stands, is one row of the join
    asked = asked.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks))).join(F.broadcast(table) if small else table, "block")
    may = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(F.col("u")))])
    possible = asked.where(may).select("u").distinct()
    return possible.join(listed, possible["u"] == listed["url"], "left_semi")


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, mirrors: tuple[str, ...] = MIRRORS) -> DataFrame:
    """(page_id, host, path, canonical_url, rule, listed, verdict) for every page. listed: DataFrame with column url."""
    with scratch(pages.sparkSession):
        base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("raw"))
        base = base.select("page_id", host(F.col("raw")).alias("host"), path(F.col("raw")).alias("path"), canonical(F.col("raw"), mirrors).alias("canonical_url"))
        base = stage(base, "urls")
        known = listed.select(canonical(F.col("url"), mirrors).alias("url"))
        hits = stage(listed_hits(base, "canonical_url", known).select(F.col("u").alias("canonical_url"), F.lit(True).alias("listed")), "hits")
        met = keyed_join(base, hits, "canonical_url")
        met = met.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("listed", F.coalesce("listed", F.lit(False)))
        own = F.when(F.col("listed"), "block").otherwise("allow")
        return kept(stage(met.select("page_id", "host", "path", "canonical_url", F.col("fit.rule").alias("rule"), "listed", F.coalesce("fit.verdict", own).alias("verdict")), "judged"))
