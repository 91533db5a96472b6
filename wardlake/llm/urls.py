"""URL filters: domain rules, and a list of URLs behind a blocked Bloom filter.

Listed URLs are brought to a canonical form. Each sets a few bits in one 512-bit block of
the filter; blocks are built by an aggregation and have a bounded number, so the filter can
be broadcast. A page whose bits are not all set is certainly not listed and is never
shuffled. Possible hits, and only those, go to an exact hash join with the list, which
removes false positives.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule
and is not listed. Repeated pages each get their verdict; repeated or null list entries
count once or not at all. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.expressions import ascii_lower
from wardlake.llm.common import durable

# (verdict, host, path prefix) of the rules; a rule's name is host and path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# Eight 64-bit words make a block; a URL sets one bit in each.
WORDS = 8
BITS_PER_URL = 16
# At most 16 MB of filter; a longer list has more false positives, and the same verdicts.
MOST_BLOCKS = 1 << 18
# Query parameters that only track a visit.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|msclkid|sessionid|sid)(=|$)"


def host_of(url: Column) -> Column:
    """Lower-cased text between the first `://` and the next `/`, `?`, `#` or the end."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the addresses of a page; null without `://`.

    Drops the scheme, a leading `www.` or `m.`, default ports, the fragment, tracking
    parameters, a final slash, `.html` and `index.html`; sorts the other parameters.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html$", ""), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^#]*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    tail = F.array_join(F.array_sort(kept), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def rule_of(host: Column, path: Column) -> Column:
    """struct<name, verdict> of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for verdict, domain, prefix in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(domain + prefix).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """One bit for each word of the block."""
    bits = F.xxhash64(url, F.lit("bits"))
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of a table of distinct canonical URLs `url`; at most `blocks` rows."""
    bits = listed.select(_block(F.col("url"), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("url")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def judge_urls(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, listed and verdict of every page.

    `listed` has one column of URLs in any form. The rule decides, where one fits; else
    a listed page is blocked.
    """
    known = durable(listed.select(canonical(F.col(listed.columns[0])).alias("url")).where("url is not null").distinct())
    blocks = max(1, min(MOST_BLOCKS, -(-known.count() * BITS_PER_URL // (64 * WORDS))))
    bloom = bloom_blocks(known, blocks)
    parsed = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("url")
    )
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col("url"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    # A block has 72 bytes here; MOST_BLOCKS bounds what is broadcast.
    probed = parsed.withColumn("block", _block(F.col("url"), blocks)).join(F.broadcast(bloom), "block", "left").withColumn(
        "maybe", F.col("url").isNotNull() & F.coalesce(hit, F.lit(False))
    )
    surely_not = probed.where(~F.col("maybe")).select("page_id", "host", "path", F.lit(False).alias("listed"))
    exact = known.select("url", F.lit(True).alias("found")).hint("shuffle_hash")
    possible = probed.where("maybe").select("page_id", "host", "path", "url").join(exact, "url", "left").select(
        "page_id", "host", "path", F.col("found").isNotNull().alias("listed")
    )
    judged = surely_not.unionByName(possible).withColumn("r", rule_of(F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"), "listed")
