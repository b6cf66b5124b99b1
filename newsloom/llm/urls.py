"""URL filters: a blocked Bloom filter before an exact hash join.

URLs are put in a canonical form. The canonical forms of the list make a blocked Bloom filter: a
URL's hash names one block of 256 bits and ``BITS`` bits in it, so a look-up touches one block. The
blocks are rows of a DataFrame (block, four longs) built with bit_or, and probing is an equi-join
on the block: broadcast where the filter is measured to be small enough, shuffled like any other
join where it isn't. Possible hits - the listed URLs and about one in a thousand others - go to an
exact hash join with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed, materialise

BITS, PER_BLOCK = 6, 16  # bits of a URL in its block; URLs for each block of 256 bits
BROADCAST_BYTES = 64 << 20
_TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"
#: (pattern, replacement) one after the other; the same text works in Spark and in DuckDB.
RULES = (
    (r"#.*$", ""),
    (r"^(?:[a-z][a-z0-9+.-]*:)?//", ""),
    (r"^(?:www\.|m\.)", ""),
    (r"^([^/?#:]*):(?:80|443)([/?#]|$)", r"\1\2"),
    (r"(?:/\.)+(/|\?|$)", r"\1"),
    (rf"([?&]){_TRACKING}=[^&]*", r"\1"),
    (r"&+", "&"),
    (r"\?&", "?"),
    (r"[?&]+$", ""),
    (r"/(?:index|default)\.(?:html?|php)(\?|$)", r"/\1"),
    (r"\.html?(\?|$)", r"\1"),
    (r"/+(\?|$)", r"\1"),
)


def canonical(url: Column) -> Column:
    """Scheme, www. or m., standard port, fragment, tracking parameters, index pages, .html, "/."
    and closing slashes go; scheme and host become lower case, parameters come in order. Percent
    signs and "/.." stay as they are. Null stays null."""
    head = F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//)?([^/?#]*)", 0)
    out = F.concat(F.lower(head), F.substr(F.trim(url), F.length(head) + 1))
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    query = F.regexp_extract(out, r"\?(.*)$", 1)
    return F.when(F.contains(query, F.lit("&")), F.concat(F.regexp_extract(out, r"^[^?]*", 0), F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))).otherwise(out)


def _mask(h: Column, word: int) -> Column:
    """The bits of a URL that lie in one of its block's four longs."""
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        bit = F.shiftrightunsigned(h, 8 * k).bitwiseAND(F.lit(255))
        mask = mask.bitwiseOR(F.when(F.shiftright(bit, 6) == word, F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
    return mask


def bloom_filter(urls: DataFrame, blocks: int) -> DataFrame:
    """(block, w0, w1, w2, w3) for a column ``canonical``; blocks without a URL have no row."""
    h, place = F.xxhash64("canonical"), F.pmod(F.xxhash64("canonical", F.lit(1)), F.lit(blocks))
    words = [F.bit_or(f"m{k}").alias(f"w{k}") for k in range(4)]
    return urls.select(place.alias("block"), *[_mask(h, k).alias(f"m{k}") for k in range(4)]).groupBy("block").agg(*words)


def match(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for every row of ``pages``: page_id, url, canonical and listed, whether the canonical
    URL is that of a row of ``listed``.

    A null URL has a null canonical form and is not listed; nulls in the list don't count. Equal
    forms in the list count once. Repeated rows all come back. An empty list lists nothing; an
    empty table gives an empty result. Other columns are not looked at and don't come back."""
    wanted = materialise(listed.select(canonical(F.col(listed_col)).alias("canonical")).filter("canonical is not null").distinct(), "listed")
    n = wanted.count()
    blocks = max(1, -(-n // PER_BLOCK))
    bloom = bloom_filter(wanted, blocks)
    if blocks * 64 <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), canonical(F.col(url_col)).alias("canonical"))
    h = F.xxhash64("canonical")
    probed = rows.withColumn("block", F.pmod(F.xxhash64("canonical", F.lit(1)), F.lit(blocks))).join(bloom, "block", "left")
    fits = F.col("canonical").isNotNull() & F.col("w0").isNotNull()
    for k in range(4):
        fits &= _mask(h, k).bitwiseAND(F.col(f"w{k}")) == _mask(h, k)
    # only possible hits have a key; the rest pass through the join with a null, spread by their id
    key = F.when(fits, F.col("canonical"))
    probed = materialise(probed.select("page_id", "url", "canonical", key.alias("key")), "probed")
    hits = probed.filter("key is not null").join(hashed(wanted.withColumnRenamed("canonical", "key").withColumn("listed", F.lit(True))), "key", "left")
    hits = hits.select("page_id", "url", "canonical", F.coalesce("listed", F.lit(False)).alias("listed"))
    return probed.filter("key is null").select("page_id", "url", "canonical", F.lit(False).alias("listed")).union(hits)


def canonical_sql(url: str) -> str:
    """``canonical`` for DuckDB."""
    head = f"regexp_extract(trim({url}), '^([A-Za-z][A-Za-z0-9+.-]*:)?(//)?([^/?#]*)', 0)"
    out = f"(lower({head}) || substr(trim({url}), length({head}) + 1))"
    for pattern, to in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    query = f"regexp_extract({out}, '\\?(.*)$', 1)"
    return f"case when contains({query}, '&') then regexp_extract({out}, '^[^?]*', 0) || '?' || array_to_string(list_sort(string_split({query}, '&')), '&') else {out} end"
