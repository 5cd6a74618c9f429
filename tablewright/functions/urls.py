"""URL and path expressions (string Column -> string or boolean Column)."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import hints


def host_with_port(url: Column) -> Column:
    """Lower-cased authority of an URL; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def hostname(url: Column) -> Column:
    """Host without user, port or IPv6 brackets."""
    bare = F.regexp_replace(host_with_port(url), r"^.*@", "")
    return F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)", 1)).otherwise(
        F.regexp_replace(bare, r":.*$", "")
    )


def platform(url: Column) -> Column:
    """Content platform by host substring, in table order; null for other hosts."""
    host = host_with_port(url)
    pairs = reversed(hints.PLATFORM_HOSTS.items())
    return reduce(
        lambda rest, kv: F.when(host.contains(kv[0]), kv[1]).otherwise(rest), pairs, F.lit(None).cast("string")
    )


def fetch_mode(url: Column, prefer: str = "") -> Column:
    if prefer:
        return F.lit(prefer)
    api = url.contains("/api/") | F.coalesce(host_with_port(url).startswith("api."), F.lit(False))
    return (
        F.when(platform(url).isNotNull(), "autocli")
        .when(api | url.endswith(".json"), "api")
        .otherwise("static")
    )


def canonical_article(url: Column) -> Column:
    """Share links with ``/article/<digits>`` become the plain article URL; others stay."""
    number = F.regexp_extract(url, r"/article/(\d+)", 1)
    head, tail = hints.ARTICLE_URL.split("{}")
    return F.when(number != "", F.concat(F.lit(head), number, F.lit(tail))).otherwise(url)


def is_safe(url: Column) -> Column:
    """http(s) only, and no private, loopback or link-local address."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    blocked = F.coalesce(hostname(url).rlike("(?i)" + hints.BLOCKED_HOSTS), F.lit(False))
    return scheme.isin("http", "https") & ~blocked


def _is_web(path):
    return path.startswith("http://") | path.startswith("https://")


def reader_of(path: Column) -> Column:
    """Reader for a path: web, csv, excel, json, parquet or sqlite; csv when unknown."""
    ext = F.when(path.contains("."), F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)))
    table = F.create_map(*[F.lit(x) for kv in hints.READERS.items() for x in kv])
    return F.when(_is_web(path), "web").otherwise(F.coalesce(F.try_element_at(table, ext), F.lit("csv")))


def source_name(path: Column) -> Column:
    """Dataset name for a path (file stem) or an URL (host and start of its path)."""
    url_path = F.regexp_extract(path, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    # the last path segment's ";parameters" do not belong to the path
    url_path = F.regexp_replace(url_path, r";[^/]*$", "")
    host = F.regexp_extract(path, r"^[a-z]+://([^/?#]*)", 1)
    web = F.concat(F.replace(host, F.lit("."), F.lit("_")), F.substring(F.replace(url_path, F.lit("/"), F.lit("_")), 1, 30))
    web = F.substring(F.lower(F.regexp_replace(web, r"^_+|_+$", "")), 1, 50)
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    return F.when(_is_web(path), web).otherwise(F.lower(F.translate(stem, " -", "__")))
