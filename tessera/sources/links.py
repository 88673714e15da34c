"""Link harvest, resource catalogue and safe file names (S11, S12, S13) on
DataFrame columns: regex extraction + posexplode + windowed fallbacks, no
HTML parser, no per-row Python."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import domain
from tessera.operators.joins import any_per_group, top_n_per_group

# <a ... href=... ...>anchor</a>, the value in double quotes, single quotes or none;
# script/style/comment blocks are removed first.
ANCHOR_RE = r"""(?is)<a\s(?:[^>]*?[\s"'])?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""
NON_MARKUP_RE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG_RE = r"<[^>]*>"
ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def decode_entities(c: Column) -> Column:
    """HTML character references as text: decimal, hexadecimal and named (HTML 4)
    ones that end with a semicolon; what is no reference stays as it is."""
    names = F.map_from_arrays(F.lit(["apos", *name2codepoint]), F.lit(["'", *map(chr, name2codepoint.values())]))

    def number(x: Column, pattern: str, base: int) -> Column:
        digits = F.regexp_extract(x, pattern, 1)
        return F.when(digits != "", F.conv(digits, base, 10).cast("int"))

    def piece(x: Column) -> Column:
        code = F.coalesce(number(x, r"^&#([0-9]{1,7});", 10), number(x, r"^&#[xX]([0-9a-fA-F]{1,6});", 16))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        sign = (F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
                 .when(code.isNotNull(), F.lit("�"))
                 .otherwise(F.try_element_at(names, F.regexp_extract(x, r"^&(\w+);", 1))))
        return F.when(sign.isNull(), x).otherwise(F.concat(sign, F.regexp_replace(x, r"^&#?\w+;", "")))

    return F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")


def normal_path(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty inner segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != "")

    def add(kept: Column, x: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.concat(inner, F.array(last)), F.array().cast("array<string>"), add)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` relative to ``base`` (scheme-relative, root-
    relative, query-only, fragment-only and path-relative forms; dot segments
    of relative paths are resolved)."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, ORIGIN_RE, 1)
    no_frag = F.regexp_extract(base, r"^([^#]*)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(no_query, ORIGIN_RE, ""), r"^(.*/)", 1)
    path, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    full = F.when(href.startswith("/"), path).when(folder == "", F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
             .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
             .when(href.startswith("?"), F.concat(no_query, href))
             .when(href.startswith("#"), F.concat(no_frag, href))
             .when(href == "", base)
             .otherwise(F.concat(origin, normal_path(full), tail)))


def harvest_links(pages: DataFrame, id_col: str, url_col: str, html_col: str, patterns=(),
                  extensions=tuple(domain.LINK_FILE_EXTENSIONS), text_marker=domain.LINK_TEXT_MARKER,
                  href_marker=domain.LINK_HREF_MARKER) -> DataFrame:
    """Every anchor of every page, resolved and de-duplicated per page
    (a URL is a download if any of its anchors is), with the download rule and the pattern rule:

    is_download = href ends with a data extension, or the anchor text
                  contains the text marker, or the href contains the href marker
    kept        = is_download and (matches a pattern, or no download link of
                  the page matches any pattern: keep-all fallback)
    """
    clean = F.regexp_replace(F.col(html_col), NON_MARKUP_RE, "")
    x = pages.select(F.col(id_col), F.col(url_col).alias("_base"),
                     *[F.regexp_extract_all(clean, F.lit(ANCHOR_RE), k).alias(n) for k, n in enumerate(("_q2", "_q1", "_q0", "_t"), 1)])
    x = x.select(id_col, "_base", F.posexplode(F.arrays_zip("_q2", "_q1", "_q0", "_t")).alias("ordinal", "_a"))
    # one of the three value forms is filled
    x = x.select(id_col, "_base", "ordinal", F.trim(decode_entities(F.concat("_a._q2", "_a._q1", "_a._q0"))).alias("_href"),
                 F.regexp_replace(decode_entities(F.regexp_replace("_a._t", TAG_RE, "")), r"^[\s\u00a0]+|[\s\u00a0]+$", "").alias("_text"))
    href, text = F.col("_href"), F.col("_text")
    hl = F.lower(href)
    is_file = reduce(lambda a, b: a | b, [hl.endswith(e) for e in extensions])
    is_dl = is_file | F.lower(text).contains(text_marker) | hl.contains(href_marker)
    x = x.select(id_col, "ordinal", href.alias("href"), text.alias("anchor"),
                 resolve_url(F.col("_base"), href).alias("url"), is_dl.alias("is_download"))
    # ordered de-duplication of absolute URLs per page: the first download link wins, else the first link
    first = x.groupBy(id_col, "url").agg(F.min(F.struct((~F.col("is_download")).alias("_not"), "ordinal", "href", "anchor", "is_download")).alias("_f"))
    x = first.select(id_col, F.col("_f.ordinal").alias("ordinal"), "url", F.col("_f.href").alias("href"),
                     F.col("_f.anchor").alias("anchor"), F.col("_f.is_download").alias("is_download"))
    ul = F.lower(F.col("url"))
    match = reduce(lambda a, b: a | b, [ul.rlike(p) for p in patterns]) if patterns else F.lit(True)
    x = x.withColumn("matches_pattern", F.col("is_download") & match)
    x = any_per_group(x, id_col, "matches_pattern", "_any")
    return x.withColumn("kept", F.col("is_download") & (F.col("matches_pattern") | ~F.col("_any"))).drop("_any")


_UNSAFE = r"[^\p{L}\p{N}_.\-]"


def safe_filename(url: Column, title: Column) -> Column:
    """Last path segment of the URL if longer than 3 characters, else the
    sanitised title cut at 100, else the first 12 hex digits of MD5(url)."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    seg = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return (F.when(F.length(seg) > 3, F.regexp_replace(seg, _UNSAFE, "_"))
             .when(F.coalesce(title, F.lit("")) != "", F.substring(F.regexp_replace(title, _UNSAFE, "_"), 1, 100))
             .otherwise(F.substring(F.md5(url), 1, 12)))


def file_extension(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def prefer_catalogue(resources: DataFrame, dataset_col: str, order_col: str, keyword: str | None = None,
                     max_resources: int | None = None, extensions=tuple(domain.CATALOGUE_EXTENSIONS),
                     formats=tuple(domain.CATALOGUE_FORMATS)) -> DataFrame:
    """Resources (dataset, url, title, format) -> the ones to fetch.

    1. keep data-file extensions, else declared data formats; format falls
       back to the extension;
    2. drop a CSV when the same dataset lists a Parquet with the same title
       (left anti join);
    3. title keyword filter with a keep-all fallback per dataset;
    4. first ``max_resources`` per dataset in listing order.
    """
    ext = file_extension(F.col("url"))
    fmt = F.lower(F.coalesce(F.col("format"), F.lit("")))
    r = resources.withColumn("_ext", ext)
    r = (r.where(F.col("_ext").isin(list(extensions)) | fmt.isin(list(formats)))
          .withColumn("format", F.when(F.col("_ext").isin(list(extensions)) & (fmt == ""),
                                       F.regexp_replace("_ext", r"^\.", "")).otherwise(fmt))
          .drop("_ext"))
    pq = r.where(F.col("format") == "parquet").select(dataset_col, "title").distinct()
    r = r.join(pq.withColumn("_pq", F.lit(True)), [dataset_col, "title"], "left")
    r = r.where(~((F.col("format") == "csv") & F.coalesce(F.col("_pq"), F.lit(False)))).drop("_pq")
    if keyword:
        r = r.withColumn("_hit", F.lower(F.col("title")).contains(keyword.lower()))
        r = any_per_group(r, dataset_col, "_hit", "_any")
        r = r.where(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")
    if max_resources:
        r = top_n_per_group(r, dataset_col, [order_col], max_resources)
    return r
