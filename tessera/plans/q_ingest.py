"""Bound ingestion queries: link harvest, safe file names, catalogue, manifest."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.plans.tables import table
from tessera.sources import links as L
from tessera.sources import manifest as M

PATTERNS = ["/th"]
_ID = r"[A-Za-z][A-Za-z0-9+.\-]*"


def _resolve_sql(base, href):
    scheme = f"regexp_extract({base}, '^({_ID}):', 1)"
    origin = f"regexp_extract({base}, '^({_ID}://[^/?#]*)', 1)"
    no_frag = f"regexp_extract({base}, '^([^#]*)', 1)"
    no_query = f"regexp_extract({base}, '^([^?#]*)', 1)"
    base_dir = f"regexp_extract({no_query}, '^(.*/)', 1)"
    return f"""CASE WHEN regexp_matches({href}, '^{_ID}:') THEN {href}
     WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href}
     WHEN starts_with({href}, '/') THEN {origin} || {href}
     WHEN starts_with({href}, '?') THEN {no_query} || {href}
     WHEN starts_with({href}, '#') THEN {no_frag} || {href}
     WHEN {href} = '' THEN {base}
     ELSE (CASE WHEN {base_dir} = '' THEN {origin} || '/' ELSE {base_dir} END) || {href} END"""


def _decoded(x):
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "), ("eacute", "é"), ("egrave", "è"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{sign}')"
    return x


# the rule of the source in SQL of its own; odd markup (other quotes, dot segments, numeric references) is in tests/test_links.py
_LINKS_SQL = rf"""
c AS (SELECT page_id, url AS base, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') AS h FROM pages),
x AS (SELECT page_id, base, regexp_extract_all(h, '(?is)<a\s[^>]*href\s*=\s*"[^"]*"[^>]*>.*?</a>') AS tags FROM c),
a AS (SELECT page_id, base, CAST(i - 1 AS INTEGER) AS ordinal,
             trim({_decoded("regexp_extract(tags[i], '(?is)href[ ]*=[ ]*\"([^\"]*)\"', 1)")}) AS href,
             regexp_replace({_decoded("regexp_replace(tags[i], '<[^>]*>', '', 'g')")}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') AS anchor
      FROM (SELECT *, generate_subscripts(tags, 1) AS i FROM x)),
f AS (SELECT page_id, ordinal, href, anchor, {_resolve_sql('base', 'href')} AS url,
             (regexp_matches(lower(href), '\.(csv|xlsx?|zip|gz|parquet|txt)$') OR lower(anchor) LIKE '%télécharg%' OR lower(href) LIKE '%télécharge%') AS is_download
      FROM a),
d AS (SELECT page_id, url, ordinal, href, anchor, is_download FROM f
      QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY is_download DESC, ordinal) = 1),
m AS (SELECT *, is_download AND ({" OR ".join(f"regexp_matches(lower(url), '{p}')" for p in PATTERNS)}) AS matches_pattern FROM d),
links AS (SELECT page_id, url, ordinal, href, anchor, is_download, matches_pattern,
                 is_download AND (matches_pattern OR max(CAST(matches_pattern AS INTEGER)) OVER (PARTITION BY page_id) = 0) AS kept
          FROM m)
"""


def harvested(spark, d):
    pages = table(spark, d, "pages", "page_id", "url", "html")
    return L.harvest_links(pages, "page_id", "url", "html", PATTERNS)


@query("link_harvest", "S11", oracle=f"WITH {_LINKS_SQL} SELECT * FROM links")
def link_harvest(spark, d):
    return harvested(spark, d)


_UNSAFE = r"[^\p{L}\p{N}_.\-]"


@query("safe_filename", "S13", oracle=f"""
WITH p AS (SELECT page_id, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
                  regexp_extract(regexp_extract(url, '^(?:{_ID}://[^/?#]*)?([^?#]*)', 1), '([^/]+)/*$', 1) AS seg
           FROM pages)
SELECT page_id, CASE WHEN length(seg) > 3 THEN regexp_replace(seg, '{_UNSAFE}', '_', 'g')
                     WHEN coalesce(title, '') <> '' THEN substr(regexp_replace(title, '{_UNSAFE}', '_', 'g'), 1, 100)
                     ELSE substr(md5(url), 1, 12) END AS file_name
FROM p
""")
def safe_filename(spark, d):
    p = table(spark, d, "pages", "page_id", "url", "html")
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return p.select("page_id", L.safe_filename(F.col("url"), title).alias("file_name"))


FORMATS = ["csv", "parquet", "xlsx", "html"]


@query("catalogue_prefer", "S12", oracle=f"""
WITH {_LINKS_SQL},
r AS (SELECT page_id, ordinal, anchor AS title, '' AS format,
             url || '.' || ([{', '.join(f"'{f}'" for f in FORMATS)}])[length(anchor) % 4 + 1] AS url FROM links),
e AS (SELECT *, lower(regexp_extract(regexp_extract(url, '^(?:{_ID}://[^/?#]*)?([^?#]*)', 1), '(\\.[^./]*)$', 1)) AS ext FROM r),
k AS (SELECT page_id, ordinal, title, url,
             CASE WHEN ext IN ({', '.join(f"'{e}'" for e in L.domain.CATALOGUE_EXTENSIONS)}) AND format = ''
                  THEN regexp_replace(ext, '^\\.', '') ELSE format END AS format
      FROM e WHERE ext IN ({', '.join(f"'{e}'" for e in L.domain.CATALOGUE_EXTENSIONS)})
               OR format IN ({', '.join(f"'{f}'" for f in L.domain.CATALOGUE_FORMATS)})),
pq AS (SELECT DISTINCT page_id, title FROM k WHERE format = 'parquet'),
nc AS (SELECT k.* FROM k WHERE NOT (format = 'csv' AND EXISTS (SELECT 1 FROM pq WHERE pq.page_id = k.page_id AND pq.title = k.title))),
kw AS (SELECT * FROM (SELECT *, max(CAST(contains(lower(title), 'the') AS INTEGER)) OVER (PARTITION BY page_id) AS any_hit FROM nc)
       WHERE contains(lower(title), 'the') OR any_hit = 0)
SELECT page_id, ordinal, title, url, format FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ordinal) AS rn FROM kw) WHERE rn <= 3
""")
def catalogue_prefer(spark, d):
    h = harvested(spark, d)
    fmt = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (F.length("anchor") % 4 + 1).cast("int"))
    res = h.select("page_id", "ordinal", F.col("anchor").alias("title"), F.lit("").alias("format"),
                   F.concat(F.col("url"), F.lit("."), fmt).alias("url"))
    out = L.prefer_catalogue(res, "page_id", "ordinal", keyword="the", max_resources=3)
    return out.select("page_id", "ordinal", "title", "url", "format")


@query("file_manifest", "S10 S14 K5")
def file_manifest(spark, d):
    """Inventory of the table folder (hash per file, in the executors) against
    the manifest of the smallest sibling snapshot."""
    files = M.inventory(spark, d, "*.parquet")
    sibling = os.path.join(os.path.dirname(d.rstrip("/")), "sf0.001")
    manifest = M.inventory(spark, sibling, "*.parquet")
    return M.manifest_status(files, manifest)
