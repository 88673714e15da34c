"""Link harvest cases with hand-written results."""

from pyspark.sql import functions as F

from tessera.sources.links import harvest_links, resolve_url


def test_any_download_anchor_keeps_the_url(spark):
    html = '<a href="doc/1">voir</a><a href="doc/1">Télécharger</a><a href="doc/2">voir</a>'
    df = spark.createDataFrame([(1, "http://x.org/a/", html)], "i int, u string, h string")
    got = {r["url"]: (r["is_download"], r["kept"], r["anchor"]) for r in harvest_links(df, "i", "u", "h").collect()}
    assert got == {"http://x.org/a/doc/1": (True, True, "Télécharger"), "http://x.org/a/doc/2": (False, False, "voir")}


def test_quotes_entities_and_dot_segments(spark):
    html = ("<a class=x href='d/1.csv'>un</a><A HREF=d/2.csv>deux</A><a href=\"q?a=1&amp;b=2\">T&eacute;l&#233;ch&#xE9;rger &amp;c &unknown;</a>"
            "<a data-href='no.csv' href='../up.csv'>haut</a><a href='/r/./s/../t.csv'>x</a><a href='../../../z.csv#f'>x</a><a name='n'>no link</a>")
    df = spark.createDataFrame([(1, "http://x.org/a/b/page?z=/q", html)], "i int, u string, h string")
    got = {r["ordinal"]: (r["url"], r["anchor"], r["is_download"]) for r in harvest_links(df, "i", "u", "h").collect()}
    assert got == {0: ("http://x.org/a/b/d/1.csv", "un", True), 1: ("http://x.org/a/b/d/2.csv", "deux", True),
                   2: ("http://x.org/a/b/q?a=1&b=2", "Téléchérger &c &unknown;", False), 3: ("http://x.org/a/up.csv", "haut", True),
                   4: ("http://x.org/r/t.csv", "x", True), 5: ("http://x.org/z.csv#f", "x", False)}


def test_resolve_against_a_host_without_path(spark):
    df = spark.createDataFrame([("http://x.org", "a.csv"), ("http://x.org", "/a/"), ("http://x.org/p/", ".."), ("http://x.org/p/q", "."), ("http://x.org/p", "//y.org/b"),
                                ("http://x.org/p?k", "?m=1"), ("http://x.org/p?k#f", "#g"), ("http://x.org/p", ""), ("http://x.org/p", "ftp://z/../b")], "b string, h string")
    got = [r["u"] for r in df.select(resolve_url(F.col("b"), F.col("h")).alias("u")).collect()]
    assert got == ["http://x.org/a.csv", "http://x.org/a/", "http://x.org/", "http://x.org/p/", "http://y.org/b", "http://x.org/p?m=1", "http://x.org/p?k#g", "http://x.org/p", "ftp://z/../b"]
