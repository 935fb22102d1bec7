"""Catalogue pages written out from the derived catalogue, so that what reading them must give is known.

``courses`` gives a page per course, ``indexes`` pages that link a subject's courses (so many courses a page at most),
``registries`` the two pages that list the subjects.  Some pages lack a code, units or a long enough description, by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlake.sources import catalogue as cat
from reqlake.sources import requirement_text as rt
from reqlake.storage import table

SITE = "https://catalogue.example.org"
PER_INDEX = 100  #: course numbers on an index page

#: Expressions that Spark and the oracle share: what a page says of its course.
HEADING = "CASE WHEN pk % 7 = 3 THEN title ELSE concat(code, ' - ', title) END"
TERM = "CASE WHEN pk % 2 = 0 THEN 'Fall Term 2026' ELSE 'Winter Term 2027' END"
UNITS = "concat(CASE WHEN pk % 3 = 0 THEN '1.5' ELSE '3' END, ' units (fi ', CASE WHEN pk % 3 = 0 THEN '3' ELSE '6' END, ')(EITHER, 3-0-0)')"

_HTML = f"""concat(
  '<!DOCTYPE html><html><head><style>b{{{{margin:0}}}}</style><script>var b = "<b>9 units (fi 18)</b>";</script></head><body>',
  '<p>Faculty of Menus, a paragraph of the navigation that is long enough to be taken for a description.</p><b>Fall Term 1999</b><h1 class="title">', {HEADING}, '</h1>',
  CASE WHEN pk % 11 = 5 THEN '<b>1</b><b>2</b><b>3</b><b>4</b><b>5</b><b>6</b>' ELSE '' END, '<b class="term"> ', {TERM}, '</b>',
  CASE pk % 5 WHEN 2 THEN concat('<div>', {UNITS}, '</div>') WHEN 4 THEN '' ELSE concat('<b>', {UNITS}, '</b>') END,
  '<p></p><p>Short.</p>', CASE WHEN pk % 4 < 3 THEN '<p>Faculty of <i>Science</i></p>' ELSE '' END,
  '<p>', description, '</p><p>A second paragraph that says no more.</p><p>Faculty of Arts</p></body></html>')""".replace("{{", "{").replace("}}", "}")


def url_sql(code: str) -> str:
    return f"concat('{SITE}/catalogue/course/', lower(split_part({code}, ' ', 1)), '/', lower(split_part({code}, ' ', 2)))"


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, html of a page per course."""
    return rt.texts(spark, sf_dir).select(F.expr(url_sql("code")).alias("url"), F.expr(_HTML).alias("html"))


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, page, html: links to at most PER_INDEX courses of a subject in falling order, the first once more, and others."""
    rows = cat.courses(spark, sf_dir).select(F.lower("subject").alias("slug"), F.floor((F.col("number") - 100) / PER_INDEX).cast("int").alias("page"), "number")
    link = F.concat(F.lit(' <a class="c" href=" /catalogue/course/'), "slug", F.lit("/"), F.col("number").cast("string"), F.lit(' ">'), F.col("number").cast("string"), F.lit("</a>"))
    lists = rows.groupBy("slug", "page").agg(F.sort_array(F.collect_list(F.struct("number", link.alias("link"))), asc=False)["link"].alias("links"))
    extra = F.concat(F.lit('<a href="/catalogue/course/'), "slug", F.lit('"></a><a href="/catalogue/course/other/101">x</a><a href="/catalogue/course/'), "slug", F.lit('/1/2">y</a>'))
    return lists.select("slug", "page", F.concat(F.lit("<html><script>'<a href=\"/catalogue/course/x/1\">'</script>"), extra, F.array_join("links", "\n"), F.get("links", F.lit(0)), F.lit("</html>")).alias("html"))


def registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, html: the registry of all subjects (a few dozen), and the page that lists the science subjects among them."""
    subjects = table(spark, sf_dir, "part").select((F.col("p_partkey") % cat.SUBJECTS).cast("int").alias("s")).distinct()
    letter = F.char(65 + F.col("s"))
    link = F.concat(F.lit('<li><a href="/catalogue/course/sub'), F.lower(letter), F.lit('">'), F.concat(F.lit("SUB"), letter, F.lit(" - <i>Study Area "), letter), F.lit("</i></a></li>"))
    noise = F.lit('<a href="/catalogue/course/suba">no label here</a><a href="/about">ABC - About</a>')
    lists = subjects.select("s", link.alias("link")).groupBy().agg(
        F.array_join(F.sort_array(F.collect_list("link"), asc=False), "").alias("all"), F.array_join(F.collect_list(F.when(F.col("s") % 3 == 0, F.col("link"))), "").alias("science")
    )
    pages = F.array(F.struct(F.lit("all").alias("page"), F.concat(noise, "all", F.lit('<a href="/catalogue/course/subb">SUBB - Another name</a>')).alias("html")), F.struct(F.lit("science").alias("page"), F.col("science").alias("html")))
    return lists.select(F.inline(pages))
