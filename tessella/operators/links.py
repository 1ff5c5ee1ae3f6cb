"""Links of web pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

ROW = r"(?is)<tr\b.*?</tr>"
CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"
LINK = r"""(?is)<a\s[^>]*?href=["']([^"']+?\.pdf)["'][^>]*>(.*?)</a>"""


def _links(fragment: Column) -> Column:
    hrefs = F.regexp_extract_all(fragment, F.lit(LINK), F.lit(1))
    texts = F.regexp_extract_all(fragment, F.lit(LINK), F.lit(2))
    return F.arrays_zip(hrefs.alias("href"), texts.alias("text"))


def document_links(pages: DataFrame, html: str) -> DataFrame:
    """The pages' columns with href, title and ord: links to PDF files in order. A link in a table row is titled by the row's cells, others by
    their own text; a link that a row had is not repeated."""
    in_rows = F.flatten(
        F.transform(
            F.regexp_extract_all(html, F.lit(ROW), F.lit(0)),
            lambda r: F.transform(
                _links(r),
                lambda x: F.struct(x["href"].alias("href"), F.array_join(F.filter(F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), T.strip_tags), lambda c: c != ""), " | ").alias("title")),
            ),
        )
    )
    pages = pages.withColumn("_rows", in_rows)
    rest = F.filter(F.transform(_links(F.col(html)), lambda x: F.struct(x["href"].alias("href"), T.strip_tags(x["text"]).alias("title"))), lambda x: ~F.array_contains(F.transform("_rows", lambda y: y["href"]), x["href"]))
    out = pages.select("*", F.posexplode(F.concat("_rows", rest)).alias("ord", "_l"))
    return out.select(*[c for c in pages.columns if c != "_rows"], "ord", F.col("_l.href").alias("href"), F.col("_l.title").alias("title"))


def new_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links (href, slug, ord) of which neither URL nor slug is known or was added earlier in the same run."""
    from pyspark.sql.window import Window

    fresh = links.join(known.select("href").distinct(), "href", "left_anti").join(known.select("slug").distinct(), "slug", "left_anti")
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("ord"))
    return fresh.withColumns({"_h": first("href"), "_s": first("slug")}).where("_h = 1 AND _s = 1").drop("_h", "_s")
