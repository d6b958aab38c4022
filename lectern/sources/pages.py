"""Records of papers out of the web pages of a repository."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.people import filled, strip
from ..functions.text import col, page_range, paper_type

#: The named entities of HTML and their characters, by the standard library's table.
_NAMED = {"apos": "'", **{n: chr(c) for n, c in name2codepoint.items()}}


def unescape_all(x) -> Column:
    """Named, decimal and hexadecimal entities as characters, each once; unknown ones stay."""
    parts = F.split(col(x), r"(?=&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});)|(?<=&[#A-Za-z0-9]{2,8};)")
    named = F.create_map(*[F.lit(v) for kv in _NAMED.items() for v in kv])

    def char(p: Column) -> Column:
        number = F.when(p.rlike(r"^&#\d+;$"), F.regexp_extract(p, r"\d+", 0).cast("long")).when(p.rlike(r"^&#[xX]"), F.conv(F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]+);$", 1), 16, 10).cast("long"))
        known = (number < 0x110000) & ~number.between(0xD800, 0xDFFF) & (number > 0)
        made = F.decode(F.unhex(F.lpad(F.hex(F.when(known, number)), 8, "0")), "UTF-32")
        return F.when(p.rlike("^&#?[A-Za-z0-9]+;$"), F.coalesce(made, F.try_element_at(named, F.regexp_extract(p, "^&(.*);$", 1)), p)).otherwise(p)
    return F.when(F.instr(col(x), "&") > 0, F.array_join(F.transform(parts, char), "")).otherwise(col(x))


def _meta(name: str, value: str = '[^"]+') -> str:
    return rf'<meta\s+name="{name}"\s+content="({value})"'


def page_records(pages: DataFrame, base: str, default_year: int, practice: str = "practice-oriented") -> DataFrame:
    """(page_id, title, authors, year, citation, doi, abstract, pdf_url, descriptions, practice, start_page, end_page, paper_type).

    pages(page_id, html).  The title is the page's DC.title, else its <title>; a page without one is dropped.  Texts are
    unescaped and stripped; what a page does not have is null, or an empty list; the year falls back to the
    default.
    """
    def one(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))

    def many(pattern: str) -> Column:
        return filled(F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), unescape_all))
    title = F.coalesce(one(_meta(r"DC\.title")), one(r"<title>([^<]+)</title>"))
    citation = one(_meta(r"DCTERMS\.bibliographicCitation"))
    abstract = one("(?i)" + _meta(r"(?:DCTERMS\.abstract|DC\.description\.abstract|description)"))
    rows = pages.select("page_id", strip(unescape_all(title)).alias("title"), many(_meta(r"DC\.creator")).alias("authors"),
                        F.coalesce(one(r'<meta\s+name="DCTERMS\.issued"\s+content="(\d{4})[^"]*"').cast("int"), F.lit(default_year)).alias("year"),
                        F.when(citation.isNotNull(), strip(unescape_all(citation))).alias("citation"), one(r'https?://doi\.org/([^"]+)').alias("doi"),
                        F.when(abstract.isNotNull(), strip(unescape_all(abstract))).alias("abstract"), F.concat(F.lit(base), one(r'href="([^"]*bitstream/1/[^"]+\.pdf[^"]*)"')).alias("pdf_url"), many(_meta(r"DC\.description")).alias("descriptions"))
    rows = rows.where("title <> ''").withColumn("practice", F.exists("descriptions", lambda d: F.lower(d).contains(practice))).withColumn("_p", page_range(F.coalesce("citation", F.lit("")), F.coalesce("pdf_url", F.lit(""))))
    return rows.select("*", "_p.start_page", "_p.end_page", paper_type("title", "citation", "_p.start_page", "_p.end_page", "descriptions").alias("paper_type")).drop("_p")
