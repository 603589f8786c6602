"""Messages from mail-archive HTML pages, by column expressions over a page table."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import scalars as sc
from quillgraph.functions import text as tx

# Fixed patterns: where an archive page keeps its parts.
MESSAGE_ID = r"^.*%3c(.*)@.*$"
ROW = r"(?s)<tr[^>]*\bclass\s*=\s*[\"']%s[\"'][^>]*>(.*?)</tr>"
RIGHT_CELL = r"(?s)<td[^>]*\bclass\s*=\s*[\"']right[\"'][^>]*>([^<]*)"
TITLE = r"(?s)<title[^>]*>([^<]*)"
PRE = r"(?s)<pre[^>]*>([^<]*)"
HEAD = r"(?s)<thead[^>]*>(.*?)</thead>"
LINK = r"(?s)<a\b([^>]*)>"
NAV_LINK = r"(?s)<a\b([^>]*\btitle\s*=\s*[\"']%s[\"'][^>]*)>"
HREF = r"(?s)\bhref\s*=\s*[\"']([^\"']*)[\"']"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


#: references that nearly all pages make do with; the last one must be decoded last
USUAL = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
UNUSUAL = r"&(?!(?:lt|gt|quot|#39|amp);)[#A-Za-z]"


def unescape(text: Column) -> Column:
    """Decode numeric and named character references; unknown ones stay as they are.

    Names are those of HTML 4 and ``apos``.  A no-break space becomes a space.  Texts without a reference, and
    those with none but the usual ones, take short ways.
    """
    def usual(t: Column) -> Column:
        for entity, char in USUAL.items():
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    return tx.let(text, lambda t: F.when(~t.contains("&"), t).when(~t.rlike(UNUSUAL), usual(t)).otherwise(_decoded(t)))


def _decoded(text: Column) -> Column:
    names = {f"&{k};": chr(v) for k, v in name2codepoint.items()} | {"&apos;": "'", "&nbsp;": " "}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def decoded(entity: Column) -> Column:
        hexadecimal = entity.rlike("^&#[xX]")
        digits = F.regexp_extract(entity, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, F.lit("0"))), "UTF-32")
        return F.when(entity.startswith("&#"), F.coalesce(F.when(valid & (code != 160), character), F.when(code == 160, F.lit(" ")), entity)).otherwise(
            F.coalesce(F.try_element_at(table, entity), entity)
        )

    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    pieces = F.split(text, ENTITY, -1)
    joined = F.zip_with(pieces, F.transform(found, decoded), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(joined, "")


def _first(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def _nav(head: Column, title: str) -> Column:
    return unescape(_first(_first(head, NAV_LINK % title), HREF))


def mail_messages(pages: DataFrame, base_url: str) -> DataFrame:
    """(date, sender, id, next_thread, prev_thread, next_url, subject, text) of each page.

    The text of an element ends at its first child.  Absent links give ``""``.
    """
    page = pages.select("html").withColumn("html", tx.printable(F.col("html")))
    html = F.col("html")
    parts = page.select(
        _first(html, TITLE).alias("title"),
        _first(_first(html, ROW % "from"), RIGHT_CELL).alias("from"),
        _first(_first(html, ROW % "date"), RIGHT_CELL).alias("date"),
        unescape(_first(_first(_first(html, ROW % "raw"), LINK), HREF)).alias("raw"),
        _first(_first(html, ROW % "contents"), PRE).alias("body"),
        _first(html, HEAD).alias("head"),
    )
    following = _nav(F.col("head"), "Next by date")
    return parts.select(
        sc.iso_date(unescape(F.col("date"))).alias("date"),
        unescape(F.col("from")).alias("sender"),
        _first(F.col("raw"), MESSAGE_ID).alias("id"),
        _first(_nav(F.col("head"), "Next by thread"), MESSAGE_ID).alias("next_thread"),
        _first(_nav(F.col("head"), "Previous by thread"), MESSAGE_ID).alias("prev_thread"),
        F.when(following != "", F.concat(F.lit(base_url), following)).otherwise(F.lit("")).alias("next_url"),
        unescape(F.col("title")).alias("subject"),
        unescape(F.col("body")).alias("text"),
    )
