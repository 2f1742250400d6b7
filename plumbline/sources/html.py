"""Rows out of HTML tables and lists, with SQL functions only."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: texts that mean "no group" ------------------------------
NO_GROUP = ("-", "–", "—")
CELLS = 11


def unescape(c: F.Column) -> F.Column:
    """Character references decoded: decimal, hexadecimal and named ones. Others stay."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)&#?\w{1,32};|[^&]+|&"), F.lit(0))
    names = F.create_map(*[F.lit(x) for n, k in sorted(name2codepoint.items()) for x in (n, chr(k))])

    def decoded(part: F.Column) -> F.Column:
        number = F.coalesce(
            F.regexp_extract(part, r"^&#(\d{1,7});$", 1).try_cast("bigint"),
            F.conv(F.nullif(F.regexp_extract(part, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1), F.lit("")), 16, 10)
            .try_cast("bigint"),
        )
        sound = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        name = F.regexp_extract(part, r"^&(\w+);$", 1)
        named = F.when(name == "apos", "'").otherwise(F.try_element_at(names, name))
        return F.when(sound, char).otherwise(F.coalesce(named, part))

    return F.array_join(F.transform(parts, decoded), "")


def inner_text(c: F.Column) -> F.Column:
    """Text of a cell: a tag parts what stands beside it by a blank."""
    text = unescape(F.regexp_replace(c, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))


def table_rows(pages: DataFrame, table_id: str, *, html: str = "html", key: str = "page_id"):
    """One row per body row of ``<table id=...>`` with its cell texts."""
    own = re.escape(table_id)
    body = F.regexp_extract(
        html, rf"(?is)<table\b[^>]*\bid=[\"']?{own}[\"'\s>].*?<tbody[^>]*>(.*?)</tbody>", 1
    )
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all(F.col("_row"), F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    return pages.select(key, F.posexplode(rows).alias("row", "_row")).select(
        key, "row", F.transform(cells, inner_text).alias("cells")
    )


def checked_cells(rows: DataFrame, names: list[str], *, group: str = "group") -> DataFrame:
    """Named cells; a row with another number of cells is an error, a dash is no group."""
    cells = F.when(F.size("cells") == len(names), F.col("cells")).otherwise(
        F.raise_error(F.lit(f"expected {len(names)} cells per row")).cast("array<string>")
    )
    named = rows.select(
        *[c for c in rows.columns if c != "cells"],
        *[F.element_at(cells, i + 1).alias(n) for i, n in enumerate(names)],
    )
    if group not in names:
        return named
    g = F.col(group)
    return named.withColumn(group, F.when(g.isin(*NO_GROUP), "").otherwise(g))


def list_links(pages: DataFrame, *, html: str = "html", key: str = "page_id") -> DataFrame:
    """(page, position, href, text) of every ``<li><a href=...>`` element."""
    item = r"<li><a href=\"([^\"]*)\">([^<]*)</a></li>"
    hits = F.regexp_extract_all(html, F.lit(item), F.lit(0))
    return pages.select(key, F.posexplode(hits).alias("position", "_hit")).select(
        key,
        F.col("position").cast("bigint").alias("position"),
        F.regexp_extract("_hit", item, 1).alias("href"),
        F.regexp_extract("_hit", item, 2).alias("text"),
    )
