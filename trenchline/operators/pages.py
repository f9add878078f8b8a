"""Values from stored permit web pages (H1).

The reference downloads one page per sampled permit and reads the value next
to the label "Location of Dig".  Here the pages are a table (``page_id, url,
html``) that was landed beforehand, and the extraction is a regular
expression over each whole page, run as a column expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION_LABEL = "Location of Dig"  # fixed value: the label of the wanted field

# HTML entities decoded in extracted text; '&amp;' last so '&amp;lt;' stays '&lt;'.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def label_value_pattern(label: str) -> str:
    """Within one row: its label (markup inside allowed) and the ``col-sm-8`` value div, one level of nested divs included."""
    inside = r"(?:(?!</label>).)*"
    flat = r"(?:(?!</?div).)*"
    return (
        r"(?s)^[^>]*>(?:(?!<label).)*<label[^>]*>" + inside + re.escape(label) + inside + r"</label>"
        r"(?:(?!<label).)*?<div[^>]*class\s*=\s*[\"'][^\"'>]*col-sm-8[^\"'>]*[\"'][^>]*>(" + flat + r"(?:<div[^>]*>" + flat + r"</div>" + flat + r")*)</div>"
    )


ROW_OPENING = r"(?i)<div(?=[^>]*class\s*=\s*[\"'](?:[^\"'>]*\s)?row[\s\"'])"


def label_value(html: Column, label: str) -> Column:
    """Value beside ``label`` in the first row block that has it; never from another row."""
    pattern = label_value_pattern(label)
    rows = F.filter(F.split(html, ROW_OPENING), lambda r: r.rlike(pattern))
    return html_text(F.regexp_extract(F.get(rows, 0), pattern, 1))


TITLE_PATTERN = r"(?s)<title[^>]*>(.*?)</title>"


def html_text(fragment: Column) -> Column:
    """Visible text of an HTML fragment: tags removed, entities decoded,
    surrounding whitespace stripped; empty -> null."""
    t = F.regexp_replace(fragment, r"<[^>]*>", "")
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    return F.nullif(t, F.lit(""))


def extract(html: Column, pattern: str) -> Column:
    return html_text(F.regexp_extract(html, pattern, 1))


def page_fields(pages: DataFrame, label: str = LOCATION_LABEL) -> DataFrame:
    """``page_id, url, title, location_of_dig`` for every stored page."""
    return pages.select(
        "page_id",
        "url",
        extract(F.col("html"), TITLE_PATTERN).alias("title"),
        label_value(F.col("html"), label).alias("location_of_dig"),
    )
