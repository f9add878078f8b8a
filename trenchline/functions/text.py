"""Fixed output texts of the reports and the permit card, and the column
expressions that fill them (T2-T5, N13-N15).

Everything is built from ``concat`` / ``when`` / ``substring`` /
``octet_length``: no Python per row.  Lengths are in code points, as the
300-character post limit counts them; byte offsets are UTF-8 bytes.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from trenchline.functions.rounding import py_format0, py_round1

# --- fixed values: report and card texts ------------------------------------
REPORT_TITLE = "🕳️ Chicago Hole Report - "
REPORT_TOTAL = "Total Permits Starting to Dig: "
REPORT_EMERGENCY = "🔴 Emergency Permits: "
REPORT_REGULAR = "🔵 Regular Permits: "
REPORT_INDENT = "     "
ARROW_DOWN = "⬇️"
ARROW_UP = "⬆️"
VS_AVG = "% vs "
AVG_SUFFIX = " avg"
LEADERBOARD_TITLE = "🏆 Top Diggers\n\n"
RANK_MARKS = ["🥇", "🥈", "🥉"]
OTHER_MARK = "👷"
CARD_HEADER = "🎲 Hole Roulette!\n\nHere's a permit with a Dig Date yesterday\n\n"
CARD_ADDRESS = "📍 "
CARD_WORK = "🔧 "
CARD_PERMIT = "📝 Permit #"
CARD_EMERGENCY = "\n🚨 Emergency Work"
CARD_LOCATION = "🚧 Location of Dig: "
CARD_ELLIPSIS = "..."
CARD_LIMIT = 300
CITY_SUFFIX = ", Chicago, IL"
DEFAULT_WORK_TYPE = "General Construction"
# ---------------------------------------------------------------------------


def _s(c) -> Column:
    return c.cast("string") if isinstance(c, Column) else F.lit(str(c))


def arrow(pct: Column) -> Column:
    """Down arrow for a negative (rounded) change, up arrow otherwise."""
    return F.when(pct < 0, F.lit(ARROW_DOWN)).otherwise(F.lit(ARROW_UP))


def change_line(pct_raw: Column, day_name: Column) -> Column:
    """'     <arrow> <|pct|>% vs <day> avg' with the report's two roundings."""
    pct = py_round1(pct_raw)
    return F.concat(F.lit(REPORT_INDENT), arrow(pct), F.lit(" "), py_format0(F.abs(pct)), F.lit(VS_AVG), day_name, F.lit(AVG_SUFFIX))


def _line_if(line: Column) -> Column:
    """The line on a row of its own; nothing where it is null (too little history)."""
    return F.coalesce(F.concat(F.lit("\n"), line), F.lit(""))


def report_text(day_name: Column, total: Column, emergency: Column, regular: Column,
                total_pct: Column, emergency_pct: Column, regular_pct: Column) -> Column:
    """The daily report post."""
    return F.concat(
        F.lit(REPORT_TITLE), day_name, F.lit("\n\n"),
        F.lit(REPORT_TOTAL), _s(total), _line_if(change_line(total_pct, day_name)), F.lit("\n\n"),
        F.lit(REPORT_EMERGENCY), _s(emergency), _line_if(change_line(emergency_pct, day_name)), F.lit("\n\n"),
        F.lit(REPORT_REGULAR), _s(regular), _line_if(change_line(regular_pct, day_name)),
    )


# --- fixed values: other wordings of the daily posts ---
SUMMARY_TEMPLATE = (
    "📊 Chicago Dig Report - {day_name}\n\n"
    "Total Permits: {actual_total} ({total_symbol}{total_diff_percent}% vs avg)\n"
    "Emergency Permits: {actual_emergency} ({emergency_symbol}{emergency_diff_percent}% vs avg)\n\n"
    "#ChicagoDigs #Infrastructure"
)
PERMITS_TEMPLATE = (
    "📍 Total Permits: {actual_total}\n\n"
    "Emergency Permits: {actual_emergency} {emergency_symbol}{emergency_diff_percent}% vs {day_name} avg\n\n"
    "Regular Permits: {actual_regular} {regular_symbol}{regular_diff_percent}% vs {day_name} avg"
)
# -------------------------------------------------------


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """``template`` with each {name} replaced by the text of a column; null if one is null."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in fields:
                raise ValueError(f"no field {name!r}; there are {sorted(fields)}")
            parts.append(fields[name])
    return F.concat(*parts) if parts else F.lit("")


def report_fields() -> dict[str, Column]:
    """What a template can say of a row of the weekday comparison: counts, the
    rounded change in percent without its sign, and an arrow for the sign."""
    fields = {"day": F.date_format("day", "yyyy-MM-dd"), "day_name": F.col("day_name"), "num_days": _s(F.col("num_days"))}
    for what in ("total", "emergency", "regular"):
        change = py_round1(F.col(f"{what}_diff_percent"))
        fields[f"actual_{what}"] = _s(F.col(f"actual_{what}"))
        fields[f"avg_{what}"] = F.format_string("%.1f", py_round1(F.col(f"avg_{what}")))
        fields[f"{what}_diff_percent"] = F.format_string("%.1f", F.abs(change))
        fields[f"{what}_symbol"] = arrow(change)
    return fields


def leaderboard_line(rank: Column, name: Column, count: Column) -> Column:
    """T3: '<mark> <name>: <count>\\n' (medals for ranks 1-3)."""
    mark = (
        F.when(rank == 1, F.lit(RANK_MARKS[0]))
        .when(rank == 2, F.lit(RANK_MARKS[1]))
        .when(rank == 3, F.lit(RANK_MARKS[2]))
        .otherwise(F.lit(OTHER_MARK))
    )
    return F.concat(mark, F.lit(" "), name, F.lit(": "), _s(count), F.lit("\n"))


def strip_ws(c: Column) -> Column:
    """Python str.strip(): leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def address(number: Column, direction: Column, street: Column, suffix: Column) -> Column:
    """N14: 'number direction street suffix, Chicago, IL' of the parts that exist."""
    line = F.concat_ws(" ", number.cast("string"), direction, street, suffix)
    return F.when(line == "", F.lit(CITY_SUFFIX.lstrip(", "))).otherwise(F.concat(line, F.lit(CITY_SUFFIX)))


def work_type(location: Column) -> Column:
    """Trimmed placement text with '_' -> ','; blank or null -> the default."""
    v = F.translate(strip_ws(location), "_", ",")
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(DEFAULT_WORK_TYPE))


def card_text(address_c: Column, work_c: Column, ticket: Column, is_emergency: Column, location: Column) -> Column:
    """T4: the permit post, at most CARD_LIMIT characters.  The location line
    is cut with '...' to fit, or dropped when even that does not fit."""
    base = F.concat(F.lit(CARD_HEADER), F.lit(CARD_ADDRESS), address_c, F.lit("\n"), F.lit(CARD_WORK), work_c, F.lit("\n"))
    permit = F.concat(F.lit(CARD_PERMIT), ticket, F.when(is_emergency, F.lit(CARD_EMERGENCY)).otherwise(F.lit("")))
    available = F.lit(CARD_LIMIT) - F.length(base) - F.length(permit)
    full_line = F.concat(F.lit(CARD_LOCATION), location, F.lit("\n"))
    room = available - F.lit(len(CARD_LOCATION) + len(CARD_ELLIPSIS) + 1)
    cut_line = F.concat(F.lit(CARD_LOCATION), F.substring(location, F.lit(1), room), F.lit(CARD_ELLIPSIS), F.lit("\n"))
    loc_line = (
        F.when(location.isNull() | (location == F.lit("")), F.lit(""))
        .when(F.length(full_line) <= available, full_line)
        .when(room > 0, cut_line)
        .otherwise(F.lit(""))
    )
    return F.concat(base, loc_line, permit)


def link_span(text: Column, link: Column) -> tuple[Column, Column]:
    """T5: UTF-8 byte start/end of the first occurrence of ``link`` in ``text``."""
    pos = F.instr(text, link)
    start = F.when(pos > 0, F.octet_length(F.substring(text, F.lit(1), pos - 1)))
    return start, start + F.octet_length(link)
