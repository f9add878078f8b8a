"""Registered map, sampling, listing, card, page and report-text queries
(G1-G2, L4, N13-N15, T2-T5, H1)."""

from __future__ import annotations

import math
from string import Formatter

from pyspark.sql import functions as F

from trenchline.functions import text as tx
from trenchline.functions.rounding import py_round1_sql
from trenchline.operators import cards, daily, geo, pages, quality, rankings, sampling
from trenchline.plans.catalog import permits, register, with_permits
from trenchline.plans.queries_daily import WEEKDAY_SQL
from trenchline.plans.queries_rankings import LEADERBOARD_BY_DAY_SQL
from trenchline.sources.fixtures import table


# --- fixed values: the texts that the oracles expect, spelled out here so that a
# slip in the operators' own texts shows ---
class Said:
    REPORT_TITLE = '🕳️ Chicago Hole Report - '
    REPORT_TOTAL = 'Total Permits Starting to Dig: '
    REPORT_EMERGENCY = '🔴 Emergency Permits: '
    REPORT_REGULAR = '🔵 Regular Permits: '
    REPORT_INDENT = '     '
    ARROW_DOWN = '⬇️'
    ARROW_UP = '⬆️'
    VS_AVG = '% vs '
    AVG_SUFFIX = ' avg'
    LEADERBOARD_TITLE = '🏆 Top Diggers\n\n'
    OTHER_MARK = '👷'
    CARD_HEADER = "🎲 Hole Roulette!\n\nHere's a permit with a Dig Date yesterday\n\n"
    CARD_ADDRESS = '📍 '
    CARD_WORK = '🔧 '
    CARD_PERMIT = '📝 Permit #'
    CARD_EMERGENCY = '\n🚨 Emergency Work'
    CARD_LOCATION = '🚧 Location of Dig: '
    CARD_ELLIPSIS = '...'
    CARD_LIMIT = 300
    CITY_SUFFIX = ', Chicago, IL'
    DEFAULT_WORK_TYPE = 'General Construction'
    RANK_MARKS = ['🥇', '🥈', '🥉']
    SUMMARY_TEMPLATE = '📊 Chicago Dig Report - {day_name}\n\nTotal Permits: {actual_total} ({total_symbol}{total_diff_percent}% vs avg)\nEmergency Permits: {actual_emergency} ({emergency_symbol}{emergency_diff_percent}% vs avg)\n\n#ChicagoDigs #Infrastructure'
    PERMITS_TEMPLATE = '📍 Total Permits: {actual_total}\n\nEmergency Permits: {actual_emergency} {emergency_symbol}{emergency_diff_percent}% vs {day_name} avg\n\nRegular Permits: {actual_regular} {regular_symbol}{regular_diff_percent}% vs {day_name} avg'
# ---------------------------------------------------------------------------


def sql_str(s: str) -> str:
    """A Python string as a SQL expression (newlines via chr(10))."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


LAT0, LAT1, LON0, LON1 = geo.VALID_BOX
MAP_POINTS_BODY = f"""
select cast(dig_date as date) as day,
       case when is_emergency then 'emergency' else 'regular' end as layer,
       dig_ticket_number, latitude, longitude
from permits
where latitude between {LAT0}e0 and {LAT1}e0 and longitude between {LON0}e0 and {LON1}e0
  and latitude != 0 and longitude != 0 and dig_date is not null"""


@register("map_points", with_permits(MAP_POINTS_BODY), dates=["day"])
def q_map_points(spark, sf):
    """Valid permit locations per day, split into emergency / regular
    layers; the input must have rows."""
    return geo.map_points(quality.require_rows(permits(spark, sf)))


@register(
    "map_points_day",
    with_permits(f"select * from ({MAP_POINTS_BODY}) p where day = (select max(cast(dig_date as date)) from permits)"),
    dates=["day"],
)
def q_map_points_day(spark, sf):
    """The points of one day, the latest one (a pushed range on the dig date)."""
    p = permits(spark, sf)
    latest = p.select(F.max(F.to_date("dig_date"))).scalar()
    return geo.map_points(p, start=latest, end=latest)


HEAT_ZOOMS = (9, 11)


@register(
    "heat_layer",
    with_permits(
        f"""
select zoom, layer, x_cell, y_cell, weight, weight / {float(geo.WEIGHT_UNIT)}e0 / pow(2e0, {geo.HEAT_MAX_ZOOM} - zoom) as intensity,
       greatest({geo.HEAT_MIN_OPACITY}e0, least(1e0, weight / {float(geo.WEIGHT_UNIT)}e0 / pow(2e0, {geo.HEAT_MAX_ZOOM} - zoom))) as opacity
from (
  select zoom, layer, cx + dx as x_cell, cy + dy as y_cell, cast(sum(n * w) as bigint) as weight
  from binned, (
    select dx, dy, cast(round(1000 * least(1e0, ({geo.HEAT_RADIUS + geo.HEAT_BLUR} - {geo.HEAT_CELL_PIXELS} * sqrt(dx * dx + dy * dy)) / {geo.HEAT_BLUR}e0)) as bigint) as w
    from range(-20, 21) a(dx), range(-20, 21) b(dy)) s
  where w > 0 group by 1, 2, 3, 4) h""",
        f"""pixels as (
  select zoom, layer, (longitude + 180e0) / 360e0 * size as x,
         (0.5e0 - ln((1e0 + sine) / (1e0 - sine)) / {4 * math.pi!r}e0) * size as y
  from (select z.zoom, layer, longitude, {geo.TILE_PIXELS}e0 * pow(2e0, z.zoom) as size, sin(latitude * {math.pi!r}e0 / 180e0) as sine
        from ({MAP_POINTS_BODY}) p, (select cast(unnest([{', '.join(map(str, HEAT_ZOOMS))}]) as int) as zoom) z) q),
binned as (
  select zoom, layer, cast(floor(x / {geo.HEAT_CELL_PIXELS}e0) as bigint) as cx, cast(floor(y / {geo.HEAT_CELL_PIXELS}e0) as bigint) as cy, count(*) as n
  from pixels group by 1, 2, 3, 4)""",
    ),
)
def q_heat_layer(spark, sf):
    """Both layers as the heat map draws them, at two zoom levels."""
    return geo.heat_layer(geo.map_points(permits(spark, sf)), zooms=HEAT_ZOOMS)


@register(
    "density_grid",
    with_permits(
        f"""
select day, layer, cast(floor(latitude / {geo.GRID_CELL_DEG}e0) as bigint) as lat_cell,
       cast(floor(longitude / {geo.GRID_CELL_DEG}e0) as bigint) as lon_cell, cast(count(*) as bigint) as points
from ({MAP_POINTS_BODY}) p group by 1, 2, 3, 4"""
    ),
    dates=["day"],
)
def q_density_grid(spark, sf):
    """Heat-layer binning, points per 0.01-degree cell per day and layer."""
    return geo.density_grid(geo.map_points(permits(spark, sf)))


SAMPLE_SQL = """
select *, row_number() over (partition by cast(dig_date as date) order by priority, dig_ticket_number) as rn
from (select *, cast('0x' || substr(md5(dig_ticket_number || ':42'), 1, 15) as bigint) as priority
      from permits where dig_date is not null) d"""


@register(
    "sample_permits",
    with_permits(f"select cast(dig_date as date) as day, cast(1 as bigint) as rank, dig_ticket_number from ({SAMPLE_SQL}) s where rn = 1"),
    dates=["day"],
)
def q_sample_permits(spark, sf):
    """L4: one repeatable pseudo-random permit per dig day (seed 42)."""
    return sampling.sample_permits(permits(spark, sf), k=1, seed=42)


@register(
    "sampled_permits",
    with_permits(f"select * exclude (priority, rn) from ({SAMPLE_SQL}) s where rn <= 2"),
    stamps=["request_date", "dig_date", "expiration_date"],
)
def q_sampled_permits(spark, sf):
    """L4: two sampled permits of every dig day, as whole rows, in one read."""
    return sampling.sampled_permits(permits(spark, sf), k=2, seed=42)


@register(
    "permit_listing",
    with_permits(
        """
select dig_ticket_number as ticket,
       strftime(request_date, '%Y-%m-%d') as request_day,
       strftime(dig_date, '%Y-%m-%d') as dig_day,
       cast(street_number_from as varchar) || ' ' || street_direction || ' ' || street_name ||
         case when street_suffix is not null then ' ' || street_suffix else '' end as location,
       case when is_emergency then 'Yes' else 'No' end as emergency,
       round(latitude, 4) as lat, round(longitude, 4) as lon
from permits"""
    ),
)
def q_permit_listing(spark, sf):
    """The listing projection over every permit."""
    return cards.permit_listing(permits(spark, sf))


CARD_SQL = f"""
select dig_ticket_number,
       cast(street_number_from as varchar) || ' ' || street_direction || ' ' || street_name ||
         coalesce(' ' || street_suffix, '') || {sql_str(Said.CITY_SUFFIX)} as address,
       coalesce(nullif(replace(trim(dig_location), '_', ','), ''), {sql_str(Said.DEFAULT_WORK_TYPE)}) as work_type,
       is_emergency
from permits"""


@register("permit_card", with_permits(CARD_SQL))
def q_permit_card(spark, sf):
    """Address line and work type of every permit."""
    return cards.permit_cards(permits(spark, sf))


def html_text_sql(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for ent, ch in pages.ENTITIES:
        t = f"replace({t}, {sql_str(ent)}, {sql_str(ch)})"
    t = f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    return f"nullif({t}, '')"


def extract_sql(pattern: str) -> str:
    return html_text_sql(f"regexp_extract(html, {sql_str(pattern)}, 1)")


PAGE_FIELDS_SQL = f"""
select page_id, url, {extract_sql(pages.TITLE_PATTERN)} as title,
       {extract_sql(pages.TITLE_PATTERN)} as location_of_dig
from pages"""


@register("page_label_value", PAGE_FIELDS_SQL)
def q_page_label_value(spark, sf):
    """H1: title and 'Location of Dig' value of every stored page.  The test
    pages carry no permit markup, so each gets two permit rows in front: one
    without the wanted label and one whose value is the page's title."""
    rows = F.concat(
        F.lit('<div class="row"><label>Requested by</label><div class="col-sm-8">Somebody</div></div>'),
        F.lit("<div class='row'><label class='c'><b>Location of Dig</b></label>\n<div class='x col-sm-8'>"),
        F.regexp_extract("html", pages.TITLE_PATTERN, 1),
        F.lit("</div></div>"),
        F.col("html"),
    )
    return pages.page_fields(table(spark, sf, "pages").withColumn("html", rows))


def card_text_sql(locations: str = f"select cast(page_id as varchar) as dig_ticket_number, coalesce(location_of_dig, title) as location from ({PAGE_FIELDS_SQL}) pf") -> str:
    loc_head = sql_str(Said.CARD_LOCATION)
    room = f"(available - {len(Said.CARD_LOCATION) + len(Said.CARD_ELLIPSIS) + 1})"
    return with_permits(
        f"""
select dig_ticket_number, text, link_text,
       case when instr(text, link_text) > 0 then cast(strlen(substring(text, 1, instr(text, link_text) - 1)) as bigint) end
         as byte_start,
       case when instr(text, link_text) > 0
            then cast(strlen(substring(text, 1, instr(text, link_text) - 1)) + strlen(link_text) as bigint) end as byte_end
from (
  select dig_ticket_number, '#' || dig_ticket_number as link_text,
         base || case when location is null or location = '' then ''
                      when length({loc_head} || location || chr(10)) <= available then {loc_head} || location || chr(10)
                      when {room} > 0 then {loc_head} || substring(location, 1, {room}) || {sql_str(Said.CARD_ELLIPSIS)} || chr(10)
                      else '' end || permit as text
  from (
    select dig_ticket_number, location, base, permit, {Said.CARD_LIMIT} - length(base) - length(permit) as available
    from (
      select c.dig_ticket_number, l.location,
             {sql_str(Said.CARD_HEADER)} || {sql_str(Said.CARD_ADDRESS)} || c.address || chr(10) ||
               {sql_str(Said.CARD_WORK)} || c.work_type || chr(10) as base,
             {sql_str(Said.CARD_PERMIT)} || c.dig_ticket_number ||
               case when c.is_emergency then {sql_str(Said.CARD_EMERGENCY)} else '' end as permit
      from cards c left join loc l on l.dig_ticket_number = c.dig_ticket_number) a) b) t""",
        f"""cards as ({CARD_SQL}),
loc as ({locations})""",
    )


@register("permit_card_text", card_text_sql())
def q_permit_card_text(spark, sf):
    """T4/T5: the 300-character permit post of every permit and the byte span
    of its '#ticket' link.  The dig location comes from the stored page of
    the ticket (page_id = ticket); as the test pages carry no permit markup,
    their title stands in for the label value."""
    p = permits(spark, sf)
    pf = pages.page_fields(table(spark, sf, "pages"))
    locs = pf.select(
        F.col("page_id").cast("string").alias("dig_ticket_number"),
        F.coalesce("location_of_dig", "title").alias("location"),
    )
    out = cards.card_texts(cards.permit_cards(p), locs)
    return out.withColumn("byte_start", F.col("byte_start").cast("bigint")).withColumn("byte_end", F.col("byte_end").cast("bigint"))


def _report_sql() -> str:
    def line(pct: str) -> str:
        r = py_round1_sql(pct)
        return (
            f"{sql_str(Said.REPORT_INDENT)} || case when {r} < 0 then {sql_str(Said.ARROW_DOWN)} else {sql_str(Said.ARROW_UP)} end"
            f" || ' ' || cast(cast(round_even(abs({r}), 0) as bigint) as varchar) || {sql_str(Said.VS_AVG)} || day_name"
            f" || {sql_str(Said.AVG_SUFFIX)}"
        )

    nl2 = "chr(10) || chr(10)"
    return f"""
select day,
  {sql_str(Said.REPORT_TITLE)} || day_name || {nl2} ||
  {sql_str(Said.REPORT_TOTAL)} || cast(actual_total as varchar) || chr(10) || {line('total_diff_percent')} || {nl2} ||
  {sql_str(Said.REPORT_EMERGENCY)} || cast(actual_emergency as varchar) || chr(10) || {line('emergency_diff_percent')} || {nl2} ||
  {sql_str(Said.REPORT_REGULAR)} || cast(actual_regular as varchar) || chr(10) || {line('regular_diff_percent')} as text
from ({WEEKDAY_SQL}) w"""


@register("report_text", _report_sql(), dates=["day"])
def q_report_text(spark, sf):
    """The daily report text for every day, rounded as the report rounds."""
    return cards.report_texts(daily.weekday_comparison(permits(spark, sf)))


@register(
    "leaderboard_text",
    f"""
select day, {sql_str(Said.LEADERBOARD_TITLE)} || string_agg(line, '' order by rank) as text from (
  select day, rank,
         case rank when 1 then {sql_str(Said.RANK_MARKS[0])} when 2 then {sql_str(Said.RANK_MARKS[1])}
                   when 3 then {sql_str(Said.RANK_MARKS[2])} else {sql_str(Said.OTHER_MARK)} end
         || ' ' || name || ': ' || cast(count as varchar) || chr(10) as line
  from ({LEADERBOARD_BY_DAY_SQL}) l) x
group by day""",
    dates=["day"],
)
def q_leaderboard_text(spark, sf):
    """The per-day top-5 contractor text."""
    return cards.leaderboard_texts(rankings.leaderboard_by_day(permits(spark, sf), k=5))


def _template_sql(template: str) -> str:
    fields = {"day": "strftime(day, '%Y-%m-%d')", "day_name": "day_name"}
    for what in ("total", "emergency", "regular"):
        change = py_round1_sql(f"{what}_diff_percent")
        fields |= {
            f"actual_{what}": f"cast(actual_{what} as varchar)",
            f"{what}_diff_percent": f"printf('%.1f', abs({change}))",
            f"{what}_symbol": f"case when {change} < 0 then {sql_str(Said.ARROW_DOWN)} else {sql_str(Said.ARROW_UP)} end",
        }
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts += [sql_str(literal)] if literal else []
        parts += [f"({fields[name]})"] if name else []
    return f"select day, {' || '.join(parts)} as text from ({WEEKDAY_SQL}) w"


@register("report_text_summary", _template_sql(Said.SUMMARY_TEMPLATE), dates=["day"])
def q_report_text_summary(spark, sf):
    """T2 in the wording of the thread's summary post, given as a template."""
    return cards.report_texts(daily.weekday_comparison(permits(spark, sf)), tx.SUMMARY_TEMPLATE)


@register("report_text_permits", _template_sql(Said.PERMITS_TEMPLATE), dates=["day"])
def q_report_text_permits(spark, sf):
    """T2 in the wording of the thread's permit post, given as a template."""
    return cards.report_texts(daily.weekday_comparison(permits(spark, sf)), tx.PERMITS_TEMPLATE)
