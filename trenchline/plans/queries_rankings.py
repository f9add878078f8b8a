"""Registered leaderboards and name reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.operators import rankings
from trenchline.plans.catalog import permits, register, with_permits

CNAME = (
    "case when contact_first_name = '' or contact_first_name is null then contact_last_name "
    "else contact_first_name || ' ' || contact_last_name end"
)
HAS_LAST = "contact_last_name is not null and contact_last_name != ''"


def clean_case(x: str, strict: bool = False) -> str:
    """Cleaned form of every raw spelling the permit fixture produces
    (customer names 'Customer#...' are unchanged by the rules)."""
    pairs = [
        ("PEOPLES GAS", "Peoples Gas"),
        ("People Gas", "Peoples Gas"),
        ("ACME CONST. CO.", "Acme Construction Co"),
        ("Acme Construction Company", "Acme Construction Co"),
        ("PEOPLE GAS", "Peoples Gas"),
        ("M & J ASPHALT *", "M&J Asphalt"),
        ("M & J Asphalt *", "M&J Asphalt"),
        ("m & j Asphalt *", "M&J Asphalt"),
        ("CASA MEXICO", strict and "Casa Mexico" or "Casa Mexi Co"),
        ("SMITH CONSTR. (SL-1234)", "Smith Construction (SL-1234)"),
        ("PAT PEOPLES GAS", "PAT Peoples GAS"),
        ("PAT People Gas", "PAT People GAS"),
        ("PAT ACME CONST. CO.", "PAT Acme Construction Co"),
        ("PAT Acme Construction Company", "PAT Acme Construction Co"),
        ("PAT PEOPLE GAS", "PAT People GAS"),
        ("PAT M & J ASPHALT *", "PAT M & J Asphalt"),
        ("PAT M & J Asphalt *", "PAT M & J Asphalt"),
        ("PAT m & j Asphalt *", "PAT M & J Asphalt"),
        ("PAT CASA MEXICO", strict and "PAT Casa Mexico" or "PAT Casa Mexi Co"),
        ("PAT SMITH CONSTR. (SL-1234)", "PAT Smith Construction (SL-1234)"),
    ]
    whens = " ".join(f"when '{a}' then '{b}'" for a, b in pairs)
    return f"(case {x} {whens} else {x} end)"


def _bigint_rank(df):
    return df.withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "leaderboard",
    with_permits(
        f"""
select cast(row_number() over (order by cnt desc, contractor_name) as bigint) as rank, name, cnt as count
from (select contractor_name, cnt, {clean_case('contractor_name')} as name from top) t
where name != ''""",
        f"""c as (select {CNAME} as contractor_name, cast(count(*) as bigint) as cnt
          from permits where {HAS_LAST} group by 1),
top as (select * from c order by cnt desc, contractor_name limit 5)""",
    ),
)
def q_leaderboard(spark, sf):
    return _bigint_rank(rankings.leaderboard(permits(spark, sf), k=5))


@register(
    "leaderboard_merged",
    with_permits(
        """
select rank, name, cnt as count from (
  select cast(row_number() over (order by cnt desc, name) as bigint) as rank, name, cnt from m where name != '') r
where rank <= 5""",
        f"""c as (select {CNAME} as contractor_name, count(*) as cnt
          from permits where {HAS_LAST} group by 1),
m as (select {clean_case('contractor_name')} as name, cast(sum(cnt) as bigint) as cnt from c group by 1)""",
    ),
)
def q_leaderboard_merged(spark, sf):
    return _bigint_rank(rankings.leaderboard(permits(spark, sf), k=5, merge_names=True))


@register(
    "leaderboard_emergency",
    with_permits(
        f"""
select cast(row_number() over (order by cnt desc, contractor_name) as bigint) as rank, name, cnt as count
from (select contractor_name, cnt, {clean_case('contractor_name')} as name from top) t
where name != ''""",
        f"""c as (select {CNAME} as contractor_name, cast(count(*) as bigint) as cnt
          from permits where {HAS_LAST} and is_emergency group by 1),
top as (select * from c order by cnt desc, contractor_name limit 5)""",
    ),
)
def q_leaderboard_emergency(spark, sf):
    return _bigint_rank(rankings.leaderboard(permits(spark, sf), k=5, emergency_only=True))


LEADERBOARD_BY_DAY_SQL = with_permits(
    """
select day, cast(row_number() over (partition by day order by cnt desc, contractor_name) as bigint) as rank,
       name, cnt as count
from t where name != ''""",
    f"""c as (select cast(dig_date as date) as day, {CNAME} as contractor_name, cast(count(*) as bigint) as cnt
          from permits where {HAS_LAST} and dig_date is not null group by 1, 2),
r as (select *, row_number() over (partition by day order by cnt desc, contractor_name) as r0 from c),
t as (select day, contractor_name, cnt, {clean_case('contractor_name')} as name from r where r0 <= 5)""",
)


LEADERBOARD_BY_DAY_MERGED_SQL = with_permits(
    """
select day, rank, name, cnt as count from (
  select day, name, cnt, cast(row_number() over (partition by day order by cnt desc, name) as bigint) as rank
  from m where name != '') r
where rank <= 5""",
    f"""c as (select cast(dig_date as date) as day, {CNAME} as contractor_name, count(*) as cnt
          from permits where {HAS_LAST} and dig_date is not null group by 1, 2),
m as (select day, {clean_case('contractor_name')} as name, cast(sum(cnt) as bigint) as cnt from c group by 1, 2)""",
)


@register("leaderboard_by_day_merged", LEADERBOARD_BY_DAY_MERGED_SQL, dates=["day"])
def q_leaderboard_by_day_merged(spark, sf):
    return _bigint_rank(rankings.leaderboard_by_day(permits(spark, sf), k=5, merge_names=True))


@register("leaderboard_by_day", LEADERBOARD_BY_DAY_SQL, dates=["day"])
def q_leaderboard_by_day(spark, sf):
    return _bigint_rank(rankings.leaderboard_by_day(permits(spark, sf), k=5))


@register(
    "leaderboard_streets",
    with_permits(
        """
select rank, name, count from (
  select cast(row_number() over (order by cnt desc, name) as bigint) as rank, name, cnt as count
  from (select street_name as name, cast(count(*) as bigint) as cnt from permits
        where street_name is not null and street_name != '' group by 1) s) r
where rank <= 5"""
    ),
)
def q_leaderboard_streets(spark, sf):
    return _bigint_rank(rankings.leaderboard_streets(permits(spark, sf), k=5))


@register(
    "contact_pairs",
    with_permits(
        """
select contact_first_name, contact_last_name, count, rank from (
  select contact_first_name, contact_last_name, cnt as count,
         cast(row_number() over (order by cnt desc, contact_first_name asc nulls first,
                                 contact_last_name asc nulls first) as bigint) as rank
  from (select contact_first_name, contact_last_name, cast(count(*) as bigint) as cnt
        from permits group by 1, 2) g) r
where rank <= 10"""
    ),
)
def q_contact_pairs(spark, sf):
    return _bigint_rank(rankings.contact_pairs(permits(spark, sf), k=10))


def _freq_sql(where: str, k: int) -> str:
    return with_permits(
        f"""
select rank, name, frequency from (
  select cast(row_number() over (order by frequency desc, name) as bigint) as rank, name, frequency
  from (select contact_last_name as name, cast(count(*) as bigint) as frequency from permits
        where {HAS_LAST} {where} group by 1) g) r
where rank <= {k}"""
    )


@register("name_frequency", _freq_sql("", 100))
def q_name_frequency(spark, sf):
    return _bigint_rank(rankings.name_frequency(permits(spark, sf), k=100))


SPECIAL_WHERE = (
    "and (contact_last_name like '%*%' or contact_last_name like '%(%' or contact_last_name like '%)%' "
    "or contact_last_name like '%-%' or contact_last_name like '%&%' or contact_last_name like '%/%')"
)


@register("name_special_chars", _freq_sql(SPECIAL_WHERE, 20))
def q_name_special_chars(spark, sf):
    return _bigint_rank(rankings.name_special_chars(permits(spark, sf), k=20))


@register(
    "name_case_variants",
    with_permits(
        f"""
select rank, variations, total_frequency, upper_name from (
  select cast(row_number() over (order by total_frequency desc, upper_name) as bigint) as rank,
         variations, total_frequency, upper_name
  from (select upper(original_name) as upper_name,
               string_agg(original_name, ' | ' order by original_name) as variations,
               cast(sum(frequency) as bigint) as total_frequency
        from (select contact_last_name as original_name, count(*) as frequency from permits
              where {HAS_LAST} group by 1) n
        group by 1 having count(*) > 1) g) r
where rank <= 20"""
    ),
)
def q_name_case_variants(spark, sf):
    return _bigint_rank(rankings.name_case_variants(permits(spark, sf), k=20))


@register(
    "normalize_names",
    with_permits(
        f"""
select raw_name, {clean_case('raw_name')} as clean_name, frequency
from (select contact_last_name as raw_name, cast(count(*) as bigint) as frequency from permits
      where {HAS_LAST} group by 1) n"""
    ),
)
def q_normalize_names(spark, sf):
    return rankings.normalize_names(permits(spark, sf))


@register(
    "normalize_names_strict",
    with_permits(
        f"""
select raw_name, {clean_case('raw_name', strict=True)} as clean_name, frequency
from (select contact_last_name as raw_name, cast(count(*) as bigint) as frequency from permits
      where {HAS_LAST} group by 1) n"""
    ),
)
def q_normalize_names_strict(spark, sf):
    """T1 with business suffixes as words of their own only."""
    return rankings.normalize_names(permits(spark, sf), strict_suffix=True)
