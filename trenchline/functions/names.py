"""Contractor-name cleaning as native Spark expressions (no Python UDF).

``with_clean_name(df, src, dst)`` adds the cleaned form of ``src``.  The
rules run as a chain of projections, one rule per step, so each regular
expression is evaluated once per row and the whole chain stays inside
whole-stage codegen.  Callers apply it to *distinct* names (the number of
distinct contractor spellings, not the number of permits), then join or
re-aggregate.

Rules, in order (a value that is null or empty is returned as is):
 1. upper-case; drop every '*'; squeeze whitespace; trim.
 2. keep the first (by priority) parenthetical marker of PRESERVE_SUFFIXES,
    removing all its occurrences from the name.
 3. remove the REMOVE_SUFFIXES qualifiers, then any other non-empty
    parenthesis.  No trim here: a blank left behind stays (so "DWM (SEAL)"
    does not hit the dictionary; this mirrors the original behaviour).
 4. dictionary: the name, with each run of blanks/hyphens collapsed to one
    blank, looked up in NAME_MAPPINGS (keys collapsed the same way).  A hit
    returns the canonical name plus the kept marker.
 5. the first BUSINESS_SUFFIXES pattern found at the end is cut (and the
    name trimmed); its short form is appended at the end.
 6. ' AND ' -> ' & '; blanks around '&'; squeeze.
 7. whole-word expansions of WORD_REPLACEMENTS.
 8. per word, first rule wins: <= 3 chars, upper-case and not listed in
    WORD_CAPITALIZATIONS -> unchanged; starts with MC -> 'Mc' + capitalised
    rest; listed -> the listed form (capitalised when first); contains '-'
    -> each part capitalised; else capitalised.
 9. words joined, then business suffix, then kept marker; trimmed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: cleaning rules (patterns and lookup tables) ---------------
BUSINESS_SUFFIXES = [
    (r"(?:,\s+)?INC(?:ORPORATED)?\.?$", "Inc"),
    (r"(?:,\s+)?LLC\.?$", "LLC"),
    (r"(?:,\s+)?CO(?:MPANY)?\.?$", "Co"),
    (r"(?:,\s+)?CORP(?:ORATION)?\.?$", "Corp"),
    (r"(?:,\s+)?LTD\.?$", "Ltd"),
]
WORD_REPLACEMENTS = [
    (r"CONSTRUCTION", "Construction"),
    (r"NSTRUCTION", "Construction"),
    (r"CONSTR\.?", "Construction"),
    (r"CONST\.?", "Construction"),
    (r"PLBG\.?", "Plumbing"),
    (r"HTG\.?", "Heating"),
    (r"EXCAV\.?", "Excavating"),
    (r"CONCRETE", "Concrete"),
    (r"NCRETE", "Concrete"),
]
NAME_MAPPINGS = {
    "PEOPLES GAS": "Peoples Gas",
    "PEOPLE GAS": "Peoples Gas",
    "PEOPLES GAS LIGHT & COKE": "Peoples Gas",
    "INTEGRYS ENERGY GROUP / PEOPLES GAS": "Peoples Gas",
    "INTEGRYS ENERGY GROUP/PEOPLE GAS": "Peoples Gas",
    "COMED NORTH": "ComEd",
    "COMED": "ComEd",
    "COM ED": "ComEd",
    "COM-ED": "ComEd",
    "DWM": "Department of Water Management",
    "CITY OF CHICAGO DEPT OF WATER": "Department of Water Management",
    "CITY OF CHICAGO WATER DEPARTMENT": "Department of Water Management",
    "CITY OF CHICAGO (DEPT OF WATER MANAGEMENT)": "Department of Water Management",
    "CITY OF CHICAGO WATER DEPT": "Department of Water Management",
    "CHICAGO DEPT WATER MANAGEMENT": "Department of Water Management",
    "DEPT OF WATER MANAGEMENT": "Department of Water Management",
    "CDOT - IN HOUSE CONSTRUCTION": "CDOT - In-House Construction",
    "CDOT - IN-HOUSE CONSTRUCTION": "CDOT - In-House Construction",
    "CDOT - INHOUSECONSTRUCTION": "CDOT - In-House Construction",
    "CDOT-IN HOUSE CONSTRUCTION": "CDOT - In-House Construction",
    "CDOT-INHOUSECONSTRUCTION": "CDOT - In-House Construction",
    "CDOT-SIGN MANAGEMENT": "CDOT - Sign Management",
    "CDOT - SIGN MANAGEMENT": "CDOT - Sign Management",
    "SEVEN-D CONSTRUCTION": "Seven-D Construction",
    "SEVEN D CONSTRUCTION": "Seven-D Construction",
    "M & J ASPHALT": "M&J Asphalt",
    "M&J ASPHALT": "M&J Asphalt",
    "G & V CONST": "G&V Construction",
    "G&V CONST": "G&V Construction",
    "RELIABLE CONTRACTING & EQUIPMENT": "Reliable Contracting & Equipment",
    "RELIABLECONTRACTING&EQUIPMENT": "Reliable Contracting & Equipment",
    "RELIABLE CONTRACTING AND EQUIPMENT": "Reliable Contracting & Equipment",
    "MILLER PIPELINE": "Miller Pipeline",
}
WORD_CAPITALIZATIONS = {
    "OF": "of",
    "AND": "and",
    "THE": "the",
    "IN": "in",
    "AT": "at",
    "BY": "by",
    "FOR": "for",
    "WITH": "with",
    "LLC": "LLC",
    "INC": "Inc",
    "CO": "Co",
    "DEPT": "Dept",
    "DBA": "dba",
}
PRESERVE_SUFFIXES = [r"\(SL-\d+\)", r"\(SL\)", r"\(SEAL\)", r"\(OVERSIZE\)"]
REMOVE_SUFFIXES = [
    r"\(HOMEOWNER\)",
    r"\(CONSTRUCTION\)",
    r"\(COMMERCIAL\)",
    r"\(LESSEE\)",
    r"\(LOT OWNER\)",
    r"\(DWM CONTRACT\)",
]
# ---------------------------------------------------------------------------

# Java regex flags: (?U) makes \s and \d Unicode-aware like Python's str
# patterns; \x1c-\x1f are whitespace to Python's str methods as well.
_WS = r"[\s\x{1c}-\x{1f}]"
_WS_RUN = "(?U)" + _WS + "+"
_DASH_WS_RUN = "(?U)[-\\s\\x{1c}-\\x{1f}]+"


def _collapse_key(s: str) -> str:
    """Dictionary key form: runs of blanks/hyphens -> one blank (applied to the
    fixed keys once, when the plan is built)."""
    return re.sub(r"[-\s]+", " ", s.upper())


def _mapping_literal() -> Column:
    collapsed: dict[str, str] = {}
    for k, v in NAME_MAPPINGS.items():  # first key wins, as in a first-match scan
        collapsed.setdefault(_collapse_key(k), v)
    kv = []
    for k, v in collapsed.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def _caps_literal() -> Column:
    kv = []
    for k, v in WORD_CAPITALIZATIONS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def _capitalize(s: Column) -> Column:
    """Python str.capitalize: first character upper, the rest lower."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def _case_word(v: Column, i: Column) -> Column:
    """Rule 8: capitalisation of the word at position i."""
    listed = v.isin(list(WORD_CAPITALIZATIONS))
    is_upper = (v == F.upper(v)) & (v != F.lower(v))
    hyphen_parts = F.array_join(F.transform(F.split(v, "-", -1), _capitalize), "-")
    return (
        F.when((F.length(v) <= 3) & is_upper & ~listed, v)
        .when(F.upper(v).startswith("MC"), F.concat(F.lit("Mc"), _capitalize(F.substring(v, 3, 1 << 30))))
        .when(listed & (i == 0), _capitalize(v))
        .when(listed, F.try_element_at(_caps_literal(), v))
        .when(v.contains("-"), hyphen_parts)
        .otherwise(_capitalize(v))
    )


def with_clean_name(df: DataFrame, src: str, dst: str = "clean_name", strict_suffix: bool = False) -> DataFrame:
    """Add ``dst`` = cleaned ``src`` (see module doc).

    ``strict_suffix``: a business suffix counts only as a word of its own, so
    "MEXICO" does not end in "CO"; by default it may end any word."""
    begins = r"(?:,\s+|(?<![\p{L}\p{N}]))" if strict_suffix else r"(?:,\s+)?"
    raw = F.col(src)
    t = "__nm_"
    # 1. case, asterisks, whitespace
    df = df.withColumn(t + "n1", F.trim(F.regexp_replace(F.regexp_replace(F.upper(raw), r"\*", ""), _WS_RUN, " ")))
    # 2. kept marker: first pattern (by priority) that occurs
    found = [F.regexp_extract(F.col(t + "n1"), "(?iU)" + p, 0) for p in PRESERVE_SUFFIXES]
    keep = None
    cut = None
    for p, m in zip(PRESERVE_SUFFIXES, found):
        hit = m != F.lit("")
        keep = F.when(hit, F.concat(F.lit(" "), m)) if keep is None else keep.when(hit, F.concat(F.lit(" "), m))
        rm = F.regexp_replace(F.col(t + "n1"), "(?iU)" + p, "")
        cut = F.when(hit, rm) if cut is None else cut.when(hit, rm)
    df = df.withColumn(t + "keep", keep.otherwise(F.lit(""))).withColumn(t + "n2", cut.otherwise(F.col(t + "n1")))
    # 3. qualifiers, then any other parenthesis (no trim afterwards)
    n3 = F.col(t + "n2")
    for p in REMOVE_SUFFIXES:
        n3 = F.regexp_replace(n3, "(?iU)" + p, "")
    n3 = F.regexp_replace(n3, r"\([^)]+\)", "")
    df = df.withColumn(t + "n3", n3)
    # 4. dictionary on the collapsed form
    df = df.withColumn(t + "canon", F.try_element_at(_mapping_literal(), F.regexp_replace(F.col(t + "n3"), _DASH_WS_RUN, " ")))
    # 5. business suffix at the end: first pattern that matches
    bs = None
    n5 = None
    for p, short in BUSINESS_SUFFIXES:
        p = begins + p.removeprefix(r"(?:,\s+)?")
        hit = F.col(t + "n3").rlike("(?iU)" + p)
        bs = F.when(hit, F.lit(" " + short)) if bs is None else bs.when(hit, F.lit(" " + short))
        rm = F.trim(F.regexp_replace(F.col(t + "n3"), "(?iU)" + p, ""))
        n5 = F.when(hit, rm) if n5 is None else n5.when(hit, rm)
    df = df.withColumn(t + "bs", bs.otherwise(F.lit(""))).withColumn(t + "n5", n5.otherwise(F.col(t + "n3")))
    # 6. conjunctions and ampersands
    n6 = F.replace(F.col(t + "n5"), F.lit(" AND "), F.lit(" & "))
    n6 = F.regexp_replace(F.replace(n6, F.lit("&"), F.lit(" & ")), _WS_RUN, " ")
    df = df.withColumn(t + "n6", n6)
    # 7-8. per-word expansion and capitalisation, with the word position
    # 7. whole-word expansions as whole-string replacements: after step 6 the
    # words are separated by single blanks, so "whole word" = between blanks
    # or string ends (a compiled regex per target, no per-word lambda)
    n7 = F.trim(F.col(t + "n6"))
    for repl in dict.fromkeys(r for _, r in WORD_REPLACEMENTS):
        alts = "|".join(p for p, r in WORD_REPLACEMENTS if r == repl)
        n7 = F.regexp_replace(n7, "(?<=^| )(?:" + alts + ")(?= |$)", repl)
    df = df.withColumn(t + "n7", F.split(n7, " ", -1))
    # 8. capitalisation needs the word and its position
    df = df.withColumn(t + "n8", F.array_join(F.transform(F.col(t + "n7"), _case_word), " "))
    # 9. assemble
    general = F.trim(F.concat(F.col(t + "n8"), F.col(t + "bs"), F.col(t + "keep")))
    mapped = F.concat(F.col(t + "canon"), F.col(t + "keep"))
    out = F.when(raw.isNull() | (raw == F.lit("")), raw).when(F.col(t + "canon").isNotNull(), mapped).otherwise(general)
    df = df.withColumn(dst, out)
    return df.drop(*[c for c in df.columns if c.startswith(t)])
