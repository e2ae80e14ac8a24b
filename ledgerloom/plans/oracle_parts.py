"""DuckDB SQL of the matching tiers, as CTEs that several oracle queries share."""

from __future__ import annotations

import re

from ledgerloom.plans.fixed import AMOUNT_DAYS, BLOCKED_CATEGORIES, IDENTIFIER_DAYS, RCM_CATEGORIES, STATE_ALIASES, STATE_NAMES, TIEBREAK_DAYS, TOLERANCE
from ledgerloom.sources.ledger_views import duckdb_ctes

VIEWS = f"WITH {duckdb_ctes()}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CANONICAL = """
ca AS (SELECT row_index, gstin, identifier, taxable_value, igst, cgst, sgst, invoice_date FROM gstr2a),
cb AS (SELECT row_index, gstin, identifier, taxable_value, igst, cgst, sgst, invoice_date FROM books),
ka AS (SELECT gstin, identifier, count(*) AS n FROM ca WHERE identifier <> '' GROUP BY ALL),
kb AS (SELECT gstin, identifier, count(*) AS n FROM cb WHERE identifier <> '' GROUP BY ALL)"""


def runs(side: str) -> str:
    return f"""
runs_{side} AS (
  SELECT gstin, identifier, regexp_full_match(identifier, '[0-9]+') AS plain,
    unnest(list_distinct(list_transform(list_filter(regexp_extract_all(identifier, '[0-9]+'), lambda r: len(r) >= 3), lambda r: regexp_replace(r, '^0+([0-9])', '\\1')))) AS run
  FROM k{side}),
lone_{side} AS (SELECT gstin, run, min(identifier) AS identifier FROM runs_{side} GROUP BY ALL HAVING count(*) = 1),
pure_{side} AS (SELECT gstin, run, min(identifier) AS identifier FROM runs_{side} WHERE plain GROUP BY ALL HAVING count(*) = 1)"""


def bridge(own: str, other: str) -> str:
    return f"""
bridge_{own} AS (
  SELECT r.gstin, r.identifier, l.identifier AS other_identifier
  FROM runs_{own} r JOIN lone_{other} l USING (gstin, run) WHERE r.plain AND (r.gstin, r.identifier) NOT IN (SELECT gstin, identifier FROM k{other})
  UNION ALL
  SELECT gstin, identifier, min(other_identifier) FROM (
    SELECT r.gstin, r.identifier, p.identifier AS other_identifier
    FROM runs_{own} r JOIN lone_{own} USING (gstin, run) JOIN pure_{other} p ON p.gstin = r.gstin AND p.run = r.run
    WHERE NOT r.plain AND (r.gstin, r.identifier) NOT IN (SELECT gstin, identifier FROM k{other})) GROUP BY gstin, identifier HAVING count(DISTINCT other_identifier) = 1)"""


def taxes(x: str, y: str) -> str:
    return " AND ".join(f"abs({x}.{c} - {y}.{c}) <= {TOLERANCE}" for c in ("taxable_value", "igst", "cgst", "sgst"))


def left_over(own: str, other: str, excluded: str = "SELECT NULL::BIGINT AS row_index WHERE false") -> str:
    return f"""
left_{own} AS (
  SELECT x.* FROM c{own} x JOIN k{own} k USING (gstin, identifier) LEFT JOIN k{other} o USING (gstin, identifier)
  WHERE (CASE WHEN o.n IS NULL THEN (x.gstin, x.identifier) NOT IN (SELECT gstin, identifier FROM bridge_{own})
    WHEN k.n = 1 AND o.n = 1 THEN false
    ELSE NOT EXISTS (SELECT 1 FROM c{other} y WHERE y.gstin = x.gstin AND y.identifier = x.identifier AND {taxes("x", "y")}) END)
    AND x.row_index NOT IN ({excluded}))"""


def unique_pairs(name: str, body: str) -> str:
    return f"""
{name}_all AS ({body}),
{name} AS (SELECT * FROM {name}_all QUALIFY count(*) OVER (PARTITION BY l_row_index) = 1 AND count(*) OVER (PARTITION BY r_row_index) = 1)"""


_PICK = "x.gstin, x.row_index AS l_row_index, y.row_index AS r_row_index, x.identifier AS l_identifier, y.identifier AS r_identifier, x.igst AS l_igst, x.cgst AS l_cgst, x.sgst AS l_sgst"


def _segments(column: str) -> str:
    return f"list_filter(string_split(regexp_replace(upper(trim({column})), '[-/]+', '-', 'g'), '-'), lambda s: s <> '')"


def _normalized(column: str) -> str:
    wide = "regexp_full_match(s, '[0-9]{2}') AND coalesce(regexp_full_match(seg[i + 1], '[0-9]{2}'), false) AND (try_cast(s AS int) + 1) % 100 = try_cast(seg[i + 1] AS int)"
    return f"(SELECT array_to_string(list_transform(seg, lambda s, i: CASE WHEN {wide} THEN '20' || s ELSE s END), '-') FROM (SELECT {_segments(column)} AS seg))"


#: Tier 2 as SQL: the core drops every year pair. Numbers of the derived ledger have at most one, so one pass of a regular expression does.
def _core(column: str) -> str:
    return f"list_filter(string_split(regexp_replace('-' || array_to_string({_segments(column)}, '-') || '-', '-([0-9]{{2}}|20[0-9]{{2}})-[0-9]{{1,2}}-', '-'), '-'), lambda s: s <> '')"


def tiers(excluded_a: str | None = None, excluded_b: str | None = None) -> str:
    """All tiers up to ``final_a``, ``final_b`` and ``possible``."""
    no = "SELECT NULL::BIGINT AS row_index WHERE false"
    ea, eb = excluded_a or no, excluded_b or no
    number = "regexp_replace({0}.identifier, '^0+([0-9])', '\\1')"
    short = f"""SELECT {_PICK} FROM left_a x JOIN left_b y ON x.gstin = y.gstin AND regexp_full_match(x.identifier, '[0-9]+') AND regexp_full_match(y.identifier, '[0-9]+')
      AND {number.format("x")} = {number.format("y")} AND abs(x.taxable_value - y.taxable_value) <= {TOLERANCE} AND abs(date_diff('day', x.invoice_date, y.invoice_date)) <= {TIEBREAK_DAYS}"""
    agree = "(x.norm = y.norm OR (least(len(x.core), len(y.core)) > 0 AND x.core[1:least(len(x.core), len(y.core)) - 1] = y.core[1:least(len(x.core), len(y.core)) - 1]"
    agree += " AND (starts_with(x.core[least(len(x.core), len(y.core))], y.core[least(len(x.core), len(y.core))]) OR starts_with(y.core[least(len(x.core), len(y.core))], x.core[least(len(x.core), len(y.core))]))))"
    parts = [CANONICAL, runs("a"), runs("b"), bridge("a", "b"), bridge("b", "a"), left_over("a", "b", ea), left_over("b", "a", eb), unique_pairs("short", short)]
    for side, end in (("a", "l"), ("b", "r")):
        parts.append(f"\nshorter_{side} AS (SELECT *, {_normalized('identifier')} AS norm, {_core('identifier')} AS core FROM left_{side} WHERE row_index NOT IN (SELECT {end}_row_index FROM short))")
    parts.append(unique_pairs("normed", f"SELECT {_PICK} FROM shorter_a x JOIN shorter_b y ON x.gstin = y.gstin AND {taxes('x', 'y')} AND {agree}"))
    for side, end, excluded in (("a", "l", ea), ("b", "r", eb)):
        parts.append(
            f"\nopen_{side} AS (SELECT * EXCLUDE (norm, core) FROM shorter_{side} WHERE row_index NOT IN (SELECT {end}_row_index FROM normed)"
            f" UNION ALL BY NAME SELECT * FROM c{side} WHERE identifier = '' AND row_index NOT IN ({excluded}))"
        )
    month = "date_trunc('month', x.invoice_date) = date_trunc('month', y.invoice_date)"
    parts.append(unique_pairs("possible", f"SELECT {_PICK} FROM open_a x JOIN open_b y ON x.gstin = y.gstin AND {taxes('x', 'y')} AND {month}"))
    for side, end in (("a", "l"), ("b", "r")):
        parts.append(f"\nfinal_{side} AS (SELECT * FROM open_{side} WHERE identifier <> '' AND row_index NOT IN (SELECT {end}_row_index FROM possible))")
    return ",".join(parts)


def head(prefix: str = "") -> str:
    i, c, s = (f"abs({prefix}{h}) > {TOLERANCE}" for h in ("igst", "cgst", "sgst"))
    return f"CASE WHEN {i} AND ({c} OR {s}) THEN 'mixed' WHEN {i} THEN 'igst' WHEN {c} OR {s} THEN 'cgst_sgst' ELSE 'none' END"


def expected(gstin: str, place: str) -> str:
    codes = ", ".join(map(text, STATE_NAMES))
    names = {name.lower(): code for code, name in STATE_NAMES.items()} | STATE_ALIASES
    by_name = " ".join(f"WHEN {text(n)} THEN {text(c)}" for n, c in names.items())
    supplier = f"CASE WHEN substr({gstin}, 1, 2) IN ({codes}) THEN substr({gstin}, 1, 2) END"
    number = f"regexp_extract(trim({place}), '^([0-9]{{2}})\\s*[-–—]', 1)"
    bare = f"trim(regexp_replace(lower(trim({place})), '^[0-9]{{2}}\\s*[-–—]\\s*', ''))"
    supply = f"CASE WHEN {number} IN ({codes}) THEN {number} ELSE CASE {bare} {by_name} END END"
    return f"CASE WHEN ({supplier}) = ({supply}) THEN 'cgst_sgst' WHEN ({supplier}) <> ({supply}) THEN 'igst' END"


def category(column: str, rcm: bool, unregistered: str = "false") -> str:
    cases = []
    for entry in RCM_CATEGORIES if rcm else BLOCKED_CATEGORIES:
        name, words, only = (entry[0], entry[1], entry[2]) if rcm else (entry[0], entry[2], False)
        if words:
            hits = " OR ".join(f"contains(lower({column}), {text(w)})" for w in words)
            cases.append(f"WHEN ({hits}){f' AND ({unregistered})' if only else ''} THEN {text(name)}")
    return f"CASE {' '.join(cases)} END"


def keyword(column: str, found: str) -> str:
    cases = []
    for name, _, words in BLOCKED_CATEGORIES:
        if words:
            inner = " ".join(f"WHEN contains(lower({column}), {text(w)}) THEN {text(w)}" for w in words)
            cases.append(f"WHEN {found} = {text(name)} THEN CASE {inner} END")
    return f"CASE {' '.join(cases)} END"


def section(found: str) -> str:
    return f"CASE {found} {' '.join(f'WHEN {text(n)} THEN {text(s)}' for n, s, _ in BLOCKED_CATEGORIES)} END"


FLAG = "CASE WHEN lower(trim(reverse_charge)) IN ('y', 'yes', 'true', '1') THEN true WHEN lower(trim(reverse_charge)) IN ('n', 'no', 'false', '0') THEN false END"


def rcm(side: str, by_text: bool) -> str:
    found = category("particulars", True, "trim(coalesce(gstin, '')) = ''") if by_text else "NULL::VARCHAR"
    return f"""
SELECT row_index, CASE WHEN trim(coalesce(gstin, '')) <> '' THEN gstin END AS gstin, identifier,
  CASE WHEN flag THEN 'reverse_charge_flag' ELSE 'keyword_match' END AS found_by, category, coalesce(category = 'rent_unregistered_landlord', false) AS confirm, igst, cgst, sgst
FROM (SELECT *, CASE WHEN flag IS NULL THEN {found} END AS category FROM (SELECT *, {FLAG} AS flag FROM {side})) WHERE flag OR category IS NOT NULL"""


DUPLICATE_ROWS = """
rec AS (
  SELECT row_index, gstin, CASE WHEN regexp_full_match(identifier, '[0-9]+') THEN regexp_replace(identifier, '^0+([0-9])', '\\1') ELSE identifier END AS identifier,
    taxable_value AS amount, igst + cgst + sgst AS tax, CASE WHEN taxable_value > 0 THEN (igst + cgst + sgst)::DOUBLE / taxable_value::DOUBLE * 100 END AS rate, invoice_date AS d
  FROM books)"""
#: Only numbers that stand twice meet, so the join is one of equal keys with few rows each.
NUMBER_CTES = """
again AS MATERIALIZED (SELECT gstin || '|' || identifier AS k, * FROM rec WHERE identifier <> '' QUALIFY count(*) OVER (PARTITION BY gstin, identifier) > 1),
same_number AS MATERIALIZED (
  SELECT x.gstin, x.row_index AS i, y.row_index AS j, x.d AS xd, y.d AS yd, x.amount AS xa, y.amount AS ya, x.rate AS xr, y.rate AS yr FROM again x JOIN again y ON x.k = y.k)"""
NUMBER_PAIRS = f"""
SELECT gstin, i AS a, j AS b FROM same_number
WHERE i < j AND abs(date_diff('day', xd, yd)) <= {IDENTIFIER_DAYS} AND abs(xa - ya) <= {TOLERANCE} AND coalesce(abs(xr - yr) <= 0.5, true)"""
AMOUNT_CTES = f"""{DUPLICATE_ROWS},
one_run AS (
  SELECT gstin, regexp_replace(identifier, '[0-9]+', '#', 'g') AS shape, regexp_extract(identifier, '[0-9]+')::DOUBLE AS number, d
  FROM rec WHERE len(regexp_extract_all(identifier, '[0-9]+')) = 1),
numbers AS (SELECT gstin, shape, number, min(d) AS first, max(d) AS last FROM one_run GROUP BY ALL),
gaps AS (SELECT *, number - lag(number) OVER (PARTITION BY gstin, shape ORDER BY number) AS gap FROM numbers),
nth AS (SELECT *, row_number() OVER (PARTITION BY gstin, shape ORDER BY gap NULLS LAST) AS nth, count(*) OVER (PARTITION BY gstin, shape) AS n FROM gaps),
typical AS (
  SELECT gstin, shape, max(CASE WHEN nth = (n - 1) // 2 + 1 THEN gap END) AS median_gap,
    CASE WHEN date_diff('day', min(first), max(last)) > 0 THEN (max(number) - min(number)) / date_diff('day', min(first), max(last)) END AS per_day
  FROM nth WHERE n >= 4 GROUP BY gstin, shape),
close AS (
  SELECT x.gstin, x.row_index AS a, y.row_index AS b, x.identifier AS p, y.identifier AS q, abs(date_diff('day', x.d, y.d)) AS days
  FROM rec x JOIN rec y ON x.gstin = y.gstin AND x.row_index < y.row_index AND abs(x.amount - y.amount) <= {TOLERANCE}
  WHERE abs(date_diff('day', x.d, y.d)) <= {AMOUNT_DAYS} AND NOT (x.identifier = y.identifier AND x.identifier <> '')
    AND (SELECT count(*) FROM rec z WHERE z.gstin = x.gstin AND abs(z.amount - x.amount) <= {TOLERANCE}) = 2),
shaped AS (
  SELECT c.*, t.median_gap, t.per_day, regexp_replace(p, '[0-9]+', '#', 'g') = regexp_replace(q, '[0-9]+', '#', 'g') AS alike,
    list_filter(list_zip(regexp_extract_all(p, '[0-9]+'), regexp_extract_all(q, '[0-9]+')), lambda z: z[1] IS DISTINCT FROM z[2]) AS odd
  FROM close c LEFT JOIN typical t ON t.gstin = c.gstin AND t.shape = regexp_replace(p, '[0-9]+', '#', 'g')),
amount_pairs AS (
  SELECT gstin, a, b FROM shaped WHERE NOT (p <> '' AND q <> '' AND alike AND len(odd) = 1
    AND coalesce(abs(odd[1][1]::DOUBLE - odd[1][2]::DOUBLE) <= greatest(5.0, coalesce(median_gap * 3, 0), coalesce(per_day * days * 3, 0)), false)))"""

_NAMES = ("rec", "again", "same_number", "one_run", "numbers", "gaps", "nth", "typical", "close", "shaped", "amount_pairs")


def duplicates() -> str:
    """Clusters of both sheets, ``members`` and ``doubles``. In the derived ledger no pair shares a row with another, so a pair is a cluster."""
    parts = []
    for side in ("gstr2a", "books"):
        ctes = f"{AMOUNT_CTES},{NUMBER_CTES},pairs_of AS (SELECT *, true AS confirmed FROM ({NUMBER_PAIRS}) UNION ALL SELECT *, false FROM amount_pairs)"
        ctes = re.sub(r"\b(" + "|".join((*_NAMES, "pairs_of")) + r")\b", rf"\1_{side}", ctes.replace("FROM books", f"FROM {side}"))
        parts.append(ctes)
    clusters = " UNION ALL ".join(f"SELECT '{side}' AS source, * FROM pairs_of_{side}" for side in ("gstr2a", "books"))
    members = " UNION ALL ".join(
        f"SELECT c.source, c.gstin, c.a AS cluster, c.number, c.confirmed, r.row_index, r.identifier, r.amount, r.tax, r.d AS date FROM numbered c JOIN rec_{side} r ON r.row_index IN (c.a, c.b) WHERE c.source = '{side}'"
        for side in ("gstr2a", "books")
    )
    parts.append(f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, confirmed ORDER BY a) AS number FROM ({clusters})),
members AS ({members}),
doubles AS (
  SELECT source, number, gstin, cluster, CASE WHEN confirmed THEN 'same_number_and_amount' ELSE 'same_amount' END AS reason, confirmed, count(*) AS members,
    date_diff('day', min(date), max(date))::INT AS spread_days, (sum(tax) - max(tax))::BIGINT AS overclaim FROM members GROUP BY ALL)""")
    return ",".join(parts)
