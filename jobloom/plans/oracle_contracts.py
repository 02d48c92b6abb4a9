"""DuckDB SQL of clearance, tax, rates and what follows from them, written apart from the Spark expressions.

The tax year's figures are written out here as numbers, and inverses are found by
halving, so neither ``config`` nor the piecewise formulas of the engine decide
what the SQL gives.
"""

from __future__ import annotations

from jobloom import config
from jobloom.functions import rates
from jobloom.plans import fixtures
from jobloom.plans.oracles import VIEWS, _lit, _names, _rx, _some


#: Added before figures are rounded: sums of money are exact halves at times, and the last bit would decide.
HAIR = 1e-7


def _i(pattern: str) -> str:
    return _lit("(?i)" + pattern)


def _parts(text: str, name: str, pattern: str) -> str:
    """Columns m<name>, g<name>: the matches and the pieces between them."""
    return f"regexp_extract_all({text}, {_i(pattern)}) AS m{name}, string_split_regex({text}, {_i(pattern)}) AS g{name}"


def _occurrences(name: str, body: str) -> str:
    """A list over the matches; ``body`` is an expression of x: {{s (start from 0), m}}."""
    length = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda y: length(y))), 0)"
    each = f"list_transform(range(1, len(m{name}) + 1), lambda i: {{'s': ({length(f'g{name}[1:i]')} + {length(f'm{name}[1:i - 1]')})::INT, 'm': m{name}[i]}})"
    return f"list_transform({each}, lambda x: {body})"


# Clearance -----------------------------------------------------------------------------------

_LEAD = "regexp_extract(substring(flat, greatest(x.s - 110, 0) + 1, least(x.s, 110)), '[^.;]*$')"
_TAIL = "regexp_extract(substring(flat, x.s + length(x.m) + 1, 70), '^[^.;]*')"
_SOFT = _rx(f"({_LEAD} || ' ' || {_TAIL})", "(?:" + "|".join(config.CLEARANCE_DOWNGRADE.values()) + ")")
_BLOCKED = list(config.CLEARANCE_BLOCKED.items())
_FOUND = "list_concat(" * (len(_BLOCKED) - 1) + _occurrences("c0", f"{{'n': '{_BLOCKED[0][0]}', 'm': trim(x.m), 'soft': {_SOFT}}}") + "".join(", " + _occurrences(f"c{k}", f"{{'n': '{n}', 'm': trim(x.m), 'soft': {_SOFT}}}") + ")" for k, (n, _) in enumerate(_BLOCKED) if k)
_DOWN = f"array_to_string(({_names('flat', config.CLEARANCE_DOWNGRADE)})[1:3], ', ')"
_CLEARANCE = f"""
flat_ AS (SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS flat, regexp_replace(t, '\\s+', ' ', 'g') AS line FROM screened),
c1 AS (SELECT *, {_some('flat', config.CLEARANCE_MENTION)} AS mentioned FROM flat_),
c2 AS (SELECT url, flat, {_DOWN} AS down, {", ".join(_parts('flat', f'c{k}', p) for k, (_, p) in enumerate(_BLOCKED))} FROM c1 WHERE mentioned),
c3 AS (SELECT url, down, {_FOUND} AS found FROM c2),
c4 AS (SELECT url, down, list_filter(found, lambda f: NOT f.soft)[1] AS hard, list_filter(found, lambda f: f.soft)[1] AS soft FROM c3),
cleared AS (SELECT url, CASE WHEN hard IS NOT NULL THEN 'blocked' ELSE 'possible' END AS clearance_status,
    CASE WHEN hard IS NOT NULL THEN hard.n || ': “' || substring(hard.m, 1, 70) || '”'
         WHEN soft IS NOT NULL THEN soft.n || ' (' || down || '): “' || substring(soft.m, 1, 60) || '”'
         ELSE 'clearance mentioned, nothing required of you' || CASE WHEN down <> '' THEN ' (' || down || ')' ELSE '' END END AS clearance_evidence FROM c4),
clear_ AS (SELECT url, coalesce(clearance_status, 'none') AS clearance_status, clearance_evidence FROM c1 LEFT JOIN cleared USING (url))"""

# Tax year 2026/27 ------------------------------------------------------------------------------


def _allowance(x: str) -> str:
    return f"greatest(0.0, 12570.0 - greatest(0.0, {x} - 100000.0) / 2.0)"


def _income_tax(x: str) -> str:
    due = f"greatest(0.0, {x} - {_allowance(x)})"
    return f"(least({due}, 37700.0) * 0.20 + least(greatest(0.0, {due} - 37700.0), 112570.0) * 0.40 + greatest(0.0, {due} - 150270.0) * 0.45)"


def _employee(x: str) -> str:
    return f"(greatest(0.0, least({x}, 50270.0) - 12570.0) * 0.08 + greatest(0.0, {x} - 50270.0) * 0.02)"


def _employer(x: str) -> str:
    return f"(greatest(0.0, {x} - 5000.0) * 0.15)"


def _net(x: str) -> str:
    return f"({x} - {_income_tax(x)} - {_employee(x)})"


def _assignment(x: str) -> str:
    """What an umbrella company must be paid for a salary: employer's insurance, margin, levy, pension."""
    return f"({x} + {_employer(x)} + 1200.0 + greatest(0.0, {x} - 15000.0) * 0.005 + greatest(0.0, least({x}, 50270.0) - 6240.0) * 0.03)"


def _company(source: str, value: str, out: str) -> str:
    """CTEs from the rows of ``source``: a year's contract ``value`` through one's own company, step by step; the last is ``out``."""
    return f"""
{out}1 AS (SELECT *, least(12570.0, greatest(0.0, {value})) AS pay FROM {source}),
{out}2 AS (SELECT *, {value} - pay - {_employer('pay')} - 1200.0 AS profit FROM {out}1),
{out}3 AS (SELECT *, greatest(0.0, profit) AS p FROM {out}2),
{out}4 AS (SELECT *, CASE WHEN p <= 50000 THEN p * 0.19 WHEN p >= 250000 THEN p * 0.25 ELSE greatest(p * 0.25 - (250000 - p) * 0.015, p * 0.19) END AS ct FROM {out}3),
{out}5 AS (SELECT *, greatest(0.0, profit - ct) AS dividends, greatest(0.0, 12570.0 - greatest(0.0, pay + greatest(0.0, profit - ct) - 100000.0) / 2.0) AS own FROM {out}4),
{out}6 AS (SELECT *, greatest(0.0, pay - own) AS st, greatest(0.0, pay + dividends - own) - greatest(0.0, pay - own) AS d FROM {out}5),
{out}7 AS (SELECT *, least(d, greatest(0.0, 37700.0 - st)) AS d1, 112570.0 - least(greatest(0.0, st - 37700.0), 112570.0) AS room2, least(500.0, d) AS free FROM {out}6),
{out}8 AS (SELECT *, least(d - d1, room2) AS d2, least(d1, free) AS z1 FROM {out}7),
{out}9 AS (SELECT *, d - d1 - d2 AS d3, least(d2, free - z1) AS z2 FROM {out}8),
{out} AS (SELECT *, (d1 - z1) * 0.1075 + (d2 - z2) * 0.3575 + (d3 - least(d3, free - z1 - z2)) * 0.3935 AS dt FROM {out}9)"""


_COMPANY_NET = f"(pay - {_income_tax('pay')} - {_employee('pay')} + dividends - dt)"


def _halving(name: str, source: str, y: str, f, top: str) -> str:
    """A recursive CTE that finds x with f(x) = y for each value of ``y``; f rises."""
    return f"""
{name}0(y, lo, hi, n) AS (SELECT DISTINCT {y}, 0.0::DOUBLE, ({top})::DOUBLE, 0 FROM {source}
  UNION ALL SELECT y, CASE WHEN {f('((lo + hi) / 2)')} < y THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {f('((lo + hi) / 2)')} < y THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM {name}0 WHERE n < 80),
{name} AS (SELECT y, CASE WHEN y <= {f('0.0')} THEN 0.0 ELSE (lo + hi) / 2 END AS x FROM {name}0 WHERE n = 80)"""


#: A grid of contract values whose net pay brackets the wanted one; between two grid points (a pound apart) the net is linear.
_GRID = ", grid0 AS (SELECT range::DOUBLE AS v FROM range(60000, 110000)), " + _company("grid0", "v", "grid") + f""",
grid_net AS (SELECT v, {_COMPANY_NET} AS net FROM grid),
outside_year AS (SELECT max(v) + ({_net('60000.0')} - max(net)) / (SELECT min(net) - (SELECT max(net) FROM grid_net WHERE net <= {_net('60000.0')}) FROM grid_net WHERE net > {_net('60000.0')}) AS v FROM grid_net WHERE net <= {_net('60000.0')})"""
_INSIDE_RATE, _OUTSIDE_RATE = f"({_assignment('60000.0')} / 220.0)", "((SELECT v FROM outside_year) / 220.0)"

# Reading of rates ------------------------------------------------------------------------------

_UNIT = rates.DAY_UNIT.replace(r"p/?d(?![\w/])", r"p/?d(?:[^\w/]|$)")
_UNIT_BEFORE = rates.DAY_UNIT.replace(r"p/?d(?![\w/])", r"p/?d[\s:£]")
_SHAPES = {"r": (rates.RANGE.replace(rates.DAY_UNIT, _UNIT), 1, 2), "o": (rates.SINGLE.replace(rates.DAY_UNIT, _UNIT), 1, 1), "b": (rates.PREFIX.replace(rates.DAY_UNIT, _UNIT_BEFORE), 1, 1)}


def _money(pattern: str, group: int) -> str:
    return f"try_cast(replace(regexp_extract(x.m, {_i(pattern)}, {group}), ',', '') AS DOUBLE)"


def _figures(name: str) -> str:
    p, a, b = _SHAPES[name]
    expense = _rx("substring(line, greatest(x.s - 45, 0) + 1, least(x.s, 45))", rates.EXPENSE)
    return _occurrences(name, f"{{'lo': least({_money(p, a)}, {_money(p, b)}), 'hi': greatest({_money(p, a)}, {_money(p, b)}), 'bad': {expense}}}")


_RANK = {"outside": "inside", "inside": "outside"}


def _phrase(k: int, status: str, confidence: int) -> str:
    denied = _rx("substring(line, greatest(x.s - 30, 0) + 1, least(x.s, 30))", rates.NEGATION)
    return _occurrences(f"p{k}", f"{{'c': {confidence}, 's': CASE WHEN {denied} THEN '{_RANK[status]}' ELSE '{status}' END, 'e': trim(x.m)}}")


def _joined(lists: list[str]) -> str:
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


_RATES = f"""
i1 AS (SELECT url, line, {", ".join(_parts('line', f'p{k}', p) for k, (p, _, _) in enumerate(rates.IR35_PHRASES))} FROM flat_ WHERE {_rx('line', rates._SOME_IR35)}),
i2 AS (SELECT url, {_joined([_phrase(k, s, c) for k, (_, s, c) in enumerate(rates.IR35_PHRASES)])} AS ph FROM i1),
i3 AS (SELECT url, ph, list_max(list_transform(ph, lambda z: z.c)) AS tier FROM i2),
i4 AS (SELECT url, list_filter(ph, lambda z: z.c = tier AND z.s = 'inside')[1].e AS ins, list_filter(ph, lambda z: z.c = tier AND z.s = 'outside')[1].e AS outs FROM i3),
ir AS (SELECT url, CASE WHEN ins IS NOT NULL AND outs IS NULL THEN 'inside' WHEN outs IS NOT NULL AND ins IS NULL THEN 'outside' ELSE 'unknown' END AS ir35_status,
    CASE WHEN ins IS NOT NULL AND outs IS NOT NULL THEN 'inside: ' || ins || ' / outside: ' || outs ELSE coalesce(ins, outs) END AS ir35_evidence FROM i4),
r1 AS (SELECT url, line, {", ".join(_parts('line', n, p) for n, (p, _, _) in _SHAPES.items())} FROM flat_ WHERE {_rx('line', _UNIT)}),
r2 AS (SELECT url, list_filter({_joined([_figures(n) for n in _SHAPES])}, lambda f: NOT f.bad AND f.lo BETWEEN 150 AND 2500 AND f.hi BETWEEN 150 AND 2500) AS f FROM r1),
r3 AS (SELECT url, list_min(list_transform(f, lambda z: z.lo)) AS lo, list_max(list_transform(f, lambda z: z.hi)) AS hi FROM r2 WHERE len(f) > 0),
m0 AS (SELECT s.*, coalesce(ir35_status, 'unknown') AS ir, ir35_evidence, lo, hi, coalesce(day_rate_max, day_rate_min) AS top FROM screened s LEFT JOIN ir USING (url) LEFT JOIN r3 USING (url)),
m1 AS (SELECT * EXCLUDE (employment_type, day_rate_min, day_rate_max, day_rate_source), coalesce(nullif(employment_type, ''), 'unknown') AS employment_type,
    CASE WHEN hi IS NOT NULL THEN lo WHEN top BETWEEN 150 AND 2500 AND day_rate_min BETWEEN 150 AND 2500 THEN day_rate_min END AS day_rate_min,
    CASE WHEN hi IS NOT NULL THEN hi WHEN top BETWEEN 150 AND 2500 THEN top END AS day_rate_max,
    CASE WHEN hi IS NOT NULL THEN 'stated' WHEN top BETWEEN 150 AND 2500 THEN day_rate_source END AS day_rate_source FROM m0),
m2 AS (SELECT *, coalesce(day_rate_max, day_rate_min) AS best, CASE WHEN ir = 'outside' THEN 'outside' ELSE 'inside' END AS assumed, {_INSIDE_RATE} AS inside_rate, {_OUTSIDE_RATE} AS outside_rate FROM m1),
m3 AS (SELECT *, CASE WHEN assumed = 'inside' THEN inside_rate ELSE outside_rate END AS need FROM m2),
m4 AS (SELECT *, CASE WHEN best IS NULL THEN 'unknown' WHEN best >= need THEN 'pass' WHEN ir = 'unknown' AND best >= outside_rate THEN 'review' ELSE 'fail' END AS rate_verdict FROM m3),
years AS (SELECT DISTINCT best * 220.0 AS year FROM m4 WHERE best IS NOT NULL),
{_halving('inverse_in', 'years', 'year', _assignment, 'year')},
{_company('years', 'year', 'firm')},
firm_net AS (SELECT year, {_COMPANY_NET} AS net FROM firm),
{_halving('inverse_net', 'firm_net', 'net', _net, 'net * 4 + 1000')},
worth AS (SELECT year, a.x AS in_worth, b.x AS out_worth FROM firm_net JOIN inverse_in a ON a.y = year JOIN inverse_net b ON b.y = net),
contracts AS (SELECT m4.*, CASE WHEN best IS NOT NULL THEN need END AS rate_required, CASE WHEN best IS NOT NULL THEN CASE WHEN assumed = 'inside' THEN in_worth ELSE out_worth END END AS perm_equivalent,
    CASE rate_verdict WHEN 'unknown' THEN 'No day rate stated in the posting.'
      WHEN 'pass' THEN format('£{{:,.0f}}/day clears the £{{:,.0f}}/day needed for ', best, need) || assumed || ' IR35.'
      WHEN 'review' THEN format('£{{:,.0f}}/day needs the role to be OUTSIDE IR35 (£{{:,.0f}}/day); inside it would need £{{:,.0f}}/day. IR35 status is not stated — confirm before applying.', best, outside_rate, inside_rate)
      ELSE format('£{{:,.0f}}/day is below the £{{:,.0f}}/day needed for ', best, need) || assumed || ' IR35.' END AS rate_reason
    FROM m4 LEFT JOIN worth ON year = best * 220.0)"""

_REJECT = """
e1 AS (SELECT *, CASE WHEN clearance_status = 'blocked' THEN 'requires clearance you do not hold — ' || coalesce(clearance_evidence, 'clearance required') END AS no_clearance,
    CASE WHEN employment_type = 'contract' AND rate_verdict = 'fail' AND day_rate_source IN ('stated', 'derived_from_advertised_salary')
         THEN format('contract day rate £{:,.0f}/day is below the £{:,.0f}/day needed', coalesce(day_rate_max, day_rate_min), coalesce(rate_required, 0.0)) END AS no_rate FROM contracts JOIN clear_ USING (url)),
enriched AS (SELECT *, title_ok AND place_ok AND NOT mismatch AND no_clearance IS NULL AS content, title_ok AND place_ok AND NOT mismatch AND no_clearance IS NULL AND no_rate IS NULL AS passes FROM e1)"""

RECURSIVE = VIEWS.replace("WITH postings", "WITH RECURSIVE postings", 1)
ENRICHED = RECURSIVE + ", " + _CLEARANCE + _GRID + ", " + _RATES + ", " + _REJECT
_AGED = f""", p AS (SELECT s.*, posted_at AS r, TIMESTAMP '{fixtures.NOW}' AS now FROM screened s),
  t0 AS (SELECT *, CASE WHEN regexp_matches(r, '^\\d{{10,13}}$') THEN make_timestamp(CASE WHEN r::BIGINT > 100000000000 THEN r::BIGINT * 1000 ELSE r::BIGINT * 1000000 END)
         WHEN r = 'yesterday' THEN now - INTERVAL 1 DAY WHEN r LIKE '% days ago' THEN now - to_days(split_part(r, ' ', 1)::INT) WHEN r LIKE '% weeks ago' THEN now - to_days(7 * split_part(r, ' ', 1)::INT)
         ELSE try_cast(replace(r, 'Z', '') AS TIMESTAMP) END AS posted_ts, CASE WHEN ordinal % 13 = 0 THEN DATE '2026-09-01' WHEN ordinal % 13 = 1 THEN DATE '2026-05-01' END AS listed FROM p),
  aged AS (SELECT *, date_diff('day', posted_ts::DATE, now::DATE)::INT AS age FROM t0)"""

#: Conditions over ``enriched``.
SQL = {
    "clearance": RECURSIVE + ", " + _CLEARANCE + " SELECT url, clearance_status, clearance_evidence FROM clear_",
    "tax_model": "WITH RECURSIVE o AS (SELECT o_orderkey, o_totalprice AS v FROM orders), " + _company("o", "v", "f") + ", years AS (SELECT DISTINCT v AS year FROM o), " + _halving("inverse_in", "years", "year", _assignment, "year") + f"""
        SELECT o_orderkey, {", ".join(f"round({x} + {HAIR}, 4) AS {k}" for k, x in {"income_tax": _income_tax("v"), "employee_nic": _employee("v"), "employer_nic": _employer("v"), "net_salary": _net("v"), "inside_salary": "x", "outside_net": _COMPANY_NET, "dividend_tax": "dt", "corporation_tax": "ct"}.items())} FROM f JOIN inverse_in ON y = v""",
    "rate_thresholds": "WITH w AS (SELECT 1)" + _GRID + f", d AS (SELECT c_custkey, (c_custkey % 261)::INT AS days FROM customer) SELECT c_custkey, days, 60000.0::DOUBLE AS salary, CASE WHEN days > 0 THEN round({_assignment('60000.0')} / days, 4) END AS inside_rate, CASE WHEN days > 0 THEN round((SELECT v FROM outside_year) / days, 4) END AS outside_rate FROM d",
    "contract_rates": ENRICHED + " SELECT url, ir AS ir35_status, ir35_evidence, day_rate_min, day_rate_max, day_rate_source, rate_verdict, round(rate_required, 4) AS rate_required, round(perm_equivalent + " + f"{HAIR}" + ", 4) AS perm_equivalent, rate_reason FROM enriched",
    "rejections": ENRICHED + """ SELECT url, passes, CASE WHEN NOT title_ok THEN 'title not in the QA/testing allowlist' WHEN NOT place_ok THEN 'location not in the London/UK allowlist'
        WHEN mismatch THEN 'language mismatch — names ' || coalesce(language_hits, 'None') || ' only' ELSE coalesce(no_clearance, no_rate) END AS reason,
        array_to_string(list_filter([CASE WHEN NOT title_ok THEN 'title' END, CASE WHEN NOT place_ok THEN 'location' END, CASE WHEN mismatch THEN 'language' END, CASE WHEN no_clearance IS NOT NULL THEN 'clearance' END, CASE WHEN no_rate IS NOT NULL THEN 'rate' END], lambda z: z IS NOT NULL), '+') AS failing FROM enriched""",
    "rejected_rows": VIEWS + " SELECT url, array_to_string(list_filter([CASE WHEN NOT title_ok THEN 'title' END, CASE WHEN NOT place_ok THEN 'location' END, CASE WHEN mismatch THEN 'stack' END], lambda z: z IS NOT NULL), '+') AS reasons FROM screened WHERE NOT title_ok OR NOT place_ok OR mismatch",
    "run_totals": ENRICHED + " SELECT count(*) AS fetched, count(*) FILTER (passes) AS candidates, count(*) FILTER (passes AND employment_type = 'contract') AS contracts, count(*) FILTER (title_ok AND place_ok AND NOT mismatch AND no_clearance IS NOT NULL AND no_rate IS NULL) AS clearance_only, count(*) FILTER (content AND no_rate IS NOT NULL) AS rate_only FROM enriched",
    "tallies": ENRICHED + """ SELECT measure, value, count(*) AS n FROM (SELECT unnest([{'measure': 'rate_verdict', 'value': rate_verdict}, {'measure': 'language_tier', 'value': language_tier}, {'measure': 'clearance_status', 'value': clearance_status},
        {'measure': 'contract', 'value': (employment_type = 'contract')::VARCHAR}, {'measure': 'with_rate', 'value': (best IS NOT NULL)::VARCHAR}], recursive := true) FROM enriched) GROUP BY ALL""",
    "refilter": ENRICHED + " SELECT url, passes AS passed_filters, CASE WHEN passes THEN 'rescued' ELSE 'demoted' END AS change FROM enriched WHERE passes <> (ordinal % 2 = 0)",
    "backfill": ENRICHED + " SELECT url, passed AND passes AS passed_filters, rate_verdict, language_tier, clearance_status FROM enriched",
    "refresh_contract": ENRICHED + """, n AS (SELECT *, ordinal % 2 = 0 AND ordinal % 3 <> 0 AND day_rate_max IS NOT NULL AS changed FROM enriched)
        SELECT url, employment_type, CASE WHEN changed THEN day_rate_max + ordinal % 3 ELSE day_rate_max END AS day_rate_max, changed FROM n""",
    "board_windowed": VIEWS + _AGED + """ SELECT url, posted_ts, age, CASE WHEN age IS NULL THEN 'no date' WHEN age <= 0 THEN 'today' WHEN age = 1 THEN 'yesterday' WHEN age < 7 THEN age || ' days ago' WHEN age < 14 THEN '1 week ago'
          WHEN age < 45 THEN round(age / 7.0)::INT || ' weeks ago' WHEN age < 365 THEN round(age / 30.0)::INT || ' months ago' ELSE round(age / 365.0)::INT || 'y ago' END AS label,
        CASE WHEN age IS NULL THEN 'undated' WHEN age <= 7 THEN 'fresh' WHEN age <= 30 THEN 'recent' WHEN age <= 45 THEN 'ageing' ELSE 'old' END AS age_class
        FROM aged WHERE age IS NULL OR age <= 90 OR coalesce(date_diff('day', listed, now::DATE) <= 90, false)""",
}
