"""The same queries as plain SQL on the raw tables, to check results independently."""

from __future__ import annotations

# Keys and columns are written out here and not taken from the operators under test.
DETAIL_KEYS = {
    "total": "",
    "area": "area",
    "group": "area, grp",
    "subgroup": "area, grp, subgrp",
    "group_category": "area, grp, category_path",
    "area_category": "area, category_path",
    "specialist": "area, grp, specialist",
    "specialist_category": "area, grp, specialist, category_path",
    "service_category": "area, service, category_path",
}
WITH_EFFECTIVENESS = ("total", "area", "group", "subgroup")
ONLY_MISSED = ("group_category", "area_category", "service_category")
CASES = """
lines AS (
  SELECT
    l_orderkey * 10 + l_linenumber AS case_id,
    r_name AS area,
    CASE WHEN n.n_nationkey = 7 THEN '' ELSE n.n_name END AS grp,
    c_mktsegment AS subgrp,
    s_name AS specialist,
    p_brand AS service,
    CASE WHEN l_linestatus = 'O' THEN 'END_USER' ELSE 'INTERNAL' END AS service_type,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'INCIDENT' ELSE 'REQUEST' END
      AS case_type,
    CASE WHEN o_orderstatus = 'O' THEN 'OPEN'
         WHEN o_orderstatus = 'P' THEN 'PENDING'
         WHEN l_returnflag = 'A' THEN 'CLOSED'
         WHEN l_returnflag = 'N' THEN 'SOLVED'
         ELSE 'DENIED' END AS state,
    CASE WHEN p_size % 10 = 0 THEN p_type
         WHEN p_size > 40 THEN p_type || '.' || replace(p_name, ' ', '.') || '.' || p_brand || '.extra'
         WHEN p_size > 20 THEN p_type || '.' || replace(p_name, ' ', '.') || '.' || p_brand
         ELSE p_type || '.' || replace(p_name, ' ', '.') END AS category_path,
    p_type AS category,
    CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS ci,
    cn.n_name AS site,
    CASE WHEN o_orderstatus = 'F' AND (l_returnflag = 'A'
              OR (l_returnflag = 'N' AND round(l_discount * 100) < 2))
         THEN 'INCLUDED' ELSE 'EXCLUDED' END AS inclusion,
    CAST(l_quantity * 60 AS INTEGER) AS elapsed_minutes,
    p_size * 60 AS sla_minutes,
    CASE WHEN l_quantity <= p_size THEN 1 ELSE 0 END AS met_sla,
    o_orderdate + to_hours((l_linenumber * 3) % 24) + to_minutes(l_partkey % 60)
      AS registered_at,
    CASE WHEN round(l_discount * 100) < 5 THEN 1 ELSE 0 END AS due_in_month,
    CASE WHEN round(l_discount * 100) = 10 THEN 1 ELSE 0 END AS overdue_prev_months,
    CASE WHEN round(l_tax * 100) = 6 THEN 1 ELSE 0 END AS closed_early_prev,
    CASE WHEN round(l_tax * 100) = 7 THEN 1 ELSE 0 END AS closed_early_next,
    CASE WHEN round(l_tax * 100) = 8 THEN 1 ELSE 0 END AS solved_early_next,
    l_linenumber, l_returnflag, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation n ON s_nationkey = n.n_nationkey
  JOIN region ON n.n_regionkey = r_regionkey
),
cases AS (
  SELECT *,
    registered_at + to_minutes(sla_minutes) AS due_at,
    CASE WHEN state IN ('CLOSED', 'SOLVED')
         THEN registered_at + to_minutes(elapsed_minutes) END AS solved_at,
    CAST(elapsed_minutes * 100 // sla_minutes AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR)
      AS progress_text,
    CASE WHEN state = 'CLOSED' THEN 1 ELSE 0 END AS closed_in_period,
    CASE WHEN state = 'CLOSED' THEN met_sla ELSE 0 END AS closed_met_sla,
    CASE WHEN state = 'SOLVED' THEN 1 ELSE 0 END AS solved_pending_close,
    CASE WHEN state = 'SOLVED' THEN met_sla ELSE 0 END AS solved_pending_close_met_sla,
    CASE WHEN state IN ('OPEN', 'PENDING') THEN 1 ELSE 0 END AS still_pending,
    CASE WHEN state IN ('OPEN', 'PENDING') THEN met_sla ELSE 0 END AS still_pending_met_sla,
    1 - met_sla AS missed
  FROM lines
)"""

CAPACITY = """
capacity AS (
  SELECT r_name AS area, CAST(d AS INTEGER) AS day,
         CAST((r_regionkey + 1) * 100 * (32 - d) AS DOUBLE) AS p0
  FROM region, unnest(generate_series(1, 31)) AS days(d)
)"""

PENDING = """
pending AS (
  SELECT area, specialist, case_id, category, service FROM lines WHERE l_returnflag = 'R'
)"""

OUTLOOK = """
backlog AS (
  SELECT area, count(*) AS total, sum(due_in_month + overdue_prev_months)::BIGINT AS due
  FROM cases WHERE solved_at IS NULL GROUP BY area
),
done AS (
  SELECT area, count(*) AS solved FROM cases WHERE solved_at IS NOT NULL GROUP BY area
),
outlook_area AS (
  SELECT b.area, b.total, b.due, c.p0,
    CASE WHEN b.due = 0 THEN 100.0::DOUBLE
         ELSE least(100.0::DOUBLE, 100 * (c.p0 / b.due)) END AS probability,
    c.p0 - b.due AS spare, f.p0 AS cap_total, d.solved,
    (CAST(d.solved AS DOUBLE) / f.p0) * 100 AS quota_pct
  FROM backlog b
  JOIN capacity c ON c.area = b.area AND c.day = 15
  JOIN capacity f ON f.area = b.area AND f.day = 1
  JOIN done d ON d.area = b.area
),
outlook AS (
  SELECT * FROM outlook_area
  UNION ALL
  SELECT 'TOTAL', sum(total)::BIGINT, sum(due)::BIGINT, sum(p0), avg(probability), sum(spare),
         sum(cap_total), sum(solved)::BIGINT, avg(quota_pct)
  FROM outlook_area
)"""

SOLVED_BAND = """CASE WHEN quota_pct + 5 > 100 THEN 'red'
  WHEN quota_pct > 95 AND quota_pct < 105 THEN 'orange'
  WHEN quota_pct < 95 THEN 'green' ELSE 'none' END"""
CLOSE_BAND = """CASE WHEN due > p0 THEN 'red' WHEN due > p0 - p0 * 0.1::DOUBLE THEN 'orange'
  WHEN due < p0 - p0 * 0.1::DOUBLE THEN 'green' ELSE 'none' END"""
SPEED_BAND = """CASE WHEN ivs < 0.4::DOUBLE OR ivs > 1 THEN 'red'
  WHEN ivs > 0.4::DOUBLE AND ivs <= 0.5::DOUBLE THEN 'orange'
  WHEN ivs > 0.5::DOUBLE AND ivs < 1 THEN 'green' ELSE 'none' END"""
MISSED_BAND = """CASE WHEN missed >= missed_limit THEN 'red'
  WHEN missed < missed_limit THEN 'green' ELSE 'none' END"""


def _target_band(value: str, target: float, tolerance: float) -> str:
    t, d = f"{target}::DOUBLE", f"{tolerance}::DOUBLE"
    return f"""CASE WHEN {value} < {t} - {d} THEN 'red'
  WHEN {value} > {t} - {d} AND {value} <= {t} THEN 'orange'
  WHEN {value} > {t} THEN 'green' ELSE 'none' END"""


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif({b}, 0)"


UNIT = "CASE WHEN grouping(area) = 1 THEN 'TOTAL' ELSE area END AS area"
BY_UNIT = "GROUP BY GROUPING SETS ((area), ())"
IES = _ratio(
    "sum(closed_in_period) + sum(solved_pending_close)",
    "sum(closed_early_next) + sum(due_in_month) + sum(solved_early_next)"
    " + sum(overdue_prev_months) - sum(closed_early_prev)",
)
IN_MET = "sum(CASE WHEN inclusion = 'INCLUDED' THEN met_sla END)"
IN_CLOSED = "sum(CASE WHEN inclusion = 'INCLUDED' THEN closed_in_period END)"
MISSED_PCT = "CAST(round_even((CAST(sum(missed) AS DOUBLE) / count(*)) * 100, 2) AS DOUBLE)"
MISSED_LIMIT = "CAST(round_even(count(*) * 0.05::DOUBLE, 0) AS BIGINT)"

SCORED = f"""
scored AS (
  SELECT {UNIT},
    {_ratio(IN_MET, IN_CLOSED)} AS ics,
    {_ratio("sum(elapsed_minutes)", "sum(sla_minutes)")} AS ivs,
    {IES} AS ies,
    sum(missed)::BIGINT AS missed, {MISSED_PCT} AS missed_pct, {MISSED_LIMIT} AS missed_limit
  FROM cases {BY_UNIT}
),
card AS (
  SELECT s.*, o.due, o.p0, o.solved, o.quota_pct,
    {_target_band("ics", 0.61, 0.01)} AS ics_band, {SPEED_BAND} AS ivs_band,
    {_target_band("ies", 0.395, 0.008)} AS ies_band, {CLOSE_BAND} AS to_close_band,
    {SOLVED_BAND} AS solved_band, {MISSED_BAND} AS missed_band
  FROM scored s LEFT JOIN outlook o ON o.area = s.area
)"""

GRID = """
hours AS (
  SELECT t FROM (
    SELECT unnest(generate_series(date_trunc('month', as_of)::TIMESTAMP,
                                  (as_of + INTERVAL 1 DAY)::TIMESTAMP, INTERVAL 1 HOUR)) AS t
    FROM day_of)
),
grid AS (
  SELECT t FROM hours
  WHERE isodow(t) < 6 AND t::DATE NOT IN (DATE '1998-06-01', DATE '1998-06-08')
)"""
FIXED_DAY = "day_of AS (SELECT DATE '1998-06-15' AS as_of)"
LATEST_DAY = """
day_of AS (
  SELECT max(registered_at::DATE) AS as_of FROM cases
  WHERE registered_at::DATE <= DATE '1998-06-15'
)"""

TREND = """
scoped AS (SELECT * FROM cases WHERE due_at < (SELECT max(t) FROM grid)),
a AS (SELECT t, count(*) AS n FROM grid JOIN scoped ON registered_at < t GROUP BY t),
b AS (SELECT t, count(*) AS n FROM grid JOIN scoped ON solved_at < t GROUP BY t),
d AS (SELECT t, count(*) AS n FROM grid JOIN scoped ON due_at < t GROUP BY t),
counts AS (
  SELECT grid.t, coalesce(a.n, 0) AS registered, coalesce(b.n, 0) AS solved,
         coalesce(d.n, 0) AS due
  FROM grid LEFT JOIN a USING (t) LEFT JOIN b USING (t) LEFT JOIN d USING (t)
),
trend AS (
  SELECT t, registered, solved, due, registered - solved AS "open",
    round(CASE WHEN due = 0 AND solved = 0 THEN 0.0::DOUBLE
          ELSE (CAST(due AS DOUBLE) / nullif(solved, 0) - 1) * 100 END, 6) AS lag_pct,
    round(CASE WHEN registered = 0 AND solved = 0 THEN 0.0::DOUBLE
          ELSE CAST(solved AS DOUBLE) / nullif(registered, 0) * 100 END, 6) AS managed_pct
  FROM counts
)"""

RUNNING = """
counted AS (
  SELECT *, solved_at::DATE AS solved_on FROM cases
  WHERE inclusion = 'INCLUDED' AND solved_at IS NOT NULL
),
daily AS (
  SELECT area, solved_on, sum(missed) AS missed, sum(met_sla) AS met,
         sum(closed_in_period) AS closed
  FROM counted GROUP BY area, solved_on
  UNION ALL
  SELECT 'TOTAL', solved_on, sum(missed), sum(met_sla), sum(closed_in_period)
  FROM counted GROUP BY solved_on
),
firsts AS (SELECT area, min(solved_on) AS first_on FROM daily GROUP BY area),
days AS (SELECT DISTINCT solved_on FROM daily),
spread AS (
  SELECT f.area, g.solved_on FROM firsts f JOIN days g ON g.solved_on >= f.first_on
),
running AS (
  SELECT s.area, s.solved_on, sum(d.missed)::BIGINT AS missed,
    round(CAST(sum(d.met) AS DOUBLE) / nullif(sum(d.closed), 0) * 100, 6) AS ics_pct
  FROM spread s JOIN daily d ON d.area = s.area AND d.solved_on <= s.solved_on
  GROUP BY s.area, s.solved_on
)"""

LIST = """
  case_id, area, grp, subgrp, specialist, service, service_type, case_type, state,
  category_path, category, ci, site, inclusion, elapsed_minutes, sla_minutes, met_sla,
  registered_at, due_at, solved_at, progress_text, closed_in_period, closed_met_sla,
  solved_pending_close, solved_pending_close_met_sla, still_pending,
  still_pending_met_sla, due_in_month, overdue_prev_months, closed_early_prev,
  closed_early_next, solved_early_next
"""
ORDER = "registered_at, l_partkey, l_suppkey, l_extendedprice"
IS_OPEN = "state NOT IN ('CLOSED', 'SOLVED')"
ACTIONABLE = "state NOT IN ('CLOSED', 'SOLVED', 'DENIED')"
PROGRESS = "TRY_CAST(replace(progress_text, ',', '.') AS DOUBLE)"

# Rows that the deliveries leave unspoilt.
DELIVERED = "case_id % 101 <> 7 AND case_id % 103 <> 5"
DISTINCT = """
  SELECT area, grp, CAST(grouping(area) + grouping(grp) AS INTEGER) AS level,
    count(DISTINCT CASE WHEN case_type = 'INCIDENT' THEN specialist END) AS "INCIDENT",
    count(DISTINCT CASE WHEN case_type = 'REQUEST' THEN specialist END) AS "REQUEST",
    count(DISTINCT specialist) AS total
  FROM cases GROUP BY ROLLUP (area, grp)
"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((CASES, *ctes)) + "\n" + body


def _listing(where: str = "TRUE") -> str:
    return _sql(f"SELECT {LIST} FROM cases WHERE {where}")


def _detail(name: str, having: str = "") -> str:
    keys = DETAIL_KEYS[name]
    denominator = "sum(overdue_prev_months) + sum(due_in_month) + sum(solved_early_next)"
    ies_est = _ratio(
        "sum(closed_met_sla) + sum(solved_pending_close_met_sla) + sum(still_pending_met_sla)",
        denominator,
    )
    ies2 = _ratio(
        "sum(closed_in_period) + sum(solved_pending_close) + sum(still_pending)", denominator
    )
    met = "count(*) FILTER (WHERE inclusion = 'INCLUDED' AND met_sla <> 0)"
    closed = "count(*) FILTER (WHERE inclusion = 'INCLUDED' AND closed_in_period <> 0)"
    out = ["sum(missed)::BIGINT AS missed", "count(*) AS cases"]
    out.append(_ratio("sum(missed)", "count(*)") + " AS prop_cases")
    if keys:
        out.append(_ratio("sum(missed)", "(SELECT sum(missed) FROM cases)") + " AS prop_total")
    out.append(_ratio("count(*) - sum(missed)", "count(*)") + " AS ics")
    out.append(_ratio(met, closed) + " AS ics_est")
    if name in WITH_EFFECTIVENESS:
        out += [f"{ies_est} AS ies_est", f"{ies2} AS ies2"]
    group = f" GROUP BY {keys}" if keys else ""
    having = having or (" HAVING sum(missed) > 0" if name in ONLY_MISSED else "")
    return _sql(f"SELECT {keys + ', ' if keys else ''}{', '.join(out)} FROM cases{group}{having}")


def _percent(share: str) -> str:
    number = f"CAST(CAST(round_even({share} * 100, 2) AS DOUBLE) AS VARCHAR)"
    return f"coalesce(regexp_replace({number}, '\\.0$', '') || '%', '')"


def _pivot(where: str = "TRUE") -> str:
    return _sql(
        "SELECT area, grp, subgrp,"
        " CAST(grouping(area) + grouping(grp) + grouping(subgrp) AS INTEGER) AS level,"
        " sum(missed)::BIGINT AS missed"
        f" FROM cases WHERE {where} GROUP BY ROLLUP (area, grp, subgrp)"
    )


def _first_cases(where: str = "TRUE") -> str:
    return f"""
firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {ORDER}) AS rn
    FROM cases WHERE {where})
  WHERE rn = 1
)"""


ARRIVALS = """
arrivals AS (
  SELECT date_trunc('hour', registered_at)::TIMESTAMP AS "hour",
    sum(CASE WHEN case_type = 'INCIDENT' THEN 1 END)::BIGINT AS incidents,
    sum(CASE WHEN case_type = 'REQUEST' THEN 1 END)::BIGINT AS requests,
    count(*) AS total
  FROM firsts GROUP BY 1
)"""

FREQUENT = """
counts AS (
  SELECT area, grp, ci, service, strftime(registered_at, '%d-%m-%Y') AS day, count(*) AS total
  FROM cases WHERE case_type = 'INCIDENT' GROUP BY ALL
),
frequent AS (
  SELECT area, CASE WHEN grp = '' THEN 'No_Group' ELSE grp END AS grp,
    CASE WHEN ci = '' THEN 'CI not_registered' ELSE ci END AS ci, service, day, total
  FROM counts
  WHERE total > (SELECT round_even(sum(total) * 0.00005::DOUBLE, 0) FROM counts)
)"""


def _fold(column: str) -> str:
    return f"translate({column}, 'áéíóúñ?', 'aeioun.')"


def _category_flow(case_type: str, tag: str, missed: str = "TRUE") -> str:
    names = ["a", "g", "l1", "l2", "l3", "l4"]
    levels = ", ".join(
        _fold(f"string_split(category_path, '.')[{i}]") + (f" || '{tag}'" if i == 2 else "") + f" AS l{i}"
        for i in range(1, 5)
    )
    steps = []
    for i, (source, target) in enumerate(zip(names, names[1:])):
        where = "" if i == 0 else f" WHERE {source} IS NOT NULL AND {target} IS NOT NULL"
        steps.append(
            f"SELECT {source} AS source, {target} AS target, count(*) AS value"
            f" FROM paths{where} GROUP BY {source}, {target}"
        )
    return _sql(
        " UNION ALL ".join(steps),
        f"""
paths AS (
  SELECT {_fold("area")} AS a,
    {_fold("CASE WHEN grp = '' THEN 'NoGroup' ELSE grp END")} AS g, {levels}
  FROM cases WHERE case_type = '{case_type}' AND {missed}
)""",
    )


ORACLE: dict[str, str] = {
    "case_listing": _listing(),
    "base_missed": _sql("SELECT case_id, area, met_sla, missed FROM cases"),
    "exclude_ids": _listing("case_id NOT IN (213, 473, 562, 1064, 59796)"),
    "exclude_ids_join": _listing("case_id NOT IN (213, 473, 562, 1064, 59796)"),
    "exclude_units": _listing("grp <> 'NATION_3' AND subgrp <> 'MACHINERY'"),
    "scope_service": _listing("service_type = 'END_USER'"),
    "scope_type": _listing("case_type = 'INCIDENT'"),
    "pseudonymise": _sql(
        "SELECT case_id, area, 'User' || CAST(number AS VARCHAR) AS specialist, registered_at"
        " FROM cases JOIN names USING (specialist) WHERE case_type = 'INCIDENT'",
        """
names AS (
  SELECT specialist, row_number() OVER (ORDER BY min(registered_at), specialist) AS number
  FROM cases WHERE case_type = 'INCIDENT' GROUP BY specialist
)""",
    ),
    "area_listing": _listing("area = 'ASIA'"),
    "open_unsolved": _listing("solved_at IS NULL"),
    "open_state": _listing(IS_OPEN),
    "open_actionable": _listing(ACTIONABLE),
    "solved_cases": _listing("solved_at IS NOT NULL"),
    "included_cases": _listing("inclusion = 'INCLUDED'"),
    "missed_cases": _listing("missed = 1"),
    "specialist_worklist": _sql(
        "SELECT case_id, case_type, state, area, grp, subgrp, specialist, service, registered_at,"
        f" due_at, elapsed_minutes, sla_minutes, met_sla, {PROGRESS} AS progress, site, ci"
        f" FROM cases WHERE {ACTIONABLE}"
    ),
    "scatter_selection": _sql(
        f"SELECT case_id, area, grp, specialist, service, {PROGRESS} AS progress, elapsed_minutes"
        f" FROM cases WHERE {IS_OPEN} AND area = 'ASIA' AND {PROGRESS} BETWEEN 50 AND 200"
        " AND elapsed_minutes BETWEEN 300 AND 1800"
    ),
    "selection_labels": _sql(
        f"SELECT case_id, area, grp, specialist, service, {PROGRESS} AS progress, elapsed_minutes,"
        f" grp || '  -  ' || service AS label FROM cases WHERE {IS_OPEN} AND area = 'ASIA'"
        f" AND {PROGRESS} BETWEEN 50 AND 200 AND elapsed_minutes BETWEEN 300 AND 1800"
    ),
    "worklist_area": _sql(
        "SELECT case_id, case_type, state, area, grp, subgrp, specialist, service, registered_at,"
        f" due_at, elapsed_minutes, sla_minutes, met_sla, {PROGRESS} AS progress, site, ci"
        f" FROM cases WHERE {ACTIONABLE} AND area = 'ASIA'"
    ),
    "scatter_points": _sql(
        f"SELECT case_id, area, case_type, {PROGRESS} AS progress, elapsed_minutes,"
        f" grp || '  -  ' || service AS label FROM cases WHERE {IS_OPEN}"
    ),
    "month_window": _sql(
        'SELECT * FROM arrivals WHERE "hour" >= TIMESTAMP \'1998-06-01\''
        " AND \"hour\" <= TIMESTAMP '1998-07-01'",
        _first_cases(),
        ARRIVALS,
    ),
    "delivered_cases": _listing(DELIVERED),
    "delivery_rejects": _sql(
        "SELECT concat_ws(', ', CASE WHEN case_id % 103 = 5 THEN 'met_sla is no number' END,"
        " CASE WHEN case_id % 101 = 7 THEN 'due_at is no time' END) AS reason,"
        f" case_id % 2 = 1 AS odd, count(*) AS n_rows FROM cases WHERE NOT ({DELIVERED}) GROUP BY ALL"
    ),
    "refreshed_snapshot": _listing(DELIVERED),
    "refused_refresh": _sql(
        "SELECT 'refused' AS outcome, count(*) AS n_rows, min(case_id) AS first_id, max(case_id) AS last_id,"
        f" 1::BIGINT AS n_versions FROM cases WHERE {DELIVERED}"
    ),
    "snapshot_reports": _sql(
        "SELECT area, count(*) FILTER (WHERE solved_at IS NULL) AS total,"
        " (sum(due_in_month + overdue_prev_months) FILTER (WHERE solved_at IS NULL))::BIGINT AS due,"
        " count(solved_at) AS solved, (SELECT max(registered_at::DATE) FROM cases"
        f" WHERE registered_at::DATE <= DATE '1998-06-15' AND {DELIVERED}) AS as_of"
        f" FROM cases WHERE {DELIVERED} GROUP BY area"
    ),
    "join_capacity": _sql(
        "SELECT b.area, b.total, b.due, c.p0 FROM backlog b"
        " JOIN capacity c ON c.area = b.area AND c.day = 15",
        CAPACITY,
        OUTLOOK,
    ),
    "kpi_ics": _sql(
        f"SELECT {UNIT}, {_ratio('sum(met_sla)', 'sum(closed_in_period)')} AS ics"
        f" FROM cases WHERE inclusion = 'INCLUDED' {BY_UNIT}"
    ),
    "kpi_ivs": _sql(
        f"SELECT {UNIT}, {_ratio('sum(elapsed_minutes)', 'sum(sla_minutes)')} AS ivs"
        f" FROM cases {BY_UNIT}"
    ),
    "kpi_ies": _sql(f"SELECT {UNIT}, {IES} AS ies FROM cases {BY_UNIT}"),
    "kpi_missed": _sql(
        f"SELECT *, {MISSED_BAND} AS missed_band FROM ("
        f" SELECT {UNIT}, sum(missed)::BIGINT AS missed, {MISSED_PCT} AS missed_pct,"
        f" {MISSED_LIMIT} AS missed_limit FROM cases {BY_UNIT})"
    ),
    "kpi_solved": _sql(
        "SELECT area, solved, round(quota_pct, 6) AS quota_pct,"
        f" {SOLVED_BAND} AS solved_band FROM outlook",
        CAPACITY,
        OUTLOOK,
    ),
    "kpi_to_close": _sql(
        f"SELECT area, due, p0, {CLOSE_BAND} AS to_close_band FROM outlook", CAPACITY, OUTLOOK
    ),
    "kpi_bands": _sql(
        """
SELECT area, kpi, round(value, 6) AS value, round(target, 6) AS target,
       round(tolerance, 6) AS tolerance, band
FROM (
  SELECT area, 'ics' AS kpi, ics AS value, 0.61::DOUBLE AS target, 0.01::DOUBLE AS tolerance,
         ics_band AS band FROM card
  UNION ALL SELECT area, 'ivs', ivs, NULL, NULL, ivs_band FROM card
  UNION ALL SELECT area, 'ies', ies, 0.395, 0.008, ies_band FROM card
  UNION ALL SELECT area, 'to_close', due, p0, p0 * 0.1::DOUBLE, to_close_band FROM card
  UNION ALL SELECT area, 'solved', quota_pct, 100, 5, solved_band FROM card
  UNION ALL SELECT area, 'missed', missed, missed_limit, NULL, missed_band FROM card
)""",
        CAPACITY,
        OUTLOOK,
        SCORED,
    ),
    "kpi_scorecard": _sql(
        "SELECT area, ics, ics_band, ivs, ivs_band, ies, ies_band, due, p0, to_close_band, solved,"
        " round(quota_pct, 6) AS quota_pct, solved_band, missed, missed_pct, missed_limit,"
        " missed_band FROM card",
        CAPACITY,
        OUTLOOK,
        SCORED,
    ),
    **{f"detail_{name}": _detail(name) for name in DETAIL_KEYS},
    "detail_shown": "SELECT area, grp, missed, cases, "
    + ", ".join(f"{_percent(c)} AS {c}" for c in ("prop_cases", "prop_total", "ics", "ics_est", "ies_est", "ies2"))
    + f" FROM ({_detail('group')})",
    "detail_category_area": _detail("service_category", " HAVING area = 'ASIA' AND sum(missed) > 0"),
    "detail_subgroup_area": _detail("subgroup", " HAVING area = 'ASIA'"),
    "active_backlog": _sql(
        "SELECT area, grp, subgrp, specialist, count(*) AS active,"
        " sum(due_in_month)::BIGINT AS due, sum(missed)::BIGINT AS missed"
        " FROM cases WHERE solved_at IS NULL GROUP BY area, grp, subgrp, specialist"
    ),
    "capacity_outlook": _sql(
        "SELECT area, total, due, p0, round(probability, 6) AS probability,"
        " round(spare, 6) AS spare, cap_total, solved, round(quota_pct, 6) AS quota_pct"
        " FROM outlook",
        CAPACITY,
        OUTLOOK,
    ),
    "pivot_missed": _pivot(),
    "pivot_by_type": _sql(
        "SELECT area, grp, CAST(grouping(area) + grouping(grp) AS INTEGER) AS level,"
        ' sum(CASE WHEN case_type = \'INCIDENT\' THEN missed END)::BIGINT AS "INCIDENT",'
        ' sum(CASE WHEN case_type = \'REQUEST\' THEN missed END)::BIGINT AS "REQUEST",'
        " sum(missed)::BIGINT AS total FROM cases GROUP BY ROLLUP (area, grp)"
    ),
    "pivot_missed_area": _pivot("area = 'ASIA'"),
    "pivot_avg": _sql(
        "SELECT area, grp, CAST(grouping(area) + grouping(grp) AS INTEGER) AS level,"
        " round(avg(met_sla), 6) AS met_sla FROM cases GROUP BY ROLLUP (area, grp)"
    ),
    "pivot_distinct": _sql(DISTINCT),
    "pivot_distinct_sketch": _sql(
        f'SELECT *, "INCIDENT" >= 0 AS "INCIDENT_near", "REQUEST" >= 0 AS "REQUEST_near",'
        f" total >= 0 AS total_near FROM ({DISTINCT})"
    ),
    "frequent_ci": _sql("SELECT * FROM frequent", FREQUENT),
    "frequent_ci_tree": _sql(
        "SELECT area, ci, service, total, day, CAST(grouping(area) + grouping(ci)"
        " + grouping(service) + grouping(total) + grouping(day) AS INTEGER) AS level,"
        " sum(weight)::BIGINT AS size FROM (SELECT *, total AS weight FROM frequent)"
        " GROUP BY ROLLUP (area, ci, service, total, day)",
        FREQUENT,
    ),
    "state_matrix": _sql(
        "SELECT state, specialist, count(*) AS total FROM cases"
        f" WHERE {ACTIONABLE} GROUP BY state, specialist"
    ),
    "state_matrix_area": _sql(
        "SELECT state, specialist, count(*) AS total FROM cases"
        f" WHERE {ACTIONABLE} AND area = 'ASIA' GROUP BY state, specialist"
    ),
    "recurrent_cases_area": _sql(
        "SELECT area, specialist, case_id, count(*) AS total FROM pending WHERE area = 'ASIA'"
        " GROUP BY area, specialist, case_id HAVING count(*) > 1",
        PENDING,
    ),
    "recurrent_cases": _sql(
        "SELECT area, specialist, case_id, count(*) AS total FROM pending"
        " GROUP BY area, specialist, case_id HAVING count(*) > 1",
        PENDING,
    ),
    "distinct_pairs": _sql("SELECT DISTINCT specialist, area FROM cases"),
    "dedup_cases": _sql(f"SELECT {LIST} FROM firsts", _first_cases()),
    "dedup_cases_in_place": _sql(f"SELECT {LIST} FROM firsts", _first_cases()),
    "hourly_arrivals": _sql("SELECT * FROM arrivals", _first_cases(), ARRIVALS),
    "hourly_arrivals_area": _sql(
        "SELECT * FROM arrivals", _first_cases("area = 'ASIA'"), ARRIVALS
    ),
    "hourly_incidents": _sql(
        'SELECT "hour", incidents FROM arrivals', _first_cases("case_type = 'INCIDENT'"), ARRIVALS
    ),
    "hourly_requests": _sql(
        'SELECT "hour", requests FROM arrivals', _first_cases("case_type = 'REQUEST'"), ARRIVALS
    ),
    "business_grid": _sql("SELECT t FROM grid", LATEST_DAY, GRID),
    "backlog_trend": _sql("SELECT * FROM trend", FIXED_DAY, GRID, TREND),
    "backlog_ratios": _sql("SELECT t, lag_pct, managed_pct FROM trend", FIXED_DAY, GRID, TREND),
    "running_compliance": _sql("SELECT * FROM running", RUNNING),
    "running_compliance_total": _sql("SELECT * FROM running WHERE area = 'TOTAL'", RUNNING),
    "running_compliance_area": _sql("SELECT * FROM running WHERE area = 'ASIA'", RUNNING),
    "rolling_arrivals": _sql(
        'SELECT "hour", '
        + ", ".join(
            f'round(avg({c}) OVER (ORDER BY "hour" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)'
            f" AS {c}"
            for c in ("incidents", "requests", "total")
        )
        + " FROM arrivals",
        _first_cases(),
        ARRIVALS,
    ),
    "top_specialists": _sql(
        "SELECT specialist, t.missed, area, CAST(t.missed AS VARCHAR) || ' missed - ' || area"
        " AS message FROM top t JOIN (SELECT DISTINCT specialist, area FROM cases)"
        " USING (specialist)",
        """
top AS (
  SELECT specialist, sum(missed)::BIGINT AS missed FROM cases GROUP BY specialist
  ORDER BY missed DESC, specialist LIMIT 20
)""",
    ),
    "top_sites": _sql(
        "SELECT site, category, count(*) AS total,"
        " CAST(count(*) AS VARCHAR) || ' : Incidents : ' || category AS message"
        " FROM cases WHERE service_type = 'END_USER' AND case_type = 'INCIDENT'"
        " GROUP BY site, category ORDER BY total DESC, site, category LIMIT 20"
    ),
    "flow_incidents": _category_flow("INCIDENT", ""),
    "flow_requests": _category_flow("REQUEST", " "),
    "flow_missed_incidents": _category_flow("INCIDENT", " ", "missed = 1"),
    "flow_missed_requests": _category_flow("REQUEST", " ", "missed = 1"),
    "flow_open": _sql(
        "SELECT a AS source, s AS target, count(*) AS value FROM paths"
        " WHERE a IS NOT NULL AND s IS NOT NULL GROUP BY a, s"
        " UNION ALL SELECT CASE WHEN s = '' THEN 'NA1a' ELSE s END,"
        " CASE WHEN st = '' THEN 'No_CI' ELSE st END, count(*) FROM paths"
        " WHERE s IS NOT NULL AND st IS NOT NULL GROUP BY s, st",
        f"paths AS (SELECT {_fold('area')} AS a, {_fold('specialist')} AS s,"
        f" {_fold('state')} AS st FROM cases WHERE {IS_OPEN})",
    ),
    "flow_ci_state": _sql(
        "SELECT CASE WHEN c = '' THEN 'No_CI' ELSE c END AS source,"
        " CASE WHEN st = '' THEN 'NA1c' ELSE st END AS target, count(*) AS value"
        " FROM paths GROUP BY c, st",
        f"paths AS (SELECT {_fold('ci')} AS c, {_fold('state')} AS st"
        f" FROM cases WHERE {IS_OPEN})",
    ),
    "flow_client_pending": _sql(
        "SELECT a AS source, s AS target, count(*) AS value FROM paths GROUP BY a, s"
        " UNION ALL SELECT s, c, count(*) FROM paths"
        " WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY s, c"
        " UNION ALL SELECT c, e, count(*) FROM paths"
        " WHERE c IS NOT NULL AND e IS NOT NULL GROUP BY c, e",
        PENDING,
        f"paths AS (SELECT {_fold('area')} AS a, {_fold('service')} AS s,"
        f" {_fold('category')} || '.' AS c, {_fold('specialist')} AS e FROM pending)",
    ),
    "flow_client_pending_area": _sql(
        "SELECT a AS source, s AS target, count(*) AS value FROM paths GROUP BY a, s"
        " UNION ALL SELECT s, c, count(*) FROM paths"
        " WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY s, c"
        " UNION ALL SELECT c, e, count(*) FROM paths"
        " WHERE c IS NOT NULL AND e IS NOT NULL GROUP BY c, e",
        PENDING,
        f"paths AS (SELECT {_fold('area')} AS a, {_fold('service')} AS s,"
        f" {_fold('category')} || '.' AS c, {_fold('specialist')} AS e FROM pending"
        " WHERE area = 'ASIA')",
    ),
    "split_category": _sql(
        "SELECT case_id, category_path, "
        + ", ".join(f"string_split(category_path, '.')[{i}] AS level_{i}" for i in range(1, 5))
        + " FROM cases"
    ),
    "fold_accents": f"SELECT doc_id, lang, {_fold('text')} AS folded FROM documents",
    "blank_labels": _sql(
        "SELECT case_id, CASE WHEN grp = '' THEN 'No_Group' ELSE grp END AS grp,"
        " CASE WHEN ci = '' THEN 'CI not_registered' ELSE ci END AS ci FROM cases"
    ),
    "parse_progress": _sql(f"SELECT case_id, progress_text, {PROGRESS} AS progress FROM cases"),
}
