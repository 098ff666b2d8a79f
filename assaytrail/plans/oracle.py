"""SQL of each query for a second engine, written from the definitions. Used to check results only."""

from __future__ import annotations

import re

from ..sources import adapters as A
from ..sources import dictionary as d


def _lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def _pick(selector: str, options: list) -> str:
    return f"CASE {selector} " + " ".join(f"WHEN {i} THEN {_lit(o)}" for i, o in enumerate(options)) + " END"


def _distance(v: str) -> str:
    return f"greatest(coalesce(target_low - {v}, 0), coalesce({v} - target_high, 0), 0)"


def _direction(before: str, after: str) -> str:
    d0, d1 = _distance(before), _distance(after)
    return (f"CASE WHEN ({before}) IS NULL OR ({after}) IS NULL OR (target_low IS NULL AND target_high IS NULL) THEN NULL "
            f"WHEN {d0} = 0 AND {d1} = 0 THEN 'within' WHEN abs({d1} - {d0}) < 1e-9 THEN 'unchanged' "
            f"WHEN {d1} < {d0} THEN 'toward' ELSE 'away' END")


def _round(x: str, places: int) -> str:
    """Half-up rounding of the number as it is written out, which is what Spark rounds."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {places}) AS DOUBLE)"


def _pct(new: str, ref: str) -> str:
    return _round(f"(({new} - {ref}) / nullif({ref}, 0) * 100)", 1)


def _digits(x: str, digits: int = 4) -> str:
    """A number of some significant digits as text, without trailing zeros."""
    def text(places: int) -> str:
        rounded = f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {places}) AS VARCHAR)"
        return rf"regexp_replace(regexp_replace({rounded}, '(\.[0-9]*?)0+$', '\1'), '\.$', '')"

    cases = " ".join(f"WHEN abs({x}) >= {10.0 ** power!r} THEN {text(max(digits - 1 - power, 0))}" for power in range(digits - 1, -6, -1))
    return f"CASE {cases} ELSE {text(digits + 6)} END"


def _filled(template: str, **values: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"CAST({values[p]} AS VARCHAR)" if i % 2 else _lit(p) for i, p in enumerate(parts) if p)


_DATE = "DATE '2015-01-01' + CAST(floor(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 3) AS INTEGER)"
_OBS_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)"
_windows = {cid: (int(a), int(b)) for cid, _, _, a, b in d.table(d.DRUG_CLASSES)}
_short = {cid: short for cid, _, short, _, _ in d.table(d.DRUG_CLASSES)}


def _observation(slot: int, options: list, selector: str) -> str:
    typical = _pick(selector, [t for _, t in options])
    scaled = f"(({typical})::BIGINT * (42000000 + 15 * CAST(round(l_extendedprice * 100) AS BIGINT)))"
    return (f"SELECT l_orderkey AS report_id, CASE l_discount WHEN 0.0 THEN '<' WHEN 0.1 THEN '>' END AS comparator, 1 AS page, "
            f"CASE WHEN l_tax = 0.08 THEN 'rejected' ELSE 'confirmed' END AS status, {_OBS_ID}, {slot}) AS observation_id, "
            f"{_pick(selector, [a for a, _ in options])} AS analyte_id, ({scaled} // 105000000)::DOUBLE / 1000 AS canonical_value, "
            f"l_linenumber * 2 + {slot} AS line FROM lineitem")


_COMPARATORS = [("(<=|≤|=<)", "<="), ("(>=|≥|=>)", ">="), ("<", "<"), (">", ">")]
_NUMBER = r"^[+]?([1-9]\d{0,2}(,\d{3})+|[1-9]\d?(,\d{2})+,\d{3}|\d+)(\.\d+)?$|^[+]?\.\d+$"


def _words(name: str) -> str:
    plain = rf"regexp_replace(regexp_replace(lower({name}), '^\s*sr?(?:\.\s*|\s+)([a-z])', '\1'), '[^0-9a-z ]+', ' ', 'g')"
    tokens = f"list_filter(string_split({plain}, ' '), lambda w: w <> '')"
    return (f"list_filter({tokens}, lambda w: w NOT IN ('serum','plasma','direct','calculated','blood','whole') AND (w <> 'fasting' "
            f"OR list_has_any({tokens}, ['glucose','sugar'])))")


def _unit_key(u: str) -> str:
    return rf"lower(replace(replace(regexp_replace({u}, '[\s.]+', '', 'g'), 'µ', 'u'), 'μ', 'u'))"


_own = {row[0]: row[1] for row in d.table(d.ANALYTES)}
_names = [(a, n, "primary") for a in _own for n in [_own[a], *d.lists(d.SYNONYMS)[a], *d.lists(d.REPORT_SYNONYMS).get(a, [])]]
_names += [(a, n, "alternate") for a, ns in d.lists(d.ALTERNATE_NAMES).items() for n in ns]
_conversions = [(a, i, u.rsplit(" = ", 1)[0], *map(float, (u.rsplit(" = ", 1)[1] + " + 0").split(" + ")[:2]))
                for a, us in d.lists(d.CONVERSIONS).items() for i, u in enumerate(us)]
_ranges = {(a, s): (d.number(lo), d.number(hi)) for a, s, lo, hi in d.table(d.REFERENCE_RANGES)}
_limits = {a: (d.number(lo), d.number(hi)) for a, lo, hi in d.table(d.EXTREME_LIMITS)}
_style = "l_suppkey % 9"
_plain = "(cents % 997)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0')"
_recorded = "list_has_any(conds, {names})"
_cond = {icd: [n.strip() for n in names.split(";")] for names, icd, *_ in d.table(d.CONDITIONS)}
_G = "CASE WHEN {v} >= 90 THEN 'G1' WHEN {v} >= 60 THEN 'G2' WHEN {v} >= 45 THEN 'G3a' WHEN {v} >= 30 THEN 'G3b' WHEN {v} >= 15 THEN 'G4' WHEN {v} IS NOT NULL THEN 'G5' END"
_A = "CASE WHEN {v} > 300 THEN 'A3' WHEN {v} >= 30 THEN 'A2' WHEN {v} IS NOT NULL THEN 'A1' END"
_ORDER = "date, report_id, page, line, observation_id"
_T95 = "CASE " + " ".join(f"WHEN n_points - 2 <= {k} THEN {v}" for k, v in sorted(d.T95.items())) + " ELSE 2.0 END"
_KEY = "patient_id, analyte_id"

CTES: dict[str, str] = {
    "d_analyte": _values([(i, a, n, loinc, unit, system, d.number(rcv), status) for i, (a, n, loinc, unit, system, rcv, status)
                          in enumerate(d.table(d.ANALYTES))],
                         "analyte_order, analyte_id, analyte_name, loinc, unit, system_id, rcv_percent, rcv_status"),
    "d_source": _values([(a, dict(d.table(d.RCV_SOURCES)).get(a, d.RCV_SOURCE)) for a, *_ in d.table(d.ANALYTES)], "analyte_id, source"),
    "d_target": _values([(a, d.number(lo), d.number(hi)) for a, lo, hi, *_ in d.table(d.TARGETS)],
                        "analyte_id, target_low, target_high"),
    "d_effect": _values([(c, i, a, way, d.number(limit), size, note, _short[c], *_windows[c])
                         for i, (c, a, way, limit, size, note) in enumerate(d.table(d.DRUG_EFFECTS))],
                        "drug_class, effect_order, analyte_id, direction, max_percent, effect_size, effect_note, short, wfrom, wto"),
    "d_drug": _values([(g, c, g) for c, gs in d.lists(d.GENERICS).items() for g in gs]
                      + [(b.split("=")[0].strip().lower(), c, b.split("=")[1].strip()) for c, bs in d.lists(d.BRANDS).items() for b in bs],
                      "drug_key, drug_class, generic"),
    "d_system": _values([(s, n, int(o), h) for s, n, o, h in d.table(d.SYSTEMS)], "system_id, system_name, system_order, headline"),
    "d_name": _values(_names, "analyte_id, printed_name, basis"),
    "d_conversion": _values(_conversions, "analyte_id, unit_order, unit, factor, offset_by"),
    "d_range": _values([(a, s, *(_ranges.get((a, s)) or _ranges[(a, "any")]), *_limits[a]) for a in _own for s in ("male", "female")],
                       "analyte_id, sex, low, high, xlow, xhigh"),
    "d_condition": _values([(n, icd, snomed) for n, icd, snomed in
                            ((n.strip(), icd, snomed) for names, icd, _, snomed, _ in d.table(d.CONDITIONS) for n in names.split(";"))],
                           "condition_key, icd10, snomed"),
    "v_patient": f"""SELECT c_custkey AS patient_id, CAST(c_nationkey AS BIGINT) AS doctor_id, c_name AS name,
        CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CAST(1930 + c_custkey % 50 AS INTEGER) AS birth_year,
        CASE WHEN c_custkey % 7 <> 0 THEN CAST(50 + c_custkey % 50 AS DOUBLE) END AS weight_kg,
        list_filter(string_split({_pick('c_custkey % 5', A.CONDITION_SETS)}, ';'), lambda x: x <> '') AS conditions,
        list_transform(conditions, lambda x: lower(x)) AS conds FROM customer""",
    "v_report": f"""SELECT o_orderkey AS report_id, o_custkey AS patient_id,
        CASE o_orderkey % 4 WHEN 0 THEN 'Lab A' WHEN 1 THEN 'Lab B' WHEN 2 THEN 'Lab C' END AS lab, {_DATE} AS collected_at,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'extracted' ELSE 'confirmed' END AS status FROM orders""",
    "v_event": f"""SELECT o_orderkey AS event_id, o_custkey AS patient_id,
        CASE o_orderpriority {" ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in A.PRESCRIBED.items())} END AS drug,
        CASE o_orderkey % 4 WHEN 2 THEN 'stop' WHEN 3 THEN 'dose_change' ELSE 'start' END AS change, {_DATE} AS date FROM orders""",
    "v_obs": _observation(0, A.MAIN_ANALYTES, "l_partkey % 6") + " UNION ALL " + _observation(1, A.SECOND_ANALYTES, "l_suppkey % 4"),
    "v_point": """SELECT patient_id, analyte_id, observation_id, report_id, collected_at AS date, canonical_value AS value, comparator,
        lab, page, line FROM v_obs JOIN v_report USING (report_id) WHERE v_obs.status = 'confirmed' AND v_report.status = 'confirmed'""",
    "v_day": f"""SELECT {_KEY}, date, {_round('sum(CAST(value AS DECIMAL(24, 6))) / count(*)', 10)} AS value, count(*) AS n_values, min(coalesce(lab, '')) AS lab_lo,
        max(coalesce(lab, '')) AS lab_hi, min(report_id) AS first_report, max(report_id) AS last_report
        FROM v_point WHERE comparator IS NULL GROUP BY ALL""",
    "v_drug_text": r"""SELECT *, lower(trim(regexp_replace(drug, '\s+', ' ', 'g'))) AS whole,
        list_filter(regexp_split_to_array(lower(trim(regexp_replace(drug, '\s+', ' ', 'g'))), '[\s.,/+()-]+'),
          lambda w: w <> '' AND NOT regexp_matches(w, '""" + d.DRUG_NOISE + """'))[1] AS word FROM v_event""",
    "v_drug": """SELECT e.event_id, e.patient_id, e.drug, e.change, e.date, coalesce(a.drug_class, b.drug_class, 'unknown') AS drug_class,
        coalesce(a.generic, b.generic) AS generic FROM v_drug_text e LEFT JOIN d_drug a ON a.drug_key = e.whole
        LEFT JOIN d_drug b ON b.drug_key = e.word""",
    "v_effect": """SELECT e.*, analyte_id, direction, max_percent, effect_size, date + wfrom AS window_start, date + wto AS window_end
        FROM v_drug e JOIN d_effect USING (drug_class)""",
    "v_window": "SELECT * FROM v_effect WHERE change = 'start'",
    "v_bounds": f"""SELECT {_KEY}, min(date) AS first_event, max(window_end) FILTER (WHERE change = 'start') AS cutoff
        FROM v_effect GROUP BY ALL""",
    "v_step": f"""SELECT d.*, rcv_percent, target_low, target_high,
        lag(date) OVER w AS pdate, lag(value) OVER w AS pvalue, lag(lab_lo) OVER w AS plo, lag(lab_hi) OVER w AS phi,
        lag(date, 2) OVER w AS p2date, lag(value, 2) OVER w AS p2value, lag(lab_lo, 2) OVER w AS p2lo, lag(lab_hi, 2) OVER w AS p2hi,
        lead(date) OVER w AS ndate, lead(value) OVER w AS nvalue, lead(lab_lo) OVER w AS nlo, lead(lab_hi) OVER w AS nhi
        FROM v_day d JOIN d_analyte USING (analyte_id) LEFT JOIN d_target USING (analyte_id)
        WINDOW w AS (PARTITION BY {_KEY} ORDER BY date)""",
    "v_numbered": f"""SELECT d.*, first_event, cutoff, row_number() OVER (PARTITION BY {_KEY} ORDER BY date) AS rn,
        count(*) OVER (PARTITION BY {_KEY}) AS n_days,
        count(*) FILTER (WHERE first_event IS NULL OR date < first_event) OVER (PARTITION BY {_KEY}) AS n_pre
        FROM v_day d LEFT JOIN v_bounds USING ({_KEY})""",
    "v_base": f"""SELECT {_KEY}, CASE count(*) WHEN 2 THEN (min(value) + max(value)) / 2 ELSE median(value) END AS baseline, CAST(count(*) AS INTEGER) AS baseline_n, min(date) AS bfirst, max(date) AS blast,
        min(lab_lo) AS blo, max(lab_hi) AS bhi, CASE WHEN max(n_pre) < 2 THEN 'includes on-treatment results' END AS note
        FROM v_numbered WHERE n_days >= 2 AND rn <= CASE WHEN n_pre >= 2 THEN least(3, n_pre) ELSE 3 END GROUP BY ALL""",
    "v_last": f"""SELECT {_KEY}, max(date) AS date, arg_max(value, date) AS value, arg_max(lab_lo, date) AS lab_lo,
        arg_max(lab_hi, date) AS lab_hi FROM v_day GROUP BY ALL""",
    "v_line": f"""SELECT {_KEY}, CAST(count(*) FILTER (WHERE used) AS INTEGER) AS n_points,
        CAST(count(*) FILTER (WHERE NOT used) AS INTEGER) AS n_excluded,
        min(date) FILTER (WHERE used) AS first_used, max(date) FILTER (WHERE used) AS last_used,
        arg_min(value, date) FILTER (WHERE used) AS first_value, arg_max(value, date) FILTER (WHERE used) AS last_value,
        min(lab_lo) FILTER (WHERE used) AS ulo, max(lab_hi) FILTER (WHERE used) AS uhi,
        regr_slope(value, x) FILTER (WHERE used) AS b, avg(x) FILTER (WHERE used) AS mx, avg(value) FILTER (WHERE used) AS my,
        regr_sxx(value, x) FILTER (WHERE used) AS sxx, regr_sxy(value, x) FILTER (WHERE used) AS sxy,
        regr_syy(value, x) FILTER (WHERE used) AS syy
        FROM (SELECT *, cutoff IS NULL OR date > cutoff AS used, (date - DATE '1970-01-01') / 365.25::DOUBLE AS x FROM v_numbered
              WHERE n_days >= 2) GROUP BY ALL""",
    "v_slope": """SELECT *, CASE WHEN n_points >= 3 THEN last_used - first_used ELSE 0 END AS span_days,
        CASE WHEN n_points >= 3 THEN round(b, 3) END AS per_year,
        CASE WHEN n_points < 3 THEN 'not enough points' WHEN last_used - first_used >= 365 THEN 'ok' ELSE 'not enough span' END AS slope_status
        FROM v_line""",
    "v_prev_flag": f"""SELECT *, {_pct('value', 'pvalue')} AS change_percent, CASE WHEN {_pct('value', 'pvalue')} > 0 THEN 'rise' ELSE 'fall' END AS direction,
        least(lab_lo, plo) <> greatest(lab_hi, phi) AS cross_lab, {_direction('pvalue', 'value')} AS target_direction
        FROM v_step WHERE pdate IS NOT NULL AND abs({_pct('value', 'pvalue')}) > rcv_percent""",
    "v_base_flag": f"""SELECT l.*, baseline, bfirst, blast, {_pct('value', 'baseline')} AS change_percent,
        CASE WHEN {_pct('value', 'baseline')} > 0 THEN 'rise' ELSE 'fall' END AS direction,
        least(lab_lo, blo) <> greatest(lab_hi, bhi) AS cross_lab, {_direction('baseline', 'value')} AS target_direction
        FROM v_last l JOIN v_base USING ({_KEY}) JOIN d_analyte USING (analyte_id) LEFT JOIN d_target USING (analyte_id)
        WHERE date > blast AND abs({_pct('value', 'baseline')}) > rcv_percent""",
    "v_lab_change": """SELECT *, CASE WHEN changed THEN plo END AS from_lab, CASE WHEN changed THEN lab_lo END AS to_lab,
        CASE WHEN changed AND nlo = nhi AND nlo = plo THEN coalesce(abs(""" + _pct("nvalue", "pvalue") + """) <= rcv_percent, false)
             WHEN changed AND p2lo = p2hi AND p2lo = lab_lo THEN coalesce(abs(""" + _pct("value", "p2value") + """) <= rcv_percent, false) END AS agrees,
        CASE WHEN changed AND nlo = nhi AND nlo = plo THEN ndate WHEN changed AND p2lo = p2hi AND p2lo = lab_lo THEN p2date END AS other_date
        FROM (SELECT *, lab_lo = lab_hi AND plo = phi AND lab_lo <> '' AND plo <> '' AND lab_lo <> plo AS changed FROM v_prev_flag)""",
    "v_change_flag": f"""SELECT {_KEY}, 'RCV_PREV' AS rule_id, date, pdate AS rfirst, pdate AS rlast, direction, change_percent, cross_lab,
        target_direction FROM v_prev_flag UNION ALL SELECT {_KEY}, 'RCV_BASELINE', date, bfirst, blast, direction, change_percent, cross_lab,
        target_direction FROM v_base_flag""",
    "v_explained": f"""SELECT f.{_KEY.replace(', ', ', f.')}, f.rule_id, f.date,
        arg_min({{'event': w.event_id, 'class': w.drug_class, 'wstart': w.window_start, 'wend': w.window_end,
          'text': CASE WHEN e.max_percent IS NULL THEN e.effect_note
            WHEN abs(f.change_percent) > e.max_percent THEN 'above the ' || f.direction || ' usually expected after ' || e.short || ' start (up to ' || e.max_percent::INTEGER || '%)'
            ELSE 'within the ≤' || e.max_percent::INTEGER || '% ' || f.direction || ' expected after ' || e.short || ' start' END}},
          {{'d': w.date, 'id': w.event_id}}) AS x
        FROM v_change_flag f JOIN v_window w ON w.patient_id = f.patient_id AND w.analyte_id = f.analyte_id AND w.direction = f.direction
          AND f.date BETWEEN w.window_start AND w.window_end
        JOIN d_effect e ON e.drug_class = w.drug_class AND e.analyte_id = w.analyte_id GROUP BY ALL""",
    "v_rapid": f"""SELECT s.*, last_used AS date, ulo <> uhi AS cross_lab, {_direction('first_value', 'last_value')} AS target_direction
        FROM v_slope s LEFT JOIN d_target USING (analyte_id) WHERE analyte_id = 'egfr' AND slope_status = 'ok' AND per_year < -5""",
    "v_flag": f"""SELECT f.*, 'change' AS level, x.event AS effect_event, x.class AS effect_class, x.text AS effect_text, x.wstart AS effect_from,
          x.wend AS effect_to, agrees
        FROM v_change_flag f LEFT JOIN v_explained USING ({_KEY}, rule_id, date)
        LEFT JOIN (SELECT {_KEY}, 'RCV_PREV' AS rule_id, date, agrees FROM v_lab_change) USING ({_KEY}, rule_id, date)
        UNION ALL SELECT {_KEY}, 'KDIGO_RAPID_EGFR', date, first_used, last_used, 'fall', NULL, cross_lab, target_direction, 'guideline',
          NULL, NULL, NULL, NULL, NULL, NULL FROM v_rapid""",
    "v_flag_id": "SELECT *, rule_id || ':' || analyte_id || ':' || date AS flag_id FROM v_flag",
    "v_line_at_last": "SELECT *, my + b * ((last_used - DATE '1970-01-01') / 365.25::DOUBLE - mx) AS at_last, sqrt(greatest(syy - b * sxy, 0) / (n_points - 2) / sxx) * "
                      + _T95 + " AS margin FROM v_slope WHERE analyte_id = 'egfr' AND slope_status = 'ok' AND per_year < 0",
    "v_projection": """SELECT *, at_last - threshold AS gap FROM (SELECT *, CASE """
                    + " ".join(f"WHEN at_last > {t} THEN {t}" for t, _ in d.NEXT_G_CATEGORY) + " END AS threshold, CASE "
                    + " ".join(f"WHEN at_last > {t} THEN '{c}'" for t, c in d.NEXT_G_CATEGORY)
                    + " END AS category FROM v_line_at_last) WHERE threshold IS NOT NULL AND (at_last - threshold) / -b <= 10",
    "v_since": f"""SELECT {_KEY}, date, lag(date) OVER (PARTITION BY {_KEY} ORDER BY date) AS since
        FROM (SELECT DISTINCT {_KEY}, date FROM v_effect)""",
    "v_before": f"""SELECT event_id, analyte_id, count(*) AS n_before, avg(value) AS before_mean, min(lab_lo) AS blo, max(lab_hi) AS bhi
        FROM (SELECT e.event_id, e.analyte_id, d.value, d.lab_lo, d.lab_hi, d.date,
                row_number() OVER (PARTITION BY e.event_id, e.analyte_id ORDER BY d.date DESC) AS rn
              FROM v_effect e JOIN v_since s USING ({_KEY}, date) JOIN v_day d ON d.patient_id = e.patient_id AND d.analyte_id = e.analyte_id
                AND d.date <= e.date AND e.date - d.date <= 180 AND (s.since IS NULL OR d.date > s.since))
        WHERE rn <= 3 GROUP BY ALL""",
    "v_after": """SELECT e.event_id, e.analyte_id, min(d.date) FILTER (WHERE d.date <= e.window_end) AS after_date,
        arg_min(d.value, d.date) FILTER (WHERE d.date <= e.window_end) AS after_value,
        arg_min(d.lab_lo, d.date) FILTER (WHERE d.date <= e.window_end) AS alo, arg_min(d.lab_hi, d.date) FILTER (WHERE d.date <= e.window_end) AS ahi
        FROM v_effect e JOIN v_day d ON d.patient_id = e.patient_id AND d.analyte_id = e.analyte_id AND d.date >= e.window_start GROUP BY ALL""",
    "v_resp_raw": """SELECT e.*, coalesce(n_before, 0) AS n_before, before_mean, blo, bhi, after_date, after_value, alo, ahi, rcv_percent, target_low, target_high,
        CASE WHEN a.event_id IS NULL THEN 'too early to assess' WHEN n_before IS NULL THEN 'no baseline'
             WHEN after_date IS NULL THEN 'no result in window' ELSE 'assessed' END AS status
        FROM v_effect e LEFT JOIN v_before b USING (event_id, analyte_id) LEFT JOIN v_after a USING (event_id, analyte_id)
        JOIN d_analyte USING (analyte_id) LEFT JOIN d_target USING (analyte_id)""",
    "v_resp_change": f"""SELECT *, CASE WHEN status = 'assessed' THEN {_pct('after_value', 'before_mean')} END AS change_percent,
        coalesce(after_date, window_end) AS until, CASE WHEN after_value > before_mean THEN 'rise' ELSE 'fall' END AS moved,
        CASE WHEN status = 'assessed' THEN {_direction('before_mean', 'after_value')} END AS target_direction,
        CASE WHEN status = 'assessed' THEN least(blo, alo) <> greatest(bhi, ahi) END AS cross_lab FROM v_resp_raw""",
    "v_resp": """SELECT *, abs(change_percent) > rcv_percent AS beyond_rcv,
        status = 'assessed' AND change = 'start' AND change_percent IS NOT NULL AND moved = direction AS effect_shown,
        CASE WHEN change = 'start' AND change_percent IS NOT NULL THEN
          CASE WHEN same AND abs(change_percent) > max_percent THEN 'above expected'
               WHEN same AND (abs(change_percent) > rcv_percent OR effect_size = 'small') THEN 'seen'
               WHEN NOT same AND abs(change_percent) > rcv_percent THEN 'opposite' ELSE 'not seen' END END AS verdict
        FROM (SELECT *, (CASE WHEN change_percent > 0 THEN 'rise' ELSE 'fall' END) = direction AS same FROM v_resp_change)""",
    "v_printed": f"""SELECT {_OBS_ID}) AS observation_id, l_orderkey AS report_id, 1 AS page,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS line,
        {_pick(f'l_partkey % {len(A.PRINTED_TESTS)}', [n for n, _ in A.PRINTED_TESTS])} AS test_text,
        CASE {_style} WHEN 0 THEN '<' || {_plain} WHEN 1 THEN 'less than ' || {_plain} WHEN 2 THEN '1,50,' || lpad((cents % 1000)::VARCHAR, 3, '0')
          WHEN 3 THEN {_plain} || '*' WHEN 4 THEN 'Negative' WHEN 5 THEN '5,' || (cents % 10) WHEN 6 THEN '>= ' || {_plain} ELSE {_plain} END AS value_text,
        CASE WHEN l_tax = 0.01 THEN '' ELSE {_pick(f'l_partkey % {len(A.PRINTED_TESTS)}', [u for _, u in A.PRINTED_TESTS])} END AS unit_text,
        CASE WHEN l_returnflag = 'N' THEN '1 - 2' ELSE '' END AS range_text, l_quantity, l_returnflag
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)""",
    "v_name_key": f"""SELECT DISTINCT analyte_id, basis, lower(trim(regexp_replace(printed_name, '\\s+', ' ', 'g'))) AS k1,
        array_to_string(list_sort(list_distinct({_words('printed_name')})), ' ') AS k2, array_to_string({_words('printed_name')}, '') AS k3 FROM d_name""",
    "v_text_name": f"""SELECT t AS test_text, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS k1,
        array_to_string(list_sort(list_distinct({_words('t')})), ' ') AS k2, array_to_string({_words('t')}, '') AS k3
        FROM (SELECT DISTINCT test_text AS t FROM v_printed)""",
    "v_text_hit": """SELECT test_text, CASE WHEN max(exact) = 1 THEN 'exact' ELSE 'loose' END AS how,
        list_sort(list_distinct(list(analyte_id) FILTER (WHERE exact = best))) AS ids, list_distinct(list(basis) FILTER (WHERE exact = best)) AS bases
        FROM (SELECT *, max(exact) OVER (PARTITION BY test_text) AS best FROM (
          SELECT t.test_text, n.analyte_id, n.basis, CASE WHEN n.k1 = t.k1 THEN 1 ELSE 0 END AS exact FROM v_text_name t JOIN v_name_key n
          ON n.k1 = t.k1 OR (t.k2 <> '' AND (n.k2 = t.k2 OR n.k3 = t.k3)))) GROUP BY test_text""",
    "v_matched": """SELECT p.*, CASE WHEN len(ids) = 1 THEN ids[1] END AS analyte_id, CASE WHEN len(ids) = 1 THEN how END AS match,
        CASE WHEN len(ids) = 1 AND bases = ['alternate'] THEN 'alternate' ELSE 'primary' END AS basis, coalesce(len(ids), 0) AS n_candidates, ids
        FROM v_printed p LEFT JOIN v_text_hit USING (test_text)""",
    "v_stripped": r"SELECT *, trim(regexp_replace(trim(value_text), '\*+$', '')) AS t FROM v_matched",
    "v_compared": r"""SELECT *, CASE WHEN t LIKE '<=%' OR t LIKE '=<%' OR t LIKE '≤%' THEN '<=' WHEN t LIKE '>=%' OR t LIKE '=>%' OR t LIKE '≥%' THEN '>='
          WHEN t LIKE '<%' THEN '<' WHEN t LIKE '>%' THEN '>' WHEN regexp_matches(t, '(?i)^(less\s+than|below|upto|up\s+to)\s+') THEN '<'
          WHEN regexp_matches(t, '(?i)^(more\s+than|greater\s+than|above)\s+') THEN '>' END AS comparator,
        trim(regexp_replace(t, '(?i)^(<=|=<|≤|>=|=>|≥|<|>|less\s+than\s|below\s|upto\s|up\s+to\s|more\s+than\s|greater\s+than\s|above\s)\s*', '')) AS rest FROM v_stripped""",
    "v_valued": f"""SELECT *, CASE WHEN regexp_matches(rest, '{_NUMBER}') THEN CAST(replace(replace(rest, ',', ''), '+', '') AS DOUBLE) END AS number FROM v_compared""",
    "v_unit": f"SELECT analyte_id, {_unit_key('unit')} AS ukey, arg_min(factor, unit_order) AS factor, arg_min(offset_by, unit_order) AS offset_by FROM d_conversion GROUP BY ALL",
    "v_converted": f"""SELECT *, CASE WHEN status = 'extracted' THEN {_round("(number * factor + offset_by) * CASE WHEN analyte_id = 'urea' AND basis = 'alternate' AND ukey NOT LIKE '%mol%' THEN 2.1437 ELSE 1 END", 6)} END AS canonical_value FROM (
        SELECT *, CASE WHEN analyte_id IS NULL AND n_candidates > 1 THEN 'needs_review' WHEN analyte_id IS NULL THEN 'not_tracked'
          WHEN number IS NULL OR analyte_id = 'egfr' OR trim(unit_text) = '' OR factor IS NULL THEN 'needs_review' ELSE 'extracted' END AS status,
        CASE WHEN analyte_id IS NULL AND n_candidates > 1 THEN 'test name matches more than one test: ' || array_to_string(ids, ', ')
          WHEN analyte_id IS NULL THEN 'test is not in the dictionary' WHEN number IS NULL THEN 'value ''' || value_text || ''' is not a number'
          WHEN analyte_id = 'egfr' THEN 'eGFR not computed yet' WHEN trim(unit_text) = '' THEN 'no unit printed for ' || analyte_name
          WHEN factor IS NULL THEN 'unit ''' || unit_text || ''' is not a known unit for ' || analyte_name
          WHEN comparator IS NOT NULL THEN 'value is censored (' || comparator || ')' ELSE '' END AS status_reason
        FROM (SELECT *, {_unit_key('unit_text')} AS ukey FROM v_valued) LEFT JOIN v_unit USING (analyte_id, ukey) LEFT JOIN d_analyte USING (analyte_id))""",
    "v_junk": "SELECT * FROM v_converted WHERE status = 'not_tracked' AND trim(unit_text) = '' AND trim(range_text) = ''",
    "v_kept": "SELECT * FROM v_converted WHERE NOT (status = 'not_tracked' AND trim(unit_text) = '' AND trim(range_text) = '')",
}


def _egfr(rows: str) -> str:
    """Rows with eGFR recomputed from the creatinine rows of the same report."""
    return f"""SELECT r.* EXCLUDE (canonical_value, status, comparator, status_reason),
        CASE WHEN mine THEN CASE WHEN refusal IS NULL THEN round(142 * pow(least(c / kappa, 1), alpha) * pow(greatest(c / kappa, 1), -1.2)
          * pow(0.9938, age) * CASE WHEN sex = 'female' THEN 1.012 ELSE 1 END, 2) END ELSE canonical_value END AS canonical_value,
        CASE WHEN mine THEN CASE WHEN refusal IS NULL THEN 'extracted' ELSE 'needs_review' END ELSE status END AS status,
        CASE WHEN NOT mine THEN comparator END AS comparator, CASE WHEN mine THEN refusal ELSE status_reason END AS status_reason
        FROM (SELECT r.*, coalesce(analyte_id = 'egfr' AND r.status <> 'rejected', false) AS mine, year(collected_at) - birth_year AS age, sex, cv AS c,
          CASE sex WHEN 'female' THEN 0.7 ELSE 0.9 END AS kappa, CASE sex WHEN 'female' THEN -0.241 ELSE -0.302 END AS alpha,
          CASE WHEN clo IS NULL THEN 'eGFR is recomputed from creatinine, but this report has no usable creatinine'
            WHEN clo <> chi THEN 'report has more than one creatinine value; cannot tell which one eGFR uses'
            WHEN collected_at IS NULL THEN 'report date needed to compute age for eGFR' WHEN ccomp IS NOT NULL THEN 'creatinine is censored; eGFR cannot be computed'
            WHEN cv <= 0 THEN 'creatinine must be above 0 to compute eGFR'
            WHEN year(collected_at) - birth_year NOT BETWEEN 18 AND 120 THEN 'age ' || (year(collected_at) - birth_year) || ' at the report date is outside 18-120' END AS refusal
          FROM {rows} r LEFT JOIN (SELECT report_id, min(canonical_value) AS clo, max(canonical_value) AS chi,
              arg_min(canonical_value, {{'a': page, 'b': line, 'c': observation_id}}) AS cv,
              arg_min({{'x': comparator}}, {{'a': page, 'b': line, 'c': observation_id}}).x AS ccomp
            FROM {rows} WHERE analyte_id = 'creatinine' AND canonical_value IS NOT NULL AND status IN ('extracted', 'confirmed') GROUP BY report_id) c USING (report_id)
          LEFT JOIN (SELECT report_id, collected_at, sex, birth_year FROM v_report LEFT JOIN v_patient USING (patient_id)) w USING (report_id)) r"""


CTES["v_normalised"] = _egfr("v_kept")

# A reviewer's batch: rejected, edited, chosen, marked not tracked, and one added line per report.
CTES["v_edit"] = """SELECT observation_id, arg_min({'reject': reject, 'v': v, 'u': u, 'sets': sets, 'a': a}, {'r': reject, 'v': coalesce(v, ''), 'u': coalesce(u, ''), 'a': coalesce(a, '')}) AS e
    FROM (SELECT observation_id, k = 0 AS reject, CASE WHEN k = 1 THEN '7.5' END AS v, CASE WHEN k = 2 THEN 'mg/dL' END AS u, k IN (3, 4) AS sets,
      CASE WHEN k = 3 THEN 'fasting_glucose' END AS a FROM (SELECT *, CAST(trunc(l_quantity) AS INTEGER) % 10 AS k FROM v_printed WHERE l_returnflag = 'A')) GROUP BY observation_id"""
CTES["v_touched"] = """SELECT k.* EXCLUDE (value_text, unit_text), k.value_text AS value_text0, k.unit_text AS unit_text0, e.reject, e.sets, e.a,
    coalesce(e.v, k.value_text) AS value_text, coalesce(e.u, k.unit_text) AS unit_text FROM v_normalised k JOIN v_edit USING (observation_id)"""
CTES["v_chosen"] = r"""SELECT t.observation_id, t.report_id, t.page, t.line, t.test_text, t.value_text, t.unit_text, t.sets AND t.a IS NULL AS unmapped,
    coalesce(t.a, m.analyte_id) AS analyte_id, CASE WHEN t.a IS NOT NULL THEN 'doctor' ELSE m.match END AS match,
    CASE WHEN t.a IS NULL OR t.a = m.analyte_id THEN m.basis ELSE 'primary' END AS basis,
    CASE WHEN t.a IS NOT NULL THEN 1 ELSE m.n_candidates END AS n_candidates, trim(regexp_replace(trim(t.value_text), '\*+$', '')) AS t
    FROM v_touched t JOIN v_matched m USING (observation_id) WHERE NOT t.reject AND m.line = t.line AND m.report_id = t.report_id
    UNION ALL SELECT NULL, r.report_id, 1, 1, 'Sodium', '140', 'mEq/L', false, 'sodium', 'exact', 'primary', 1, '140' FROM v_report r
    WHERE NOT EXISTS (SELECT 1 FROM v_normalised n WHERE n.report_id = r.report_id AND n.page = 1 AND n.line = 1)"""
CTES["v_rechosen"] = f"""SELECT *, CASE WHEN ok THEN {_round("(number * factor + offset_by) * CASE WHEN analyte_id = 'urea' AND basis = 'alternate' AND ukey NOT LIKE '%mol%' THEN 2.1437 ELSE 1 END", 6)} END AS canonical_value0 FROM (
    SELECT *, number IS NOT NULL AND analyte_id <> 'egfr' AND trim(unit_text) <> '' AND factor IS NOT NULL AS ok FROM (
      SELECT *, CASE WHEN regexp_matches(rest, '{_NUMBER}') THEN CAST(replace(replace(rest, ',', ''), '+', '') AS DOUBLE) END AS number, {_unit_key('unit_text')} AS ukey
      FROM (SELECT *, regexp_replace(t, '(?i)^(<=|=<|≤|>=|=>|≥|<|>|less\\s+than\\s|below\\s|upto\\s|up\\s+to\\s|more\\s+than\\s|greater\\s+than\\s|above\\s)\\s*', '') AS rest,
        CASE WHEN t LIKE '>=%' THEN '>=' WHEN t LIKE '<%' OR t LIKE 'less than %' THEN '<' END AS comparator FROM v_chosen))
    LEFT JOIN v_unit USING (analyte_id, ukey))"""
CTES["v_reviewed"] = """SELECT observation_id, report_id, page, line, test_text, analyte_id, match, status, comparator, canonical_value, '' AS status_reason FROM v_normalised
      WHERE observation_id NOT IN (SELECT observation_id FROM v_edit)
    UNION ALL SELECT observation_id, report_id, page, line, test_text, analyte_id, match, 'rejected', comparator, NULL, '' FROM v_touched WHERE reject
    UNION ALL SELECT observation_id, report_id, page, line, test_text, CASE WHEN NOT unmapped THEN analyte_id END, CASE WHEN unmapped THEN 'doctor' ELSE match END,
      CASE WHEN unmapped OR (analyte_id IS NULL AND n_candidates <= 1) THEN 'not_tracked' WHEN ok THEN 'extracted' ELSE 'needs_review' END, comparator,
      CASE WHEN NOT unmapped THEN canonical_value0 END, '' FROM v_rechosen"""
CTES["v_review_done"] = _egfr("v_reviewed")

_pts = "SELECT * FROM v_point WHERE comparator IS NULL AND analyte_id = '{a}'"
CTES["v_history"] = f"""SELECT e.*, value AS egfr, {_G.format(v='value')} AS g, {_A.format(v='uacr')} AS a FROM (
    SELECT e.*, CASE WHEN e.date - u.date <= 365 THEN u.date END AS uacr_date, CASE WHEN e.date - u.date <= 365 THEN u.uacr END AS uacr FROM (
      {_pts.format(a='egfr')}) e ASOF LEFT JOIN (SELECT patient_id, date, arg_max(value, {{'r': report_id, 'p': page, 'l': line, 'o': observation_id}}) AS uacr
      FROM v_point WHERE comparator IS NULL AND analyte_id = 'uacr' GROUP BY ALL) u ON e.patient_id = u.patient_id AND e.date >= u.date) e"""
CTES["v_path"] = f"""SELECT *, lag(g) OVER w AS prev_g, lag(a) OVER w AS prev_a FROM v_history WHERE a IS NOT NULL WINDOW w AS (PARTITION BY patient_id ORDER BY {_ORDER})"""
CTES["v_ranked"] = f"""SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_ORDER}) AS i, row_number() OVER (PARTITION BY {_KEY} ORDER BY date DESC, report_id DESC, page DESC, line DESC, observation_id DESC) AS back
    FROM v_point WHERE comparator IS NULL"""
CTES["v_run"] = f"""SELECT {_KEY}, count(*) AS n, min(date) AS d1, max(date) AS d2, arg_min(report_id, i) AS r1, arg_max(report_id, i) AS r2 FROM (
    SELECT *, coalesce(max(i) FILTER (WHERE NOT CASE analyte_id WHEN 'egfr' THEN value < 60 ELSE value >= 30 END) OVER (PARTITION BY {_KEY}), 0) AS last_fail
    FROM v_ranked WHERE analyte_id IN ('egfr', 'uacr')) WHERE i > last_fail GROUP BY ALL HAVING count(*) >= 2 AND max(date) - min(date) > 90"""
CTES["v_ckd"] = f"""SELECT patient_id, ne, nu, list_sort(list_distinct(list_filter([r1e, r2e, r1u, r2u], lambda x: x IS NOT NULL))) AS rids, r1e IS NOT NULL OR r1u IS NOT NULL AS met, last_egfr FROM (
    SELECT patient_id, count(*) FILTER (WHERE analyte_id = 'egfr') AS ne, count(*) FILTER (WHERE analyte_id = 'uacr') AS nu,
      max(value) FILTER (WHERE analyte_id = 'egfr' AND back = 1) AS last_egfr FROM v_ranked WHERE analyte_id IN ('egfr', 'uacr') GROUP BY 1) p
    LEFT JOIN (SELECT patient_id, max(r1) FILTER (WHERE analyte_id = 'egfr') AS r1e, max(r2) FILTER (WHERE analyte_id = 'egfr') AS r2e,
      max(r1) FILTER (WHERE analyte_id = 'uacr') AS r1u, max(r2) FILTER (WHERE analyte_id = 'uacr') AS r2u FROM v_run GROUP BY 1) USING (patient_id)"""
CTES["v_c_ckd"] = """SELECT patient_id, 'ckd_kdigo' AS criterion_id, 'CKD (KDIGO definition)' AS title,
    CASE WHEN met THEN 'met' WHEN ne < 2 AND nu < 2 THEN 'not enough data' ELSE 'not met' END AS status,
    CASE WHEN met AND last_egfr IS NOT NULL THEN 'ICD-10-CM ' || CASE """ + _G.format(v="last_egfr").split("CASE ", 1)[1].replace(
    "'G1'", "'N18.1'").replace("'G2'", "'N18.2'").replace("'G3a'", "'N18.31'").replace("'G3b'", "'N18.32'").replace("'G4'", "'N18.4'").replace(
    "'G5'", "'N18.5'") + """ || '; SNOMED CT 709044004' ELSE '' END AS codes, array_to_string(rids, ',') AS report_ids, ['chronic kidney disease', 'ckd'] AS names FROM v_ckd"""
CTES["v_hits"] = f"""SELECT {_KEY}, count(*) FILTER (WHERE high) AS hits, max(report_id) FILTER (WHERE high AND h = 1) AS h1, max(report_id) FILTER (WHERE high AND h = 2) AS h2,
    max(value) FILTER (WHERE back = 1) AS lastv, max(report_id) FILTER (WHERE back = 1) AS lastr FROM (
    SELECT *, row_number() OVER (PARTITION BY {_KEY}, high ORDER BY {_ORDER}) AS h FROM (SELECT *, CASE analyte_id WHEN 'hba1c' THEN value >= 6.5 ELSE value >= 126 END AS high
    FROM v_ranked WHERE analyte_id IN ('hba1c', 'fasting_glucose'))) GROUP BY ALL"""
CTES["v_diab"] = """SELECT p.patient_id, coalesce(a.hits, 0) >= 2 AS by_a, coalesce(a.hits, 0) < 2 AND coalesce(f.hits, 0) >= 2 AS by_f,
    coalesce(a.hits, 0) < 2 AND coalesce(f.hits, 0) < 2 AND coalesce(a.lastv >= 5.7 AND a.lastv < 6.5 AND a.hits = 0, false) AS pre,
    a.h1 AS a1, a.h2 AS a2, f.h1 AS f1, f.h2 AS f2, a.lastr FROM (SELECT DISTINCT patient_id FROM v_hits) p
    LEFT JOIN v_hits a ON a.patient_id = p.patient_id AND a.analyte_id = 'hba1c' LEFT JOIN v_hits f ON f.patient_id = p.patient_id AND f.analyte_id = 'fasting_glucose'"""
CTES["v_c_diabetes"] = """SELECT patient_id, 'diabetes_ada' AS criterion_id, CASE WHEN pre THEN 'Prediabetes range (ADA)' ELSE 'Diabetes (ADA criteria)' END AS title,
    CASE WHEN by_a OR by_f OR pre THEN 'met' ELSE 'not met' END AS status, CASE WHEN pre THEN 'ICD-10-CM R73.03' WHEN by_a OR by_f THEN 'ICD-10 E11; SNOMED CT 44054006' ELSE '' END AS codes,
    array_to_string(list_sort(list_distinct(CASE WHEN by_a THEN [a1, a2] WHEN by_f THEN [f1, f2] WHEN pre THEN [lastr] ELSE [] END)), ',') AS report_ids,
    CASE WHEN pre THEN ['prediabetes'] ELSE ['type 2 diabetes', 'type 1 diabetes', 'type 2 diabetes mellitus', 'diabetes'] END AS names FROM v_diab"""
CTES["v_thyroid"] = """SELECT t.patient_id, t.value AS v, t.report_id AS r, f.value AS f, f.report_id AS fr FROM (SELECT * FROM v_ranked WHERE analyte_id = 'tsh' AND back = 1) t
    LEFT JOIN (SELECT patient_id, date, arg_max(value, i) AS value, arg_max(report_id, i) AS report_id FROM v_ranked WHERE analyte_id = 'free_t4' GROUP BY ALL) f
    ON f.patient_id = t.patient_id AND f.date = t.date"""
CTES["v_c_thyroid"] = """SELECT patient_id, 'thyroid_pattern' AS criterion_id, CASE WHEN v > 4.0 AND f < 0.8 THEN 'Overt primary hypothyroidism pattern' WHEN v > 4.0 THEN 'Subclinical hypothyroidism pattern'
    WHEN v < 0.4 AND f > 1.8 THEN 'Overt hyperthyroidism pattern' ELSE 'Thyroid results within range' END AS title,
    CASE WHEN v > 4.0 OR (v < 0.4 AND f > 1.8) THEN 'met' ELSE 'not met' END AS status, CASE WHEN v > 4.0 AND f < 0.8 THEN 'ICD-10 E03.9; SNOMED CT 40930008' ELSE '' END AS codes,
    array_to_string(list_sort(list_distinct(list_filter([r, fr], lambda x: x IS NOT NULL))), ',') AS report_ids, ['hypothyroidism', 'hyperthyroidism'] AS names FROM v_thyroid"""
CTES["v_c_potassium"] = """SELECT patient_id, 'hyperkalaemia' AS criterion_id, 'Potassium above 5.0 mmol/L' AS title, 'met' AS status, 'ICD-10 E87.5' AS codes,
    report_id::VARCHAR AS report_ids, ['hyperkalaemia', 'hyperkalemia'] AS names FROM v_ranked WHERE analyte_id = 'potassium' AND back = 1 AND value > 5.0"""
CTES["v_criterion"] = " UNION ALL ".join(f"SELECT * FROM v_c_{c}" for c in ("ckd", "diabetes", "thyroid", "potassium"))
CTES["v_active"] = """SELECT patient_id, drug_class, coalesce(arg_max(x, o) FILTER (WHERE x.change = 'start'), arg_min(x, o) FILTER (WHERE x.change = 'dose_change')) AS e FROM (
    SELECT patient_id, drug_class, {'event_id': event_id, 'date': date, 'change': change, 'generic': generic, 'drug': drug} AS x, {'d': date, 'i': event_id} AS o,
      max({'d': date, 'i': event_id}) FILTER (WHERE change = 'stop') OVER (PARTITION BY patient_id, drug_class) AS stopped FROM v_drug WHERE drug_class <> 'unknown')
    WHERE stopped IS NULL OR o > stopped GROUP BY ALL"""
CTES["v_latest"] = f"SELECT {_KEY}, value, date FROM v_ranked WHERE back = 1"
CTES["v_current"] = f"SELECT patient_id, arg_max({{'g': g, 'a': a}}, {{'d': date, 'r': report_id, 'p': page, 'l': line, 'o': observation_id}}) AS k FROM v_history GROUP BY 1"


def _is(icds: list[str], *more: str) -> str:
    names = [n for icd in icds for n in _cond[icd]] + list(more)
    return f"list_has_any(conds, [{', '.join(_lit(n) for n in names)}])"


def _last(a: str) -> str:
    return f"(SELECT value FROM v_latest l WHERE l.patient_id = p.patient_id AND l.analyte_id = '{a}')"


def _on(c: str) -> str:
    return f"EXISTS (SELECT 1 FROM v_active x WHERE x.patient_id = p.patient_id AND x.drug_class = '{c}' AND x.e IS NOT NULL)"


def _met(cid: str, title: str = "") -> str:
    return f"EXISTS (SELECT 1 FROM v_criterion c WHERE c.patient_id = p.patient_id AND c.criterion_id = '{cid}' AND c.status = 'met' AND c.title LIKE '{title}%')"


CTES["v_context"] = f"""SELECT *, ckd_rec OR ckd_met AS ckd, dm_rec OR dm_met AS dm, CASE WHEN ckd_rec OR ckd_met THEN round_even(25 * weight_kg / 10, 0) * 10 END AS elo,
    CASE WHEN ckd_rec OR ckd_met THEN round_even(35 * weight_kg / 10, 0) * 10 END AS ehi FROM (
    SELECT p.patient_id, sex, weight_kg, {_is(['N18'])} AS ckd_rec, {_met('ckd_kdigo')} AS ckd_met, {_is(['E11', 'E10'], 'diabetes')} AS dm_rec, {_met('diabetes_ada', 'Diabetes')} AS dm_met,
      {_met('diabetes_ada', 'Prediabetes')} AS pre, {_is(['I10'])} AS htn, {_is(['E78.5'])} AS lip_rec, {_is(['E03.9'])} AS thy_rec, (SELECT k.g FROM v_current h WHERE h.patient_id = p.patient_id) AS g,
      {_last('potassium')} AS k, {_last('ldl')} AS ldl, {_last('triglycerides')} AS tg, {_on('acei_arb')} AS ace, {_on('biguanide')} AS met, {_on('thyroid_hormone')} AS levo FROM v_patient p)"""


def _figure(where: str, group: str, rec: str, item: str, figure: str, amount: str = "NULL", high: str = "NULL", unit: str = "''", sup: str = "NULL") -> str:
    return (f"SELECT patient_id, '{group}' AS group_id, {rec} AS group_recorded, '{item}' AS item_id, {figure} AS figure, CAST({amount} AS DOUBLE) AS amount, "
            f"CAST({high} AS DOUBLE) AS amount_high, {unit} AS unit, CAST({sup} AS VARCHAR) AS superseded_by FROM v_context WHERE {where}")


_low = "coalesce(g IN ('G3a', 'G3b', 'G4', 'G5'), false)"
_re = "round_even({}, 0)"
CTES["v_figure"] = " UNION ALL ".join([
    _figure("ckd", "kidney", "ckd_rec", "protein_ckd", f"CASE WHEN {_low} OR dm THEN '0.8 g per kg body weight per day' ELSE 'no more than 1.3 g per kg body weight per day' END",
            _re.format(f"(CASE WHEN {_low} OR dm THEN 0.8 ELSE 1.3 END)::DOUBLE * weight_kg"), unit=f"CASE WHEN {_low} OR dm THEN 'g/day' ELSE 'g/day (upper limit)' END"),
    _figure("ckd AND weight_kg IS NOT NULL", "kidney", "ckd_rec", "energy_ckd", "'25–35 kcal per kg body weight per day'", "elo", "ehi", "'kcal/day'"),
    _figure("ckd", "kidney", "ckd_rec", "sodium", "'less than 2 g of sodium per day (less than 5 g of salt)'", "2.0", unit="'g sodium/day (upper limit)'"),
    _figure("ckd AND k IS NOT NULL", "kidney", "ckd_rec", "potassium_ckd", "CASE WHEN k > 5.0 THEN 'an individualised dietary potassium plan (no fixed figure)' ELSE 'no fixed limit at this value; dietary potassium limits are tied to potassium above 5.0 mmol/L' END"),
    _figure("pre AND NOT dm_rec", "glucose", "false", "weight_prediabetes", "'a 7% loss of initial body weight'", "round_even(0.07::DOUBLE * weight_kg / 0.5, 0) * 0.5", unit="'kg (total)'"),
    _figure("dm AND NOT (pre AND NOT dm_rec)", "glucose", "dm_rec", "mnt_diabetes", "'no single ideal split; an individualised meal plan (medical nutrition therapy)'"),
    _figure("dm AND NOT (pre AND NOT dm_rec)", "glucose", "dm_rec", "fibre", "'at least 14 g per 1,000 kcal, from minimally processed high-fibre foods'", _re.format("14 * elo / 1000"), _re.format("14 * ehi / 1000"), "'g/day'"),
    _figure("dm AND NOT (pre AND NOT dm_rec)", "glucose", "dm_rec", "drinks", "'water or no-calorie drinks in place of sugar-sweetened drinks'"),
    _figure("dm AND NOT (pre AND NOT dm_rec) AND met", "glucose", "dm_rec", "b12_metformin", "'long-term metformin is associated with vitamin B12 deficiency; periodic B12 measurement'"),
    _figure("htn AND NOT ckd", "pressure", "true", "sodium", "'optimal below 1.5 g of sodium per day, or at least 1 g per day less than current intake'", "1.5", unit="'g sodium/day (optimal)'"),
    _figure("htn", "pressure", "true", "dash", "'DASH: fruit, vegetables, whole grains and low-fat dairy, with less saturated and total fat'"),
    _figure("htn", "pressure", "true", "potassium_htn", "'3.5–5 g of potassium per day from food'", "3.5", "5.0", "'g/day'", "CASE WHEN ckd THEN 'kidney' END"),
    _figure("htn", "pressure", "true", "alcohol", "CASE WHEN sex = 'male' THEN 'no more than 2 standard drinks per day (men)' ELSE 'no more than 1 standard drink per day (women)' END", "CASE WHEN sex = 'male' THEN 2 ELSE 1 END", unit="'drinks/day (upper limit)'"),
    _figure("coalesce(ldl > 100, false) OR lip_rec", "lipids", "lip_rec", "sat_fat", "'less than 10% of daily energy (about 22 g at 2,000 kcal)'", _re.format("0.1::DOUBLE * elo / 9"), _re.format("0.1::DOUBLE * ehi / 9"), "'g/day (upper limit)'"),
    _figure("tg >= 150", "lipids", "lip_rec", "triglycerides", "'less added sugar, refined carbohydrate and alcohol; more fibre and n-3 fatty acids'"),
    _figure("levo", "thyroid", "thy_rec", "levo_timing", "'on an empty stomach, 60 minutes before breakfast, or at bedtime 3 or more hours after the evening meal'"),
    _figure("levo", "thyroid", "thy_rec", "levo_supplements", "'calcium and iron supplements taken about 4 hours apart from levothyroxine'"),
])
_fixed_figures = {(g, i, f, t, "; ".join(dict(d.table(d.FIGURE_SOURCES))[k.strip()] for k in keys.split(";"))) for g, i, case, t, f, _, keys in d.table(d.FIGURES)
                  if i != "protein_ckd" or not case}
_protein = {k: v for k, v in d.table(d.FIGURE_SOURCES)}
CTES["v_end"] = f"""SELECT {_KEY}, count(*) AS n, max(value) FILTER (WHERE back = 1) AS lastv, max(date) FILTER (WHERE back = 1) AS lastd, max(report_id) FILTER (WHERE back = 1) AS lastr,
    max(value) FILTER (WHERE i = 1) AS firstv, max(date) FILTER (WHERE i = 1) AS firstd, max(report_id) FILTER (WHERE i = 1) AS firstr FROM v_ranked GROUP BY ALL"""
CTES["v_figure_source"] = f"""SELECT f.patient_id, f.group_id, f.item_id, coalesce(t.title, 'Protein') AS title,
    CASE WHEN t.source IS NOT NULL THEN t.source ELSE concat_ws('; ', CASE WHEN {_low} THEN {_lit(_protein['kdigo_protein'])} END, CASE WHEN dm THEN {_lit(_protein['kdigo_diabetes'])} END) END AS source,
    CASE WHEN e.lastr IS NULL THEN '' ELSE e.lastr::VARCHAR END AS report_ids
    FROM v_figure f JOIN v_context c USING (patient_id)
    LEFT JOIN (VALUES {', '.join('(' + ', '.join(map(_lit, row)) + ')' for row in sorted(_fixed_figures))}) t(group_id, item_id, figure, title, source) ON t.group_id = f.group_id AND t.item_id = f.item_id AND t.figure = f.figure
    LEFT JOIN v_end e ON e.patient_id = f.patient_id AND e.analyte_id = CASE f.item_id WHEN 'protein_ckd' THEN CASE WHEN {_low} THEN 'egfr' END WHEN 'potassium_ckd' THEN 'potassium'
      WHEN 'weight_prediabetes' THEN 'hba1c' WHEN 'mnt_diabetes' THEN 'hba1c' WHEN 'drinks' THEN 'hba1c' WHEN 'potassium_htn' THEN CASE WHEN ckd OR ace OR k > 5.0 THEN 'potassium' END
      WHEN 'sat_fat' THEN CASE WHEN ldl > 100 THEN 'ldl' END WHEN 'triglycerides' THEN 'triglycerides' WHEN 'levo_timing' THEN 'tsh' WHEN 'levo_supplements' THEN 'tsh' END"""
CTES["v_figure_group"] = """SELECT patient_id, 'kidney' AS group_id, 'Kidney (CKD)' AS group_label, ckd_rec AS rec FROM v_context WHERE ckd
    UNION ALL SELECT patient_id, 'glucose', CASE WHEN pre AND NOT dm_rec THEN 'Prediabetes range' ELSE 'Diabetes' END, CASE WHEN dm_rec OR NOT pre THEN dm_rec END FROM v_context WHERE dm OR pre
    UNION ALL SELECT patient_id, 'pressure', 'Blood pressure (hypertension)', true FROM v_context WHERE htn
    UNION ALL SELECT patient_id, 'lipids', 'Lipids', CASE WHEN lip_rec THEN true END FROM v_context WHERE lip_rec OR ldl > 100 OR tg >= 150
    UNION ALL SELECT patient_id, 'thyroid', 'Thyroid (hypothyroidism)', thy_rec FROM v_context WHERE levo"""
CTES["v_figure_basis"] = """SELECT patient_id, group_id, group_label, 'latest result' AS kind, analyte_id AS name, round(lastv, 6) AS value, lastd AS date, lastr AS report_id, true AS cited FROM v_figure_group
      JOIN (VALUES ('kidney', 'egfr'), ('kidney', 'uacr'), ('glucose', 'hba1c'), ('lipids', 'ldl'), ('lipids', 'triglycerides'), ('lipids', 'hdl'), ('thyroid', 'tsh')) w(group_id, analyte_id) USING (group_id) JOIN v_end USING (patient_id, analyte_id)
    UNION ALL SELECT patient_id, group_id, group_label, 'first result', analyte_id, round(firstv, 6), firstd, firstr, group_id <> 'thyroid' FROM v_figure_group
      JOIN (VALUES ('kidney', 'egfr'), ('glucose', 'hba1c'), ('thyroid', 'tsh')) w(group_id, analyte_id) USING (group_id) JOIN v_end USING (patient_id, analyte_id) WHERE n >= 2 AND group_label <> 'Prediabetes range'
    UNION ALL SELECT patient_id, group_id, group_label, 'drug', coalesce(e.generic, e.drug), NULL, e.date, NULL, true FROM v_figure_group
      JOIN (VALUES ('glucose', 'biguanide'), ('glucose', 'sglt2i'), ('pressure', 'acei_arb'), ('thyroid', 'thyroid_hormone')) w(group_id, drug_class) USING (group_id) JOIN v_active USING (patient_id, drug_class)
      WHERE e IS NOT NULL AND group_label <> 'Prediabetes range'
    UNION ALL SELECT patient_id, group_id, group_label, 'no result on file', w.analyte_id, NULL, NULL, NULL, true FROM v_figure_group g JOIN (VALUES ('kidney', 'egfr'), ('glucose', 'hba1c')) w(group_id, analyte_id) USING (group_id)
      ANTI JOIN v_end n ON n.patient_id = g.patient_id AND n.analyte_id = w.analyte_id WHERE group_label <> 'Prediabetes range'
    UNION ALL SELECT patient_id, group_id, group_label, 'category', concat_ws(' ', k.g, k.a), NULL, NULL, NULL, true FROM v_figure_group JOIN v_current USING (patient_id) WHERE group_id = 'kidney'
    UNION ALL SELECT patient_id, group_id, group_label, CASE WHEN rec THEN 'recorded' WHEN group_id = 'thyroid' THEN 'not recorded' ELSE 'criterion met, not recorded' END, NULL, NULL, NULL, NULL, true FROM v_figure_group WHERE rec IS NOT NULL"""
CTES["v_label"] = """SELECT patient_id, report_id, collected_at, lab, row_number() OVER (PARTITION BY patient_id ORDER BY collected_at NULLS FIRST, report_id) AS n FROM v_report WHERE status = 'confirmed'"""
CTES["v_flag_count"] = """SELECT patient_id, analyte_id, count(*) FILTER (WHERE level = 'guideline') AS guideline, count(*) FILTER (WHERE level = 'change' AND effect_text IS NULL) AS change,
    count(*) FILTER (WHERE level = 'change' AND effect_text IS NOT NULL) AS expected FROM v_flag GROUP BY ALL"""
CTES["v_rdate"] = "SELECT DISTINCT patient_id, collected_at AS d FROM v_report WHERE status = 'confirmed'"
CTES["v_dates"] = """SELECT p.patient_id, list_sort(list(d) FILTER (WHERE d IS NOT NULL)) AS ds FROM v_patient p LEFT JOIN v_rdate USING (patient_id) GROUP BY 1"""
CTES["v_slv"] = "SELECT patient_id, ds[-2] AS ps, ds[-1] AS pe FROM v_dates WHERE len(ds) >= 2"
CTES["v_my_flag"] = "SELECT f.* FROM v_flag_id f JOIN v_slv USING (patient_id) WHERE date > ps AND date <= pe"
CTES["v_my_point"] = "SELECT x.* FROM v_point x JOIN v_slv USING (patient_id) WHERE date BETWEEN ps AND pe"
CTES["v_my_resp"] = "SELECT x.* FROM v_resp x JOIN v_slv USING (patient_id) WHERE date BETWEEN ps AND pe"
CTES["v_my_report"] = "SELECT x.* FROM v_report x JOIN v_slv USING (patient_id) WHERE status = 'confirmed' AND collected_at BETWEEN ps AND pe"
CTES["v_evidence"] = f"""SELECT f.patient_id, flag_id, 'to' AS role, p.date, observation_id, report_id FROM v_flag_id f JOIN v_point p USING ({_KEY}, date) WHERE comparator IS NULL AND rule_id <> 'KDIGO_RAPID_EGFR'
    UNION ALL SELECT f.patient_id, flag_id, 'from', p.date, observation_id, report_id FROM v_flag_id f JOIN v_point p ON p.patient_id = f.patient_id AND p.analyte_id = f.analyte_id
      AND p.comparator IS NULL AND p.date BETWEEN f.rfirst AND f.rlast"""
CTES["v_used"] = f"""SELECT patient_id, report_id FROM v_my_report
    UNION SELECT e.patient_id, report_id FROM v_evidence e JOIN v_my_flag f ON f.patient_id = e.patient_id AND f.flag_id = e.flag_id
    UNION SELECT p.patient_id, report_id FROM v_point p JOIN v_base b ON b.patient_id = p.patient_id AND b.analyte_id = p.analyte_id AND p.date BETWEEN bfirst AND blast
      JOIN (SELECT DISTINCT {_KEY} FROM v_my_point) m ON m.patient_id = p.patient_id AND m.analyte_id = p.analyte_id WHERE p.comparator IS NULL
    UNION SELECT p.patient_id, report_id FROM v_point p JOIN v_my_resp r ON r.patient_id = p.patient_id AND r.analyte_id = p.analyte_id AND p.date = r.after_date WHERE p.comparator IS NULL
    UNION SELECT p.patient_id, report_id FROM v_point p JOIN (SELECT e.{_KEY.replace(', ', ', e.')}, d.date, row_number() OVER (PARTITION BY e.event_id, e.analyte_id ORDER BY d.date DESC) AS rn
        FROM v_my_resp e JOIN v_since s ON s.patient_id = e.patient_id AND s.analyte_id = e.analyte_id AND s.date = e.date
        JOIN v_day d ON d.patient_id = e.patient_id AND d.analyte_id = e.analyte_id AND d.date <= e.date AND e.date - d.date <= 180 AND (s.since IS NULL OR d.date > s.since)) b
      ON b.patient_id = p.patient_id AND b.analyte_id = p.analyte_id AND b.date = p.date AND rn <= 3 WHERE p.comparator IS NULL"""
CTES["v_tagged"] = """SELECT report_id, line, test_text, value_text, unit_text, CASE report_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, 'family ' || (report_id % 10) AS layout_family,
    len(list_filter(string_split(test_text, ' '), lambda x: x <> '')) AS nt, len(list_filter(string_split(value_text, ' '), lambda x: x <> '')) AS nv,
    len(list_filter(string_split(unit_text, ' '), lambda x: x <> '')) AS nu, len(list_filter(string_split(range_text, ' '), lambda x: x <> '')) AS nr FROM v_printed"""
# Spans of gold and predicted tags. The tagger drops the unit of a starred value and takes the first word of a ">" value for a range.
CTES["v_gold"] = """SELECT split, report_id, line, kind, a, b FROM (SELECT *, unnest([{'kind': 'TEST', 'a': 1, 'b': nt}, {'kind': 'VALUE', 'a': nt + 1, 'b': nt + nv},
    {'kind': 'UNIT', 'a': nt + nv + 1, 'b': nt + nv + nu}, {'kind': 'RANGE', 'a': nt + nv + nu + 1, 'b': nt + nv + nu + nr}], recursive := true) FROM v_tagged) WHERE b >= a"""
CTES["v_predicted"] = """SELECT g.split, g.report_id, g.line, CASE WHEN kind = 'VALUE' AND value_text LIKE '>%' THEN 'RANGE' ELSE kind END AS kind, a,
    CASE WHEN kind = 'VALUE' AND value_text LIKE '>%' THEN a ELSE b END AS b FROM v_gold g JOIN v_tagged t USING (report_id, line) WHERE NOT (kind = 'UNIT' AND value_text LIKE '%*%')"""
CTES["v_panel"] = f"""SELECT l_orderkey AS report_id, CASE WHEN l_linestatus = 'O' THEN 'CBC' ELSE 'LFT' END AS panel, l_quantity AS value,
    CASE WHEN l_linestatus = 'O' THEN {_pick('l_partkey % 13', d.lists(d.PANELS)['CBC'])} ELSE {_pick('l_partkey % 9', d.lists(d.PANELS)['LFT'])} END AS test_id FROM lineitem"""
CTES["d_requires"] = _values([(t, n) for t, ns in d.lists(d.REQUIRES).items() for n in ns], "test_id, needed_id")
CTES["d_synonym"] = _values([(a, n) for a in _own for n in d.lists(d.SYNONYMS)[a] + d.lists(d.ALTERNATE_NAMES).get(a, [])], "analyte_id, synonym")
CTES["v_text_line"] = """SELECT doc_id, CAST(pos // 40 + 1 AS INTEGER) AS page, CAST(pos % 40 + 1 AS INTEGER) AS line, text, 40.0::DOUBLE + (pos % 40) * 12.0::DOUBLE AS top
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""
CTES["v_word"] = r"""SELECT doc_id, page, text, 30.0::DOUBLE + pos * 60.0::DOUBLE AS x0, 30.0::DOUBLE + pos * 60.0::DOUBLE + least(length(text) * 6, 56) AS x1, top + pos % 3 AS top, top + pos % 3 + 9 AS bottom
    FROM (SELECT doc_id, page, top, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos FROM (
      SELECT *, list_filter(regexp_split_to_array(text, '[ \t]+'), lambda x: x <> '') AS w FROM v_text_line))"""
CTES["v_top"] = "SELECT DISTINCT doc_id, page, top FROM v_word"
CTES["v_header_line"] = f"""SELECT o_orderkey AS doc_id, {_DATE} AS d, o_orderkey % 7 AS form, o_orderkey % 5 AS lab_form FROM orders"""

_said = r"'(^|[^A-Za-z0-9.])(\d+(?:\.\d+)?)', 2"


def _written() -> str:
    """Sentences of the adapter, with the marks replaced."""
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    text = "CASE o_orderkey % {n} {whens} END".format(n=len(A.SENTENCES), whens=" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(A.SENTENCES)))
    tenths = f"(({cents} + 5) // 10)"
    for mark, value in (("{v}", f"({tenths} // 10) || '.' || ({tenths} % 10)"), ("{w}", f"({cents} // 100) || '.' || lpad(({cents} % 100)::VARCHAR, 2, '0') || '7'"), ("{n}", "(o_orderkey % 23 + 1)::VARCHAR")):
        text = f"replace({text}, '{mark}', {value})"
    return f"SELECT o_orderkey AS report_id, o_custkey AS patient_id, ({cents} // 100) || '.' || lpad(({cents} % 100)::VARCHAR, 2, '0') AS fact, {text} AS text FROM orders"


CTES["v_written"] = _written()
CTES["v_read"] = "SELECT report_id, line, " + " || ".join(["''"] + [
    f"CASE WHEN trim({c}) = '' THEN '' ELSE {sep} || trim(regexp_replace({c}, ' +', ' ', 'g')) END" for c, sep in
    (("test_text", "''"), ("value_text", "' '"), ("unit_text", "' '"), ("range_text", "' '"))]) + " AS t FROM v_printed"
CTES["v_all_text"] = "SELECT 'sentence' AS kind, report_id AS id, text FROM v_written UNION ALL SELECT 'document', doc_id, text FROM documents"
CTES["v_patient_text"] = """SELECT 'sentence' AS kind, report_id AS id, patient_id, 'History of ' || array_to_string(conditions, ' and ') || '; ' || coalesce(lab, 'no lab')
      || ' saw kidney disease progress, asthma and hypertension, and a score due to LAB A.' AS text FROM v_report JOIN v_patient USING (patient_id)
    UNION ALL SELECT 'document', doc_id, doc_id, text FROM documents"""
CTES["v_phrase"] = r"""SELECT patient_id, '(?i)' || array_to_string(list_transform(list_reverse_sort(list_transform(list_filter(list_distinct(list_concat(conditions, coalesce(labs, []))),
      lambda x: x <> ''), lambda x: {'n': length(x), 'p': x})), lambda x: '\Q' || x.p || '\E'), '|') AS pattern, len(list_concat(conditions, coalesce(labs, []))) AS n
    FROM v_patient LEFT JOIN (SELECT patient_id, list(DISTINCT lab) FILTER (WHERE lab IS NOT NULL) AS labs FROM v_report GROUP BY 1) USING (patient_id)"""
CTES["v_answer"] = """SELECT answer_id, patient_id, CASE WHEN form = 1 THEN content[:-10] ELSE content END AS content FROM (
    SELECT 'report ' || report_id AS answer_id, w.patient_id, report_id % 7 AS form,
      '{"key_finding":{"text":"' || text || '","report_ids":[' || CASE WHEN report_id % 7 = 5 THEN '' ELSE '"R' || (report_id % 23 + 1) || '"' END || ']},"sections":'
      || CASE WHEN report_id % 7 = 2 THEN '"none"' ELSE '[{"title":"Results that worked","sentences":[{"text":"' || text || '","report_ids":["R1","R' || (report_id % 23 + 1)
        || '"]},{"text":"Plain.","report_ids":[]}]}]' END
      || ',"medication_rows":[{"date":"' || date || '","drug":"' || CASE WHEN report_id % 7 = 6 THEN 'Warfarin' ELSE drug END || ' daily","dose":"","observed":"stable"}]'
      || CASE WHEN report_id % 7 = 3 THEN '' ELSE ',"data_notes":["One value is poor."]' END || '}' AS content
    FROM v_written w JOIN v_event e ON e.event_id = w.report_id)
    UNION ALL SELECT 'turn ' || conv_id || ' ' || turn, conv_id, CASE WHEN role = 'user' THEN text ELSE
      json_object('key_finding', json_object('text', coalesce(text, ''), 'report_ids', ['R1']), 'sections', json_array(), 'medication_rows', json_array(), 'data_notes', ['no notes'])::VARCHAR END
    FROM conversations"""
CTES["v_judged"] = """SELECT *, CASE WHEN NOT coalesce(json_valid(content), false) THEN 'the answer is not valid JSON'
      WHEN json_type(content, '$.key_finding') IS DISTINCT FROM 'OBJECT' OR json_type(content, '$.sections') IS DISTINCT FROM 'ARRAY'
        OR json_type(content, '$.medication_rows') IS DISTINCT FROM 'ARRAY' OR json_type(content, '$.data_notes') IS DISTINCT FROM 'ARRAY' THEN 'the JSON does not match the schema' END AS error
    FROM v_answer"""
_texts_of_answer = [("'key_finding'", "$.key_finding.text", "$.key_finding.report_ids"), ("'section 1 title'", "$.sections[0].title", None)]
_texts_of_answer += [(f"'section 1 sentence {j + 1}'", f"$.sections[0].sentences[{j}].text", f"$.sections[0].sentences[{j}].report_ids") for j in range(2)]
_texts_of_answer += [(f"'medication row 1 {c}'", f"$.medication_rows[0].{c}", None) for c in ("date", "drug", "dose", "observed")]
_texts_of_answer += [("'data note 1'", "$.data_notes[0]", None)]
CTES["v_shown"] = " UNION ALL ".join(
    f"SELECT answer_id, patient_id, {place} AS place, json_extract_string(content, '{path}') AS text, "
    + (f"CAST(json_extract(content, '{cited}') AS VARCHAR[])" if cited else "CAST(NULL AS VARCHAR[])") + " AS cited FROM v_judged WHERE error IS NULL"
    for place, path, cited in _texts_of_answer)


def _number_check(said: str, facts: str, keys: str, out: str) -> str:
    """Numbers of ``said`` rows that are no fact number and no rounding of one."""
    return f"""WITH RECURSIVE said AS (SELECT DISTINCT {out}, unnest(regexp_extract_all(text, {_said})) AS said FROM {said}),
    fact AS (SELECT DISTINCT {keys}, unnest(regexp_extract_all(text, {_said})) AS f FROM {facts}),
    parts AS (SELECT *, CASE WHEN contains(f, '.') THEN length(f) - instr(f, '.') ELSE 0 END AS k, ltrim(replace(f, '.', ''), '0') AS digits FROM fact),
    cut AS (SELECT {keys}, f, k, j, CAST('0' || digits AS HUGEINT) AS whole, CAST(pow(10::DOUBLE, k - j) AS HUGEINT) AS step FROM parts, range(13) t(j) WHERE j <= k),
    form AS (SELECT {keys}, j, unnest([(whole + step // 2) // step, CASE WHEN step > 1 AND (whole % step) * 2 = step AND (whole // step) % 2 = 0 THEN whole // step ELSE (whole + step // 2) // step END]) AS n FROM cut),
    allowed AS (SELECT DISTINCT {keys}, CASE WHEN j = 0 THEN n::VARCHAR ELSE (n // CAST(pow(10::DOUBLE, j) AS HUGEINT))::VARCHAR || '.' || lpad((n % CAST(pow(10::DOUBLE, j) AS HUGEINT))::VARCHAR, j::INTEGER, '0') END AS number FROM form)
    SELECT s.* FROM (SELECT *, regexp_replace(said, '^0+(\\d)', '\\1') AS number FROM said) s ANTI JOIN allowed USING ({keys}, number)"""


_RE_BANNED = d.BANNED_WORDS.replace("'", "''")
_RE_CAUSAL = d.CAUSAL_WORDS.replace("'", "''")
_RE_BRANDS = r"\b(" + "|".join(r"\s*".join(b.split(" ")) for b in d.LAB_BRANDS) + r")\b"


def _periods(kind: str, start: str, end: str, reason: str) -> str:
    return (f"SELECT patient_id, '{kind}' AS kind, CASE WHEN reason IS NULL THEN {start} END AS period_start, CASE WHEN reason IS NULL THEN {end} END AS period_end, reason "
            f"FROM (SELECT *, CASE WHEN ds IS NULL THEN 'no confirmed report yet' {reason} END AS reason FROM v_dates)")


def _criterion(c: str) -> str:
    return f"SELECT patient_id, title, status, codes, report_ids FROM v_c_{c}"


def _round6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


FINAL: dict[str, str] = {
    "day_values": f"SELECT {_KEY}, date, {_round6('value')}, n_values, lab_lo, lab_hi, first_report, last_report FROM v_day",
    "rcv_prev_flags": f"SELECT {_KEY}, date, pdate AS prev_date, {_round6('value')}, round(pvalue, 6) AS prev_value, change_percent, direction, cross_lab, target_direction FROM v_prev_flag",
    "lab_change": f"SELECT {_KEY}, date, from_lab, to_lab, agrees AS same_lab_agrees, other_date AS same_lab_date FROM v_lab_change WHERE changed",
    "baselines": f"SELECT {_KEY}, {_round6('baseline')}, note AS baseline_note, baseline_n, bfirst AS baseline_first, blast AS baseline_last FROM v_base",
    "rcv_baseline_flags": f"SELECT {_KEY}, date, {_round6('value', 'baseline')}, change_percent, direction, cross_lab, target_direction FROM v_base_flag",
    "events_since_baseline": f"SELECT e.patient_id, e.analyte_id, f.date AS flag_date, event_id, drug_class, change, e.date AS event_date FROM v_effect e JOIN v_base_flag f ON f.patient_id = e.patient_id AND f.analyte_id = e.analyte_id AND e.date > blast AND e.date <= f.date",
    "trend_status": f"SELECT *, CASE WHEN n_days = 0 THEN 'censored values only' WHEN n_days < 2 THEN 'insufficient data' ELSE 'ok' END AS trend_status FROM (SELECT {_KEY}, count(*) AS n_points, count(comparator) AS n_censored, CAST(count(DISTINCT date) FILTER (WHERE comparator IS NULL) AS INTEGER) AS n_days FROM v_point GROUP BY ALL)",
    "drug_resolve": "SELECT event_id, patient_id, drug, change, date, drug_class, generic FROM v_drug",
    "effect_windows": f"SELECT event_id, {_KEY}, direction, window_start, window_end FROM v_window",
    "points_in_window": "SELECT observation_id, p.patient_id, p.analyte_id, p.date, event_id FROM v_point p JOIN v_window w ON w.patient_id = p.patient_id AND w.analyte_id = p.analyte_id AND p.date BETWEEN window_start AND window_end",
    "window_cover": f"SELECT p.patient_id, p.analyte_id, p.date, count(w.event_id) AS n_windows FROM (SELECT DISTINCT {_KEY}, date FROM v_point) p LEFT JOIN v_window w ON w.patient_id = p.patient_id AND w.analyte_id = p.analyte_id AND p.date BETWEEN window_start AND window_end GROUP BY ALL",
    "expected_effect": f"SELECT {_KEY}, rule_id, date, effect_event, effect_class, effect_text AS expected_effect, effect_from, effect_to FROM v_flag WHERE effect_text IS NOT NULL",
    "slopes": f"SELECT {_KEY}, n_points, first_used, last_used, n_excluded, CAST(span_days AS INTEGER) AS span_days, per_year, slope_status FROM v_slope",
    "kdigo_rapid_flags": f"SELECT {_KEY}, date, first_used AS ref_first, per_year, n_points, CAST(span_days AS INTEGER) AS span_days, cross_lab, target_direction FROM v_rapid",
    "projection": f"""SELECT {_KEY}, threshold, category, last_used AS from_date, round(at_last, 2) AS from_value, round(b, 3) AS per_year, round(b - margin, 3) AS per_year_low, round(b + margin, 3) AS per_year_high,
        last_used + CAST(round_even(gap / -b * 365.25, 0) AS INTEGER) AS date, last_used + CAST(round_even(gap / -(b - margin) * 365.25, 0) AS INTEGER) AS date_earliest,
        CASE WHEN b + margin < 0 AND gap / -(b + margin) * 365.25 < 2900000 THEN last_used + CAST(round_even(gap / -(b + margin) * 365.25, 0) AS INTEGER) END AS date_latest,
        CASE WHEN b + margin >= 0 THEN 'may not fall' WHEN gap / -(b + margin) * 365.25 < 2900000 THEN 'dated' ELSE 'beyond the calendar' END AS latest_status, n_points FROM v_projection""",
    "last_test": f"SELECT {_KEY}, date, months AS interval_months, DATE '{A.AS_OF}' - date AS days_since, DATE '{A.AS_OF}' - date > round_even(months * 365.25 / 12, 0) AS longer_than_interval FROM (SELECT {_KEY}, max(date) AS date FROM v_point GROUP BY ALL) JOIN ({_values(d.TEST_INTERVAL_MONTHS.items(), 'analyte_id, months')}) USING (analyte_id)",
    "all_flags": "SELECT patient_id, flag_id, level, direction, effect_event, target_direction, cross_lab FROM v_flag_id",
    "flag_evidence": "SELECT * FROM v_evidence",
    "result_table": f"""SELECT observation_id, {_KEY}, date, round((value - pv) / nullif(pv, 0) * 100, 4) AS change_vs_previous, n_windows,
        CASE WHEN comparator IS NULL AND date >= first_used THEN 'Yes' WHEN n_windows > 0 THEN 'Drug window' WHEN date < first_used THEN 'Before drug windows' ELSE 'No' END AS in_trend
        FROM (SELECT p.*, lag(value) OVER (PARTITION BY {_KEY} ORDER BY {_ORDER}) AS pv, (SELECT count(*) FROM v_window w WHERE w.patient_id = p.patient_id AND w.analyte_id = p.analyte_id AND p.date BETWEEN window_start AND window_end) AS n_windows FROM v_point p)
        LEFT JOIN (SELECT {_KEY}, first_used FROM v_slope) USING ({_KEY})""",
    "noise_band": f"""SELECT {_KEY}, round(rcv_percent / sqrt(2), 4) AS noise_percent, round(bl * (1 + CASE WHEN lastv < bl THEN -1 ELSE 1 END * rcv_percent / 100), 7) AS threshold_line
        FROM (SELECT {_KEY}, {_round('baseline', 4)} AS bl FROM v_base) JOIN (SELECT {_KEY}, arg_max(value, {{'a': date, 'b': report_id, 'c': page, 'd': line, 'e': observation_id}}) AS lastv FROM v_point GROUP BY ALL) USING ({_KEY}) JOIN d_analyte USING (analyte_id) WHERE rcv_percent IS NOT NULL""",
    "no_single_step": f"SELECT patient_id, flag_id FROM v_flag_id f WHERE rule_id = 'KDIGO_RAPID_EGFR' AND NOT EXISTS (SELECT 1 FROM v_flag s WHERE s.patient_id = f.patient_id AND s.analyte_id = f.analyte_id AND s.rule_id = 'RCV_PREV' AND s.effect_text IS NULL AND s.date >= f.rfirst)",
    "med_response": f"""SELECT event_id, {_KEY}, status, CAST(n_before AS INTEGER) AS n_before, {_round6('before_mean', 'after_value')}, after_date, change_percent, beyond_rcv, cross_lab, effect_shown, target_direction, verdict,
        (SELECT count(*) FROM v_drug o WHERE o.patient_id = r.patient_id AND o.event_id <> r.event_id AND o.date BETWEEN r.date - 90 AND r.until) AS n_confounders FROM v_resp r""",
    "confounders": "SELECT r.event_id, analyte_id, o.event_id AS other_event, o.drug AS other_drug, o.change AS other_change, CAST(o.date - r.date AS INTEGER) AS days_from_event FROM v_resp r JOIN v_drug o ON o.patient_id = r.patient_id AND o.event_id <> r.event_id AND o.date BETWEEN r.date - 90 AND r.until",
    "verdict_rollup": "SELECT patient_id, event_id, count(*) AS judged, count(*) FILTER (WHERE verdict = 'seen') AS seen FROM v_resp WHERE verdict IS NOT NULL GROUP BY ALL",
    "parse_values": "SELECT report_id, line, value_text, number, comparator FROM v_valued",
    "name_match": "SELECT report_id, line, test_text, analyte_id, match, basis, CAST(n_candidates AS INTEGER) AS n_candidates FROM v_matched",
    "unit_convert": "SELECT report_id, line, analyte_id, canonical_value, status, status_reason FROM v_converted",
    "egfr_recompute": "SELECT report_id, line, canonical_value, status, CASE WHEN status = 'needs_review' THEN status_reason END AS refusal FROM v_normalised WHERE analyte_id = 'egfr'",
    "status_counts": "SELECT report_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("extracted", "needs_review", "not_tracked", "confirmed", "rejected", "skipped"))
        + " FROM (SELECT report_id, status FROM v_normalised UNION ALL SELECT report_id, 'skipped' FROM v_junk) GROUP BY 1",
    "review_positions": "SELECT report_id, line, status, row_number() OVER (PARTITION BY report_id ORDER BY CASE WHEN status = 'not_tracked' THEN 1 ELSE 0 END, page, line) AS position FROM v_normalised",
    "plausible_events": f"SELECT patient_id, count(*) AS n_events, max(date) AS latest FROM v_event JOIN v_patient USING (patient_id) WHERE year(date) >= birth_year AND date <= DATE '{A.AS_OF}' GROUP BY 1",
    "file_dedup_per_owner": "SELECT doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1 AS accepted FROM documents",
    "owned_reports": "SELECT doctor_id, count(*) AS n_reports FROM v_report JOIN v_patient USING (patient_id) GROUP BY 1",
    "document_list": "SELECT source AS patient_id, doc_id AS document_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS position FROM documents",
    "skipped_results": "SELECT report_id, line, test_text, 'test name not in the dictionary and no unit or range printed: not a lab result' AS status_reason FROM v_junk",
    "hl_flags": "SELECT observation_id, analyte_id, sex, CASE WHEN value > high THEN 'H' WHEN value < low THEN 'L' ELSE '' END AS range_flag, CASE WHEN value < xlow OR value > xhigh THEN 'extreme' WHEN value < low OR value > high THEN 'abnormal' ELSE 'normal' END AS value_class FROM v_point JOIN v_patient USING (patient_id) JOIN d_range USING (analyte_id, sex)",
    "printed_units": "SELECT observation_id, u AS unit_text, round((value - offset_by) / factor, 5) AS printed_value FROM (SELECT *, CASE analyte_id WHEN 'creatinine' THEN 'µmol/L' WHEN 'hba1c' THEN 'mmol/mol' WHEN 'ldl' THEN 'mmol/L' WHEN 'fasting_glucose' THEN 'mmol/L' ELSE 'mg/g' END AS u FROM v_point) p LEFT JOIN d_conversion c ON c.analyte_id = p.analyte_id AND c.unit = p.u",
    "review_apply": "SELECT report_id, line, test_text, analyte_id, match, status, canonical_value FROM v_review_done",
    "confirm_gate": "SELECT report_id, CASE WHEN pending = 0 THEN 'confirmed' ELSE status END AS status, pending FROM (SELECT r.report_id, r.status, count(*) FILTER (WHERE o.status = 'needs_review') AS pending FROM v_report r LEFT JOIN v_review_done o USING (report_id) GROUP BY ALL)",
    "plausible_reports": f"SELECT patient_id, count(*) AS n_reports, max(collected_at) AS latest FROM v_report JOIN v_patient USING (patient_id) WHERE year(collected_at) >= birth_year AND collected_at <= DATE '{A.AS_OF}' GROUP BY 1",
    "file_dedup": "SELECT doc_id, sha, accepted, CASE WHEN accepted THEN '' ELSE 'this file was already uploaded' END AS reason FROM (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AND text NOT IN (SELECT text FROM benchmark) AS accepted FROM documents)".replace("sha,", "sha AS sha256,", 1),
    "delete_documents": """SELECT 'documents' AS kind, report_id, 1::BIGINT AS n FROM v_report JOIN orders ON o_orderkey = report_id WHERE NOT (o_orderstatus = 'F' AND status <> 'confirmed')
        UNION ALL SELECT 'reports', report_id, 1 FROM v_report JOIN orders ON o_orderkey = report_id WHERE NOT (o_orderstatus = 'F' AND status <> 'confirmed')
        UNION ALL SELECT 'refused', report_id, 1 FROM v_report JOIN orders ON o_orderkey = report_id WHERE o_orderstatus = 'F' AND status = 'confirmed'
        UNION ALL SELECT 'observations', v_obs.report_id, count(*) FROM v_obs LEFT JOIN v_report USING (report_id) LEFT JOIN orders ON o_orderkey = v_obs.report_id WHERE NOT coalesce(o_orderstatus = 'F' AND v_report.status <> 'confirmed', false) GROUP BY 2""",
    "kdigo_history": f"SELECT patient_id, observation_id, date, {_round6('egfr')}, g, uacr_date, {_round6('uacr')}, a FROM v_history",
    "kdigo_path": "SELECT patient_id, observation_id, date, g, a, prev_g, prev_a FROM v_path WHERE prev_g IS NULL OR g <> prev_g OR a <> prev_a",
    "kdigo_grid": "SELECT patient_id, g, a, count(*) AS n_results, min(date) AS first_date, max(date) AS last_date FROM v_history WHERE a IS NOT NULL GROUP BY ALL",
    "ckd_criterion": _criterion("ckd"), "diabetes_criterion": _criterion("diabetes"), "thyroid_pattern": _criterion("thyroid"), "potassium_criterion": _criterion("potassium"),
    "criteria_recorded": "SELECT patient_id, criterion_id, title, status, list_has_any(conds, names) AS recorded FROM v_criterion JOIN v_patient USING (patient_id)",
    "condition_codes": "SELECT patient_id, CAST(i - 1 AS INTEGER) AS position, c AS condition, icd10, snomed, CASE WHEN icd10 IS NULL THEN 'not in the code table' ELSE 'unverified' END AS code_status FROM (SELECT patient_id, unnest(conditions) AS c, generate_subscripts(conditions, 1) AS i FROM v_patient) LEFT JOIN d_condition ON condition_key = lower(c)",
    "test_codes": f"SELECT DISTINCT {_KEY}, analyte_name, loinc FROM v_point JOIN d_analyte USING (analyte_id)",
    "active_drugs": "SELECT patient_id, drug_class, e.event_id, e.date, e.change, e.generic FROM v_active WHERE e IS NOT NULL",
    "criterion_sources": "SELECT patient_id, criterion_id, title, status, CASE criterion_id " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in d.CRITERION_SOURCES.items()) + " END AS source, report_ids FROM v_criterion SEMI JOIN v_patient USING (patient_id)",
    "figures": "SELECT * FROM v_figure",
    "figure_sources": "SELECT * FROM v_figure_source",
    "figure_basis": "SELECT * FROM v_figure_basis",
    "figure_groups": "SELECT patient_id, group_id, group_label, count(*) AS n_facts, bool_or(kind = 'recorded') AS recorded, coalesce(array_to_string(list_sort(list(DISTINCT report_id) FILTER (WHERE cited AND report_id IS NOT NULL)), ','), '') AS report_ids FROM v_figure_basis GROUP BY ALL",
    "system_status": """SELECT *, CASE WHEN analytes_with_data = 0 THEN 'no_data' WHEN guideline > 0 THEN 'guideline' WHEN change + expected > 0 THEN 'changed' ELSE 'stable' END AS system_status FROM (
        SELECT p.patient_id, s.system_id, count(DISTINCT x.analyte_id) AS analytes_with_data, CAST(coalesce(sum(guideline), 0) AS BIGINT) AS guideline, CAST(coalesce(sum(change), 0) AS BIGINT) AS change, CAST(coalesce(sum(expected), 0) AS BIGINT) AS expected
        FROM v_patient p CROSS JOIN d_system s LEFT JOIN (SELECT DISTINCT patient_id, analyte_id, system_id FROM v_point JOIN d_analyte USING (analyte_id)) x ON x.patient_id = p.patient_id AND x.system_id = s.system_id
        LEFT JOIN v_flag_count c ON c.patient_id = x.patient_id AND c.analyte_id = x.analyte_id GROUP BY ALL)""",
    "patient_worklist": """SELECT patient_id, doctor_id, name, coalesce(report_count, 0) AS report_count, coalesce(lab_count, 0) AS lab_count, latest_report_date, CAST(coalesce(guideline, 0) AS BIGINT) AS guideline, CAST(coalesce(change, 0) AS BIGINT) AS change, CAST(coalesce(expected, 0) AS BIGINT) AS expected
        FROM v_patient LEFT JOIN (SELECT patient_id, count(*) AS report_count, count(DISTINCT lab) AS lab_count, max(collected_at) AS latest_report_date FROM v_report WHERE status = 'confirmed' GROUP BY 1) USING (patient_id)
        LEFT JOIN (SELECT patient_id, sum(guideline) AS guideline, sum(change) AS change, sum(expected) AS expected FROM v_flag_count GROUP BY 1) USING (patient_id)""",
    "review_groups": "SELECT patient_id, CASE WHEN effect_text IS NOT NULL THEN 'expected' WHEN level = 'guideline' THEN 'guideline' ELSE 'change' END AS review_group, count(*) AS n, count(*) FILTER (WHERE agrees) AS lab_explained FROM v_flag GROUP BY ALL",
    "headline": f"""SELECT patient_id, system_id, l.date AS latest_date, round(l.value, 6) AS latest_value, comparator AS latest_comparator, report_id AS latest_report, bl AS baseline, cvb AS change_vs_baseline, per_year, {_direction('bl', '(bl * (1 + cvb / 100))')} AS target_direction
        FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY date DESC, report_id DESC, page DESC, line DESC, observation_id DESC) AS rn FROM v_point) l JOIN (SELECT system_id, headline AS analyte_id FROM d_system) USING (analyte_id)
        LEFT JOIN (SELECT {_KEY}, {_round('baseline', 4)} AS bl, CASE WHEN x.date > blast THEN {_pct('x.value', _round('baseline', 4))} END AS cvb FROM v_base JOIN v_last x USING ({_KEY})) USING ({_KEY})
        LEFT JOIN (SELECT {_KEY}, per_year FROM v_slope) USING ({_KEY}) LEFT JOIN d_target USING (analyte_id) WHERE rn = 1""",
    "report_labels": "SELECT patient_id, report_id, 'R' || n AS label FROM v_label",
    "label_runs": f"""SELECT {_KEY}, min(n) AS run_start, max(n) AS run_end, CASE WHEN max(n) > min(n) THEN 'R' || min(n) || '–R' || max(n) ELSE 'R' || min(n) END AS run_text
        FROM (SELECT {_KEY}, n, n - row_number() OVER (PARTITION BY {_KEY} ORDER BY n) AS island FROM (SELECT DISTINCT p.patient_id, analyte_id, n FROM v_point p JOIN v_label USING (patient_id, report_id))) GROUP BY {_KEY}, island""",
    "timeline": f"SELECT patient_id, analyte_order, analyte_name, loinc, unit, date, observation_id, {_round6('value')}, comparator FROM v_point JOIN d_analyte USING (analyte_id)",
    "latest_summaries": "SELECT conv_id AS patient_id, role AS period, max(turn) AS summary_id, md5(arg_max(text, turn)) AS text_md5 FROM conversations GROUP BY ALL",
    "periods": " UNION ALL ".join([
        _periods("all", "ds[1]", "ds[-1]", ""), _periods("since_last_visit", "ds[-2]", "ds[-1]", "WHEN len(ds) < 2 THEN 'needs confirmed reports on two dates'"),
        _periods("range", "DATE '2015-06-01'", "DATE '2015-12-31'", "WHEN len(list_filter(ds, lambda x: x BETWEEN DATE '2015-06-01' AND DATE '2015-12-31')) = 0 THEN 'no confirmed report in this range'")]),
    "facts_per_section": f"""SELECT patient_id, section, count(*) AS n_facts FROM (
        SELECT patient_id, unnest(['patient', 'period', 'note']) AS section FROM v_slv UNION ALL SELECT patient_id, 'flag' FROM v_my_flag
        UNION ALL SELECT patient_id, 'result' FROM (SELECT DISTINCT {_KEY}, date FROM v_my_point WHERE comparator IS NULL) UNION ALL SELECT patient_id, 'limit' FROM v_my_point WHERE comparator IS NOT NULL
        UNION ALL SELECT patient_id, 'trend' FROM (SELECT DISTINCT {_KEY} FROM v_my_point) UNION ALL SELECT patient_id, 'event' FROM v_drug JOIN v_slv USING (patient_id) WHERE date BETWEEN ps AND pe
        UNION ALL SELECT patient_id, 'response' FROM v_my_resp UNION ALL SELECT patient_id, 'note' FROM v_my_report GROUP BY 1 HAVING count(DISTINCT coalesce(lab, '')) > 1
        UNION ALL SELECT patient_id, 'note' FROM (SELECT {_KEY} FROM v_my_flag UNION SELECT {_KEY} FROM v_my_resp) JOIN d_analyte USING (analyte_id) SEMI JOIN v_my_point USING ({_KEY}) WHERE rcv_status = 'unverified'
        UNION ALL SELECT DISTINCT patient_id, 'note' FROM v_my_point WHERE comparator IS NOT NULL
        UNION ALL SELECT DISTINCT patient_id, 'note' FROM v_drug JOIN v_slv USING (patient_id) WHERE change = 'start' AND date BETWEEN ps AND pe) GROUP BY ALL""",
    "used_reports": "SELECT u.patient_id, u.report_id, 'R' || n AS label FROM v_used u JOIN v_label USING (patient_id, report_id)",
    "wording_check": rf"""SELECT kind, id, lower(word) AS word, count(*) AS n FROM (SELECT kind, id, unnest(list_concat(regexp_extract_all(t, '(?i){_RE_BANNED}'), regexp_extract_all(t, '(?i){_RE_CAUSAL}'))) AS word
        FROM (SELECT kind, id, regexp_replace(text, '(?i)good news|must-have', ' ', 'g') AS t FROM v_all_text)) GROUP BY ALL""",
    "wording_per_patient": rf"""SELECT kind, id, lower(word) AS word, count(*) AS n FROM (SELECT kind, id, unnest(list_concat(regexp_extract_all(t, '(?i){_RE_BANNED}'), regexp_extract_all(t, '(?i){_RE_CAUSAL}'))) AS word
        FROM (SELECT kind, id, CASE WHEN n > 0 THEN regexp_replace(text, pattern, ' ', 'g') ELSE text END AS t FROM v_patient_text LEFT JOIN v_phrase USING (patient_id))) GROUP BY ALL""",
    "answer_problems": rf"""SELECT answer_id, 'answer' AS place, error AS problem FROM v_judged WHERE error IS NOT NULL
        UNION SELECT answer_id, place, 'key finding without text or citation' FROM v_shown WHERE place = 'key_finding' AND (coalesce(len(cited), 0) = 0 OR trim(text) = '')
        UNION SELECT answer_id, place, 'word: ' || lower(unnest(list_concat(regexp_extract_all(t, '(?i){_RE_BANNED}'), regexp_extract_all(t, '(?i){_RE_CAUSAL}'))))
          FROM (SELECT *, regexp_replace(text, '(?i)good news|must-have', ' ', 'g') AS t FROM v_shown)
        UNION SELECT answer_id, place, 'unknown report ' || label FROM (SELECT answer_id, patient_id, place, unnest(cited) AS label FROM v_shown) c
          ANTI JOIN (SELECT patient_id, 'R' || n AS label FROM v_label) l ON l.patient_id = c.patient_id AND l.label = c.label
        UNION SELECT answer_id, 'medication row 1', 'no such medication event' FROM (SELECT answer_id, patient_id, json_extract_string(content, '$.medication_rows[0].date') AS date,
            lower(json_extract_string(content, '$.medication_rows[0].drug')) AS drug FROM v_judged WHERE error IS NULL AND json_array_length(content, '$.medication_rows') > 0) m
          WHERE NOT EXISTS (SELECT 1 FROM v_event e WHERE e.patient_id = m.patient_id AND e.date::VARCHAR = m.date AND contains(m.drug, lower(e.drug)))""",
    "answer_citations": """SELECT answer_id, place, position, c.label, l.report_id FROM (SELECT answer_id, patient_id, place, unnest(cited) AS label, CAST(unnest(range(len(cited))) AS INTEGER) AS position FROM v_shown) c
        JOIN (SELECT patient_id, report_id, 'R' || n AS label FROM v_label) l ON l.patient_id = c.patient_id AND l.label = c.label""",
    "citation_check": r"SELECT w.report_id, w.label FROM (SELECT DISTINCT report_id, patient_id, unnest(regexp_extract_all(text, '\bR[1-9][0-9]*\b')) AS label FROM v_written) w ANTI JOIN (SELECT patient_id, 'R' || n AS label FROM v_label) l ON l.patient_id = w.patient_id AND l.label = w.label",
    "entity_f1": """SELECT split, kind, support, round(p, 5) AS precision, round(r, 5) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5) AS f1 FROM (
        SELECT split, coalesce(kind, 'overall') AS kind, count(g) AS support, CASE WHEN count(q) > 0 THEN count(*) FILTER (WHERE g = 1 AND q = 1) / count(q)::DOUBLE ELSE 0 END AS p,
          CASE WHEN count(g) > 0 THEN count(*) FILTER (WHERE g = 1 AND q = 1) / count(g)::DOUBLE ELSE 0 END AS r
        FROM (SELECT *, 1 AS g FROM v_gold) FULL JOIN (SELECT *, 1 AS q FROM v_predicted) USING (split, report_id, line, kind, a, b) GROUP BY GROUPING SETS ((split, kind), (split)))""",
    "entity_f1_by_family": """SELECT split, layout_family, grouping_id, kind, support, round(p, 5) AS precision, round(r, 5) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5) AS f1 FROM (
        SELECT split, layout_family, CAST(grouping(split) * 2 + grouping(layout_family) AS BIGINT) AS grouping_id, CASE WHEN grouping(kind) = 1 THEN 'overall' ELSE kind END AS kind, count(g) AS support,
          CASE WHEN count(q) > 0 THEN count(*) FILTER (WHERE g = 1 AND q = 1) / count(q)::DOUBLE ELSE 0 END AS p, CASE WHEN count(g) > 0 THEN count(*) FILTER (WHERE g = 1 AND q = 1) / count(g)::DOUBLE ELSE 0 END AS r
        FROM (SELECT *, 1 AS g FROM v_gold) FULL JOIN (SELECT *, 1 AS q FROM v_predicted) USING (split, report_id, line, kind, a, b) JOIN (SELECT report_id, 'family ' || (report_id % 10) AS layout_family FROM v_report) USING (report_id)
        GROUP BY GROUPING SETS ((split, layout_family, kind), (split, layout_family), (split, kind), (split), (kind), ()))""",
    "split_assignment": """SELECT report_id, CASE WHEN held THEN 'test' WHEN place <= CAST(floor(n * 0.1 + 0.5) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM (
        SELECT report_id, held, row_number() OVER (PARTITION BY held ORDER BY md5('7:' || report_id), report_id) AS place, count(*) OVER (PARTITION BY held) AS n
        FROM (SELECT report_id, report_id % 10 IN (1, 2) AS held FROM v_report))""",
    "second_read": """SELECT report_id, line, a.t AS first, b.t AS second, CASE WHEN b.t IS NULL THEN 'missing' WHEN a.t IS NULL THEN 'extra' ELSE 'changed' END AS change
        FROM v_read a FULL JOIN (
          SELECT report_id, line, CASE WHEN (report_id + 2 * line) % 97 = 0 THEN regexp_replace(t, '^[^ ]+', '?') ELSE t END AS t FROM v_read WHERE (report_id + line) % 101 <> 0
          UNION ALL SELECT report_id, 1000, t FROM v_read WHERE line = 1 AND report_id % 89 = 0) b USING (report_id, line) WHERE a.t IS DISTINCT FROM b.t""",
    "kdigo_totals": "SELECT g, a, sum(n) ::BIGINT AS n_results, count(DISTINCT patient_id) AS n_patients, CAST(grouping(g) * 2 + grouping(a) AS INTEGER) AS level FROM (SELECT patient_id, g, a, count(*) AS n FROM v_history WHERE a IS NOT NULL GROUP BY ALL) GROUP BY CUBE (g, a)",
    "file_intake": """SELECT doc_id, sha256, size, file_type, accepted, CASE WHEN file_type IS NULL THEN 'file type is not supported' WHEN NOT accepted THEN 'this file was already uploaded' ELSE '' END AS reason
        FROM (SELECT *, file_type IS NOT NULL AND row_number() OVER (PARTITION BY sha256, file_type IS NULL ORDER BY doc_id) = 1 AS accepted
        FROM (SELECT doc_id, sha256(content) AS sha256, octet_length(content) AS size, CASE doc_id % 5 WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' WHEN 3 THEN NULL ELSE 'pdf' END AS file_type
        FROM (SELECT doc_id, unhex(CASE doc_id % 5 WHEN 1 THEN '89504E47' WHEN 2 THEN 'FFD8FF' WHEN 3 THEN '00' ELSE '25504446' END) || encode(coalesce(text, '')) AS content FROM documents)))""",
    "stream_file_dedup": "SELECT DISTINCT sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM benchmark)",
    "bucketed_days": f"SELECT {_KEY}, date, {_round6('value')}, n_values, lag(date) OVER (PARTITION BY {_KEY} ORDER BY date) AS prev_date FROM v_day",
    "row_accuracy": """SELECT split, layout_family, count(*) AS rows, round(avg(CASE WHEN value_text LIKE '>%' OR (value_text LIKE '%*%' AND nu > 0) THEN 0 ELSE 1 END), 5) AS row_accuracy,
        round(avg(CASE WHEN value_text LIKE '>%' THEN 0 ELSE 1 END), 5) AS exact_value_accuracy FROM v_tagged GROUP BY ALL""",
    "bad_tags": "SELECT report_id, line FROM v_tagged WHERE value_text LIKE '>%' AND nv > 1",
    "pipeline_accuracy": r"""SELECT cause, count(*) AS n FROM (SELECT CASE WHEN o.analyte_id = t.truth AND abs(o.canonical_value - t.plain) <= CASE WHEN t.truth = 'egfr' THEN 1.0 ELSE 1e-6 * greatest(1.0, abs(t.plain)) END THEN 'correct'
          WHEN o.line IS NULL AND j.line IS NOT NULL THEN 'skipped: test name not in the dictionary and no unit or range printed: not a lab result' WHEN o.line IS NULL THEN 'not a result'
          WHEN o.analyte_id IS NULL AND o.status = 'needs_review' THEN 'name matches two analytes' WHEN o.analyte_id IS NULL THEN 'name not matched' WHEN o.analyte_id <> t.truth THEN 'wrong analyte'
          WHEN o.status = 'needs_review' THEN 'needs review: ' || string_split(o.status_reason, ' for ')[1] ELSE 'canonical value differs' END AS cause
        FROM (SELECT report_id, line, TRY_CAST(value_text AS DOUBLE) AS plain, CASE WHEN test_text LIKE '%reatin%' OR test_text LIKE '%REATIN%' THEN 'creatinine' WHEN test_text = 'eGFR' THEN 'egfr' WHEN test_text IN ('BUN', 'Urea Nitrogen - Serum') THEN 'urea'
            WHEN test_text LIKE '%GLUCOSE%' THEN 'fasting_glucose' WHEN test_text LIKE '%TSH%' THEN 'tsh' WHEN test_text LIKE '%potassium%' THEN 'potassium' WHEN test_text = 'Platelet Count' THEN 'platelets' WHEN test_text LIKE '%Trigly%' THEN 'triglycerides' ELSE 'hba1c' END AS truth
          FROM v_printed WHERE test_text NOT IN ('GLUCOSE', 'VLDL CHOLESTEROL', 'Age / Sex')) t LEFT JOIN v_normalised o USING (report_id, line) LEFT JOIN v_junk j USING (report_id, line)) GROUP BY 1""",
    "value_mix": "SELECT value_class, n, round(n / total, 6) AS share, abs(n / total - CASE value_class WHEN 'normal' THEN 0.65 WHEN 'abnormal' THEN 0.30 ELSE 0.05 END) <= 0.05 AS near_target FROM (SELECT value_class, count(*) AS n, sum(count(*)) OVER ()::DOUBLE AS total FROM (SELECT CASE WHEN value < xlow OR value > xhigh THEN 'extreme' WHEN value < low OR value > high THEN 'abnormal' ELSE 'normal' END AS value_class FROM v_point JOIN v_patient USING (patient_id) JOIN d_range USING (analyte_id, sex)) GROUP BY 1)",
    "split_integrity": "SELECT 'report in two splits' AS problem, report_id::VARCHAR AS item FROM v_tagged GROUP BY report_id HAVING count(DISTINCT split) > 1 UNION ALL SELECT DISTINCT CASE WHEN split = 'test' THEN 'other family in test' ELSE 'held-out family outside test' END, layout_family FROM v_tagged WHERE (layout_family IN ('family 1', 'family 2')) <> (split = 'test')",
    "coverage_anti": "SELECT analyte_id, synonym, CASE WHEN n IS NULL THEN 'never used' ELSE 'not in train' END AS gap FROM d_synonym LEFT JOIN (SELECT analyte_id, test_text AS synonym, count(*) AS n, count(*) FILTER (WHERE report_id % 10 NOT IN (0, 1)) AS t FROM v_matched GROUP BY ALL) USING (analyte_id, synonym) WHERE coalesce(t, 0) = 0",
    "rows_per_analyte": "SELECT analyte_id, coalesce(n, 0) AS n, coalesce(n, 0) >= 300 AS enough FROM d_analyte LEFT JOIN (SELECT analyte_id, count(*) AS n FROM v_matched GROUP BY 1) USING (analyte_id)",
    "forbidden_phrases": f"SELECT kind, id, phrase, count(*) AS n FROM (SELECT kind, id, lower(unnest(regexp_extract_all(text, '(?i){_RE_BRANDS}'))) AS phrase FROM v_all_text) GROUP BY ALL",
    "calculated_inputs": "SELECT DISTINCT report_id, panel, test_id, needed_id FROM v_panel JOIN d_requires USING (test_id) ANTI JOIN (SELECT report_id, panel, test_id AS needed_id FROM v_panel) USING (report_id, panel, needed_id)",
    "differentials": f"SELECT report_id, panel, count(DISTINCT test_id) AS n_parts, sum(value) AS total FROM v_panel WHERE test_id IN ({', '.join(map(_lit, d.DIFFERENTIAL))}) GROUP BY ALL HAVING count(DISTINCT test_id) <> 5 OR sum(value) <> 100",
    "panel_shares": "SELECT panel, count(*) AS n, round(count(*) FILTER (WHERE test_id NOT IN (SELECT analyte_id FROM d_analyte)) / count(*), 6) AS share FROM v_panel GROUP BY 1",
    "clinical_conflicts": """SELECT report_id, problem FROM (SELECT report_id, CASE WHEN h < 5.7 AND f > 200 THEN 'HbA1c and fasting glucose' WHEN e IS NOT NULL AND c IS NULL THEN 'eGFR without creatinine'
          WHEN abs(e - 142 * pow(least(c / kappa, 1), CASE sex WHEN 'female' THEN -0.241 ELSE -0.302 END) * pow(greatest(c / kappa, 1), -1.2) * pow(0.9938, age) * CASE sex WHEN 'female' THEN 1.012 ELSE 1 END) > 1 THEN 'eGFR and creatinine' END AS problem
        FROM (SELECT report_id, max(value) FILTER (WHERE analyte_id = 'hba1c') AS h, max(value) FILTER (WHERE analyte_id = 'fasting_glucose') AS f, max(value) FILTER (WHERE analyte_id = 'creatinine') AS c, max(value) FILTER (WHERE analyte_id = 'egfr') AS e,
            max(year(date) - birth_year) AS age, max(sex) AS sex, CASE max(sex) WHEN 'female' THEN 0.7 ELSE 0.9 END AS kappa FROM v_point JOIN v_patient USING (patient_id) GROUP BY 1)) WHERE problem IS NOT NULL""",
    "error_sample": "SELECT report_id, line AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY line) AS rn FROM v_tagged WHERE value_text LIKE '>%' OR (value_text LIKE '%*%' AND nu > 0)) WHERE rn <= 2 ORDER BY report_id, line LIMIT 10",
    "scans": "SELECT doc_id, count(*) AS n_words FROM v_word GROUP BY 1 HAVING count(*) < 5",
    "repeated_rows": "SELECT doc_id, page, line FROM v_text_line JOIN (SELECT doc_id, text, round_even(top / 2, 0) AS h FROM v_text_line GROUP BY ALL HAVING count(DISTINCT page) >= 2) r USING (doc_id, text) WHERE r.h = round_even(top / 2, 0)",
    "labelled_dates": f"""SELECT doc_id, c AS collected_at, r AS reported_at, coalesce(c, r) AS report_date, CASE WHEN c IS NOT NULL THEN 'Collected' WHEN r IS NOT NULL THEN 'Reported' END AS date_label
        FROM (SELECT doc_id, CASE WHEN form IN (0, 1, 2, 3) AND d <= DATE '{A.AS_OF}' THEN d END AS c, CASE WHEN d + 1 <= DATE '{A.AS_OF}' THEN d + 1 END AS r FROM v_header_line)""",
    "lab_names": "SELECT doc_id, CASE lab_form WHEN 0 THEN 'Vedhya Diagnostic Centre' WHEN 1 THEN 'EXAMPLE HEALTHCARE LTD' ELSE 'Sai Krupa Path Labs' END AS lab FROM v_header_line WHERE lab_form IN (0, 1, 4)",
}
_PLAIN_TEXT = lambda c: f"trim(regexp_replace({c}, ' +', ' ', 'g'))"
FINAL["assemble_tagged"] = "SELECT report_id AS doc_id, page, line + 1 AS line, " + ", ".join(
    f"{_PLAIN_TEXT(c)} AS {c}" for c in ("test_text", "value_text", "unit_text", "range_text")) + " FROM v_printed"
FINAL["ingest_observations"] = "SELECT report_id, line + 1 AS line, analyte_id, match, CASE WHEN analyte_id IS DISTINCT FROM 'egfr' THEN status END AS status, CASE WHEN analyte_id IS DISTINCT FROM 'egfr' THEN round(canonical_value, 6) END AS canonical_value FROM v_normalised"
FINAL["ingest_reports"] = f"""SELECT r.report_id, r.patient_id, l.lab, d.report_date AS collected_at, d.date_label, CASE WHEN coalesce(n, 0) + 5 < 5 THEN 'the file has no text: a scan' END AS refused
    FROM v_report r LEFT JOIN ({FINAL['labelled_dates']}) d ON d.doc_id = r.report_id LEFT JOIN ({FINAL['lab_names']}) l ON l.doc_id = r.report_id
    LEFT JOIN (SELECT report_id, sum(nt + nv + nu + nr) AS n FROM v_tagged GROUP BY 1) w ON w.report_id = r.report_id"""
FINAL["header_accuracy"] = f"""SELECT date_label, count(*) AS reports, count(*) FILTER (WHERE found AND d IS NOT DISTINCT FROM t.collected_at) AS date_correct, count(*) FILTER (WHERE found AND l IS NOT DISTINCT FROM t.lab) AS lab_correct
    FROM (SELECT report_id, collected_at, CASE report_id % 5 WHEN 0 THEN 'Vedhya Diagnostic Centre' WHEN 1 THEN 'EXAMPLE HEALTHCARE LTD' WHEN 4 THEN 'Sai Krupa Path Labs, Pune' END AS lab FROM v_report) t
    LEFT JOIN (SELECT report_id, date_label, collected_at AS d, lab AS l, true AS found FROM ({FINAL['ingest_reports']})) USING (report_id) GROUP BY date_label"""
FINAL["review_reports"] = f"""SELECT report_id, CASE WHEN dated THEN nd ELSE collected_at END AS collected_at, CASE WHEN dated THEN 'Entered by doctor' END AS date_label,
      CASE WHEN NOT bad AND nl IS NOT NULL THEN nullif(nl, '') ELSE lab END AS lab, CASE WHEN bad THEN 'the date must be between the patient''s birth year and today' END AS refused
    FROM (SELECT *, NOT bad AND nd IS NOT NULL AND nd IS DISTINCT FROM collected_at AS dated FROM (
      SELECT *, nd IS NOT NULL AND NOT coalesce(year(nd) >= birth_year AND nd <= DATE '{A.AS_OF}', false) AS bad FROM (
        SELECT report_id, patient_id, collected_at, lab, CASE WHEN k % 5 <> 0 THEN NULL WHEN k % 11 = 0 THEN DATE '1900-01-01' WHEN k % 13 = 0 THEN DATE '2030-01-01' WHEN k % 3 = 0 THEN collected_at + 7 WHEN k % 3 = 1 THEN collected_at END AS nd,
          CASE WHEN k % 5 <> 0 THEN NULL WHEN k % 4 = 0 THEN 'Lab Z' WHEN k % 4 = 1 THEN '' END AS nl FROM (SELECT *, report_id AS k FROM v_report)) LEFT JOIN v_patient USING (patient_id)))"""
FINAL["review_skipped"] = """SELECT report_id, line, test_text FROM v_junk j WHERE NOT (line = 2 AND EXISTS (SELECT 1 FROM v_report r WHERE r.report_id = j.report_id)
      AND NOT EXISTS (SELECT 1 FROM v_normalised n WHERE n.report_id = j.report_id AND n.line = 2))"""
FINAL["spurious_results"] = """SELECT report_id, line, test_text, analyte_id, status FROM v_review_done d WHERE analyte_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM v_printed p WHERE p.report_id = d.report_id AND p.line = d.line AND p.test_text NOT IN ('GLUCOSE', 'VLDL CHOLESTEROL', 'Age / Sex'))"""
FINAL["unit_coverage"] = f"""SELECT analyte_id, ukey AS unit_key, CASE WHEN n IS NULL THEN 'never used' ELSE 'not in train' END AS gap FROM (SELECT DISTINCT analyte_id, ukey FROM v_unit)
    LEFT JOIN (SELECT analyte_id, {_unit_key('unit_text')} AS ukey, count(*) AS n, count(*) FILTER (WHERE report_id % 10 NOT IN (0, 1)) AS t FROM v_matched GROUP BY ALL) USING (analyte_id, ukey) WHERE coalesce(t, 0) = 0"""
_T = d.FLAG_TEXTS
_change_text = lambda compared, before: _filled(
    _T["change"], name="analyte_name", moved="CASE direction WHEN 'rise' THEN 'rose' ELSE 'fell' END", percent="printf('%.1f', abs(change_percent))",
    compared=_lit(compared), before=_digits(before), after=_digits("value"), unit="unit", limit=_digits("rcv_percent", 6))
_check = {"lab": "CASE WHEN other_date > date THEN plo ELSE lab_lo END", "other_date": "other_date", "other": _digits("other_value")}
_check_text = (f"CASE WHEN agrees THEN {_filled(_T['lab_agrees'], **_check, ref_date='CASE WHEN other_date > date THEN pdate ELSE date END', ref=_digits('ref_value'))} "
               f"WHEN NOT agrees THEN {_filled(_T['lab_differs'], **_check)} ELSE '' END")
FINAL["flag_messages"] = f"""SELECT patient_id, 'RCV_PREV:' || analyte_id || ':' || date AS flag_id, {_change_text('previous result', 'pvalue')} AS message, source,
      CASE WHEN cross_lab THEN {_lit(_T['cross_lab'])} END AS cross_lab_note,
      CASE WHEN changed THEN {_filled(_T['lab_change'], from_lab='plo', to_lab='lab_lo')} || {_check_text} END AS lab_change_note
    FROM (SELECT *, CASE WHEN other_date > date THEN nvalue ELSE p2value END AS other_value, CASE WHEN other_date > date THEN pvalue ELSE value END AS ref_value FROM v_lab_change)
    JOIN (SELECT analyte_id, analyte_name, unit, source FROM d_analyte JOIN d_source USING (analyte_id)) USING (analyte_id)
    UNION ALL SELECT patient_id, 'RCV_BASELINE:' || analyte_id || ':' || date, {_change_text('baseline', 'baseline')}, source, CASE WHEN cross_lab THEN {_lit(_T['cross_lab'])} END, NULL
    FROM v_base_flag JOIN d_analyte USING (analyte_id) JOIN d_source USING (analyte_id)
    UNION ALL SELECT patient_id, 'KDIGO_RAPID_EGFR:' || analyte_id || ':' || date, {_filled(_T['guideline'], slope=f"printf('%.1f', {_round('abs(per_year)', 1)})", unit='unit', span='span_days', n='n_points')},
      {_lit(d.RAPID_EGFR_SOURCE)}, CASE WHEN cross_lab THEN {_lit(_T['cross_lab_slope'])} END, NULL FROM v_rapid JOIN d_analyte USING (analyte_id)"""
FINAL["lab_change_reports"] = f"""SELECT DISTINCT f.patient_id, 'RCV_PREV:' || f.analyte_id || ':' || f.date AS flag_id, other_date AS date, report_id
    FROM v_lab_change f JOIN v_point p ON p.patient_id = f.patient_id AND p.analyte_id = f.analyte_id AND p.date = other_date WHERE p.comparator IS NULL"""
FINAL["slope_exclusions"] = f"""SELECT n.patient_id, n.analyte_id, n.date, observation_id, report_id, event_id, {_filled(_T['left_out'], drug='drug', started='w.date', cutoff='window_end')} AS reason
    FROM v_numbered n JOIN (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY window_end DESC, date, event_id, drug) AS place FROM v_window) w ON w.patient_id = n.patient_id AND w.analyte_id = n.analyte_id AND place = 1
    JOIN v_point p ON p.patient_id = n.patient_id AND p.analyte_id = n.analyte_id AND p.date = n.date WHERE comparator IS NULL AND n_days >= 2 AND n.date <= cutoff"""
_before_days = CTES["v_used"].split("JOIN (SELECT e.")[1].split(") b\n")[0]
FINAL["fact_citations"] = f"""SELECT DISTINCT x.patient_id, section, fact_key, 'R' || n AS label FROM (
    SELECT e.patient_id, 'flag' AS section, e.flag_id AS fact_key, report_id FROM v_evidence e JOIN v_my_flag f ON f.patient_id = e.patient_id AND f.flag_id = e.flag_id
    UNION ALL SELECT patient_id, 'result', analyte_id || ':' || date, report_id FROM v_my_point WHERE comparator IS NULL
    UNION ALL SELECT patient_id, 'limit', observation_id, report_id FROM v_my_point WHERE comparator IS NOT NULL
    UNION ALL SELECT p.patient_id, 'baseline', p.analyte_id, report_id FROM v_point p JOIN v_base b ON b.patient_id = p.patient_id AND b.analyte_id = p.analyte_id AND p.date BETWEEN bfirst AND blast
      JOIN (SELECT DISTINCT {_KEY} FROM v_my_point) m ON m.patient_id = p.patient_id AND m.analyte_id = p.analyte_id WHERE p.comparator IS NULL
    UNION ALL SELECT p.patient_id, 'after', event_id || ':' || p.analyte_id, report_id FROM v_point p JOIN v_my_resp r ON r.patient_id = p.patient_id AND r.analyte_id = p.analyte_id AND p.date = r.after_date WHERE p.comparator IS NULL
    UNION ALL SELECT p.patient_id, 'before', event_id || ':' || p.analyte_id, report_id FROM v_point p JOIN (SELECT e.event_id, e.{_before_days}) b
      ON b.patient_id = p.patient_id AND b.analyte_id = p.analyte_id AND b.date = p.date AND rn <= 3 WHERE p.comparator IS NULL) x
    JOIN v_label l ON l.patient_id = x.patient_id AND l.report_id = x.report_id"""
FINAL["stream_refresh"] = FINAL["all_flags"]
FINAL["last_test_order"] = f"SELECT {_KEY}, row_number() OVER (PARTITION BY patient_id ORDER BY longer_than_interval DESC, days_since DESC, analyte_id) AS position FROM ({FINAL['last_test']})"
FINAL["cards_to_review"] = f"SELECT patient_id, name, report_count, guideline, change FROM ({FINAL['patient_worklist']}) WHERE doctor_id = 7 AND (contains(lower(name), 'p-1') OR contains('p-' || patient_id, 'p-1')) AND guideline + change > 0"
FINAL["cards_with_few_reports"] = f"SELECT patient_id, report_count FROM ({FINAL['patient_worklist']}) WHERE report_count < 2"
_ROWS = """WITH RECURSIVE {base}, anchor AS (SELECT doc_id, page, min(top) AS a, 1 AS line FROM v_top GROUP BY ALL
    UNION ALL SELECT x.doc_id, x.page, min(t.top), x.line + 1 FROM anchor x JOIN v_top t ON t.doc_id = x.doc_id AND t.page = x.page AND t.top > x.a + 3 GROUP BY ALL),
    placed AS (SELECT w.*, a.line FROM v_word w JOIN anchor a ON a.doc_id = w.doc_id AND a.page = w.page AND w.top BETWEEN a.a AND a.a + 3)"""
_RECURSIVE = {
    "group_rows": _ROWS + " SELECT doc_id, page, line, count(*) AS n_words, round(min(x0), 1) AS box_x0, round(min(top), 1) AS box_top, round(max(x1), 1) AS box_x1, round(max(bottom), 1) AS box_bottom FROM placed GROUP BY ALL",
    "line_pitch": _ROWS + """, lines AS (SELECT doc_id, page, line, arg_min(top, {{'x': x0, 't': top}}) AS top FROM placed GROUP BY ALL),
        gaps AS (SELECT *, top - lag(top) OVER (PARTITION BY doc_id, page ORDER BY line) AS gap FROM lines)
        SELECT doc_id, page, least(coalesce(median(gap) FILTER (WHERE gap > 3 AND gap < 40), 12.0), 2 * 9.0) AS pitch FROM gaps GROUP BY ALL""",
}
_WHOLE = {
    "number_check": _number_check(
        f"(SELECT 'sentence' AS kind, report_id AS id, text FROM ({CTES['v_written']}) UNION ALL SELECT 'conversation', conv_id, text FROM conversations WHERE role = 'assistant')",
        f"(SELECT 'sentence' AS kind, report_id AS id, fact AS text FROM ({CTES['v_written']}) UNION ALL SELECT 'conversation', conv_id, text FROM conversations WHERE role <> 'assistant')",
        "kind, id", "kind, id").replace("SELECT s.*", "SELECT kind, id, said"),
    "document_numbers": _number_check("(SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))", "(SELECT source, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))", "source", "source, doc_id").replace("SELECT s.*", "SELECT source, doc_id, said"),
}


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\b[vd]_[a-z0-9_]+\b", sql):
        if name in CTES and name not in seen:
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def _base(sql: str) -> str:
    # Many views are used several times; the other engine would work them out again each time.
    return ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in _needed(sql, []))


def _later_flags() -> str:
    """Guideline flags when every report counts as confirmed, without those there are already."""
    names = [n for n in _needed("v_rapid", []) if n.startswith("v_")]
    later = []
    for name in names:
        sql = CTES[name]
        if name == "v_report":
            sql = sql.replace("CASE WHEN o_orderpriority = '5-LOW' THEN 'extracted' ELSE 'confirmed' END AS status", "'confirmed' AS status")
        for other in names:
            sql = re.sub(rf"\b{other}\b", f"{other}_later", sql)
        later.append(f"{name}_later AS ({sql})")
    flag = "SELECT patient_id, 'KDIGO_RAPID_EGFR:' || analyte_id || ':' || date AS flag_id FROM"
    return f"WITH {_base('v_rapid')}, {', '.join(later)} {flag} v_rapid_later EXCEPT {flag} v_rapid"


def oracle_sql() -> dict[str, str]:
    out = {"new_guideline_flags": _later_flags()}
    for name, sql in FINAL.items():
        base = _base(sql)
        out[name] = f"WITH {base} {sql}" if base else sql
    for name, sql in _RECURSIVE.items():
        out[name] = sql.format(base=_base(sql))
    out.update(_WHOLE)
    out["stream_alerts"] = out["rcv_prev_flags"]
    return out
