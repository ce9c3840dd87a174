"""One DuckDB statement per registered query."""

from __future__ import annotations

import re

from casetide.catalog import (
    AS_OF_QUARTERS,
    BITMAP_RANGES,
    CLASS_INGREDIENTS,
    CLASS_NAMES,
    CUT_QUARTER,
    DRUG,
    MEDIAN_QUARTERS,
    QUARTER,
    REACTION,
)
from casetide.operators import question_log as L
from casetide.oracle import base, views

PARTS = {**base.PARTS, **views.PARTS}


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"{column} ILIKE '{p}'" for p in patterns) + ")"


def _quarters(alias: str = "quarters") -> str:
    return f"string_agg(DISTINCT quarter, ', ' ORDER BY quarter) AS {alias}"


def _keys(*sources: tuple[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", quarter, report_id, count(*) AS n FROM {source} "
        "GROUP BY quarter, report_id"
        for name, source in sources
    )


def _six(*columns: str, of: str) -> str:
    """Shares are compared to six decimals, averages to nine."""
    rounded = ", ".join(f"round({c}, {9 if c.startswith('avg_') else 6}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({rounded}) FROM {of}"


_DRIFT = "'{}' AS extended_attributes"
_KEPT_CHILD = "report_id IN (SELECT report_id FROM kept)"
_LIKE = f"ILIKE '%{DRUG}%'"

# Non-ASCII letters as x, other non-ASCII signs as blanks: RE2 knows word ends in ASCII only.
_ASCII = r"regexp_replace(regexp_replace(lower(query_text), '[^\x00-\x7F\pL\pN]', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g')"


def _route() -> str:
    whens = " ".join(
        f"WHEN regexp_matches({_ASCII}, '(?-s){p}') THEN '{L.VIEW_ROUTE}{v}'" for p, v in L.ROUTES
    )
    return f"CASE {whens} ELSE '{L.TABLE_ROUTE}' END"


def _sanitized() -> str:
    text = f"left(query_text, {L.MAX_QUESTION})"
    for pattern in L.REMOVED_FROM_QUESTIONS:
        text = f"regexp_replace({text}, '(?im-s){pattern}', '', 'g')"
    return base.blank_free(text)


def _mentions(words) -> str:
    return "(" + " OR ".join(f"contains(lower(query_text), '{w}')" for w in words) + ")"


def _fingerprint() -> str:
    text = base.blank_free(r"regexp_replace(lower(generated_sql), '\s+', ' ', 'g')")
    text = rf"regexp_replace({text}, '\blimit\s+\d+', 'limit N', 'g')"
    return rf"regexp_replace({text}, '\b\d+\b', '?', 'g')"


def _audit() -> str:
    def within(parts) -> str:
        return "(" + " OR ".join(f"contains(u, '{p.upper()}')" for p in parts) + ")"

    words = "|".join(L.BLOCKED_WORDS).upper()
    functions = "|".join(L.BLOCKED_FUNCTIONS).upper()
    allowed = ", ".join(f"'{n}'" for n in L.readable_names())
    flags = (
        "is_empty too_long cannot_answer not_select many_statements blocked_keyword "
        "blocked_schema unknown_table limit_too_high too_complex blocked_function"
    ).split()
    verdict = " ".join(f"WHEN {f} THEN '{f}'" for f in flags)
    return rf"""
      WITH s AS (
        SELECT generated_sql, regexp_replace({base.blank_free('generated_sql')}, ';+$', '') AS q
        FROM log),
      w AS (
        SELECT *, upper(q) AS u, regexp_replace(q, '''[^'']*''', ' ', 'g') AS unquoted,
               list_transform(regexp_extract_all(q, '(?i)\b(?:FROM|JOIN)\s+([a-zA-Z_][\w.]*)', 1),
                              lambda n: lower(string_split(n, '.')[-1])) AS used,
               list_transform(regexp_extract_all(q, '(?i)\b(\w+)\s+AS\s*\(', 1),
                              lambda n: lower(n)) AS own
        FROM s),
      x AS (
        SELECT *, list_sort(list_distinct(list_filter(used, lambda n:
                 NOT list_contains(own, n) AND n NOT IN ({allowed})))) AS strange FROM w),
      f AS (
        SELECT generated_sql, q = '' AS is_empty,
               length(generated_sql) > {L.MAX_SQL} AS too_long,
               starts_with(q, 'SELECT ''CANNOT_ANSWER:') AS cannot_answer,
               NOT regexp_matches(u, '^(SELECT|WITH)(\s|$)') AS not_select,
               contains(unquoted, ';') AS many_statements,
               regexp_matches(u, '\b({words})\b') OR {within(L.BLOCKED_PARTS)} AS blocked_keyword,
               {within(L.BLOCKED_SCHEMAS)} AS blocked_schema,
               len(strange) > 0 AS unknown_table,
               coalesce(list_max(list_transform(regexp_extract_all(u, '\bLIMIT\s+(\d+)', 1),
                        lambda n: n::BIGINT)), 0) > {L.MAX_LIMIT} AS limit_too_high,
               len(regexp_extract_all(u, 'SELECT')) > {L.MAX_SELECTS} AS too_complex,
               regexp_matches(u, '\b({functions})\b') AS blocked_function,
               array_to_string(strange, ',') AS unknown_tables
        FROM x)
      SELECT *, CASE {verdict} ELSE 'ok' END AS verdict FROM f"""


def _clean(table: str) -> str:
    return f"SELECT *, {_DRIFT} FROM {table}"


_CHILDREN = ("drug", "reac", "outc", "ther", "indi", "rpsr")
_STORED = (("demo", "kept"), *((t, f"(SELECT * FROM {t} WHERE {_KEPT_CHILD})") for t in _CHILDREN))
_EXPORTED = ("demo", "drug", "reac", "outc", "indi")
# Surplus fields of the ragged lines.
_EXTRA = """list_transform(range(1, report_id // 10 % 8 + 2),
    lambda j: CASE WHEN (report_id + j) % 3 = 0 THEN '' ELSE 's' || j END)"""
_OVERLONG = f"(report_id % 10 = 3 AND len(list_filter({_EXTRA}, lambda x: x <> '')) > 0)"
_RAGGED_PT = """CASE WHEN report_id % 10 = 5 THEN pt || ' "q" $'
    WHEN report_id % 10 <> 4 THEN pt END AS pt"""
_SERIOUS = "report_id IN (SELECT report_id FROM outc WHERE outc_cod IN ('DE', 'LT', 'HO'))"
_RAGGED = "report_id::VARCHAR AS report_id, caseid::VARCHAR AS caseid"

_BITMAP_VALUES = (
    ("drug", "drug", "drugname_clean", "drugname_clean <> ''"),
    ("drug_role", "drug", "drugname_clean || chr(31) || coalesce(role_cod, '')", "drugname_clean <> ''"),
    ("reaction", "reac", "pt_clean", "true"),
    ("outcome", "outc", "outc_cod", "true"),
)

# Columns of each view in alphabetical order; d: a fraction, as nine decimals.
_VIEW_COLUMNS = {
    "mv_latest_cases": "caseid report_id",
    "mv_drug_reaction_pairs": "drug_role drugname_clean prod_ai_clean quarter reaction_term report_count role_cod",
    "mv_drug_outcomes": "drugname_clean outc_cod outcome_label prod_ai_clean quarter report_count role_cod",
    "mv_death_by_drug": "death_reports drugname_clean d:pct_of_all_ps_reports prod_ai_clean quarter",
    "mv_reports_by_country": "death_count hospitalization_count life_threatening_count quarter report_count reporter_country",
    "mv_signal_prr": "drug_reaction_count drug_total drugname_clean grand_total is_signal d:prr quarter reaction_term reaction_total d:ror",
    "mv_age_sex_distribution": "age_group d:avg_age d:avg_weight_kg drugname_clean d:median_age quarter report_count sex",
    "mv_quarterly_trends": "d:avg_age deaths female_cases hospitalizations life_threatening male_cases quarter reporting_countries total_cases",
    "mv_top_drugs": "concomitant_count drugname_clean prod_ai_clean ps_count quarter report_count ss_count",
    "mv_top_reactions": "quarter reaction_term report_count",
}


def _line(columns: str) -> str:
    cells = [f"{c[2:]}::DECIMAL(28, 9)" if c.startswith("d:") else c for c in columns.split()]
    return "concat_ws('|', " + ", ".join(f"coalesce(({c})::VARCHAR, '~')" for c in cells) + ")"


def _lines(prefix: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"view\", {_line(c)} AS line FROM {prefix}{n}" for n, c in _VIEW_COLUMNS.items())


def _stored_as(where: str) -> str:
    """What the store holds: reports by their case's newest version, children with a report."""
    tables = [f"s_demo AS (SELECT * FROM kept WHERE {where})"]
    tables += [f"s_{t} AS (SELECT * FROM {t} WHERE report_id IN (SELECT report_id FROM s_demo))" for t in ("drug", "reac", "outc")]
    tables.append("s_latest AS (SELECT caseid, max(report_id) AS report_id FROM s_demo GROUP BY caseid)")
    return "WITH " + ", ".join(tables)


def _views_over(tables: str) -> str:
    named = ", ".join(f"s_{n} AS ({re.sub(r'(?<=FROM |JOIN )(demo|drug|reac|outc|latest)', r's_\1', text).replace('= drug.', '= s_drug.')})" for n, text in views.PARTS.items())
    return f"{tables}, {named} {_lines('s_')}"


def _stored_views(where: str) -> str:
    return _views_over(_stored_as(where))


def _as_of(quarter: str) -> str:
    tables = [f"s_{t} AS (SELECT * FROM {t} WHERE quarter <= '{quarter}')" for t in ("demo", "drug", "reac", "outc")]
    return "WITH " + ", ".join([*tables, "s_latest AS (SELECT caseid, max(report_id) AS report_id FROM s_demo GROUP BY caseid)"])


STATEMENTS: dict[str, str] = {
    # sources and sinks
    "discover_tables": " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS \"table\", quarter FROM raw_{t}" for t in ("demo", *_CHILDREN)
    ),
    "read_raw": """SELECT report_id::VARCHAR AS report_id, caseid::VARCHAR AS caseid, event_dt,
        age, age_cod, sex, reporter_country, quarter FROM raw_demo""",
    "skip_bad_lines": f"SELECT {_RAGGED}, {_RAGGED_PT} FROM raw_reac WHERE NOT {_OVERLONG}",
    "quarantine_rows": f"""SELECT {_RAGGED}, pt, array_to_string({_EXTRA}, '|') AS surplus
        FROM raw_reac WHERE {_OVERLONG}""",
    "normalize_header": "SELECT report_id, caseid, pt, quarter FROM raw_reac",
    "conform_schema": """SELECT report_id, caseid, drug_seq, quarter, start_dt,
        NULL::DATE AS end_dt, NULL::DOUBLE AS dur_days, NULL::VARCHAR AS extended_attributes
        FROM ther""",
    "capture_drift": """SELECT report_id, pt, '{' || concat_ws(',',
          CASE WHEN report_id % 3 = 0 THEN '"drug_rec_act":"stopped"' END,
          CASE WHEN report_id % 2 = 0 THEN '"site_note":"n' || caseid || '"' END) || '}'
          AS extended_attributes FROM raw_reac""",
    "write_quarter": _keys(*_STORED),
    "skip_loaded_quarters": f"""SELECT report_id, quarter FROM demo
        WHERE quarter >= '{CUT_QUARTER}'""",
    "reload_quarter": _keys(
        *[
            (t, f"(SELECT * FROM {source} WHERE quarter <> '{QUARTER}' OR {left})")
            for t, source in _STORED
            for left in ["false" if t == "rpsr" else "report_id % 3 <> 0"]
        ]
    ),
    "load_all_quarters": _keys(*_STORED),
    "land_quarters": _keys(*_STORED),
    "export_parquet": _keys(*((t, t) for t in _EXPORTED)),
    "read_parquet_views": " UNION ALL ".join(
        f"SELECT 'kept_{t}' AS \"view\", quarter, count(*) AS n FROM {t} GROUP BY quarter"
        for t in _EXPORTED
    ),
    "loaded_quarters": "SELECT DISTINCT quarter FROM demo ORDER BY 1",
    "load_metadata": """
        SELECT quarter, sum(demo)::BIGINT AS demo_rows, sum(drug)::BIGINT AS drug_rows,
               sum(reac)::BIGINT AS reac_rows, sum(outc)::BIGINT AS outc_rows,
               count(*) AS total_rows, 1.5e0 AS load_seconds, 'mapped' AS data_source_url
        FROM (SELECT quarter, 1 AS demo, 0 AS drug, 0 AS reac, 0 AS outc FROM raw_demo
              UNION ALL SELECT quarter, 0, 1, 0, 0 FROM raw_drug
              UNION ALL SELECT quarter, 0, 0, 1, 0 FROM raw_reac
              UNION ALL SELECT quarter, 0, 0, 0, 1 FROM raw_outc
              UNION ALL SELECT quarter, 0, 0, 0, 0 FROM raw_ther
              UNION ALL SELECT quarter, 0, 0, 0, 0 FROM raw_indi
              UNION ALL SELECT quarter, 0, 0, 0, 0 FROM raw_rpsr) GROUP BY 1""",
    "refresh_views": _lines(),
    "refresh_views_after_quarter": _stored_views("true"),
    "refresh_views_after_correction": _stored_views(f"quarter <> '{QUARTER}' OR report_id % 3 <> 0"),
    "merged_medians": f"""{_stored_as("true")}
        SELECT drugname_clean, sex, count(*) AS rows, round({base.mean('age_years')}, 9) AS avg_age,
               round(quantile_cont(age_years, 0.5), 6) AS median_age
        FROM s_drug g JOIN s_demo m USING (report_id)
        WHERE role_cod = 'PS' AND drugname_clean <> '' AND g.report_id IN (SELECT report_id FROM s_latest)
          AND age_years IS NOT NULL AND g.quarter IN {MEDIAN_QUARTERS} GROUP BY 1, 2""",
    "case_history": """
        SELECT r.caseid, r.report_id, r.quarter AS known_from,
               (SELECT min(x.quarter) FROM demo x WHERE x.caseid = r.caseid AND x.report_id > r.report_id) AS known_until
        FROM demo r WHERE NOT EXISTS (SELECT 1 FROM demo y WHERE y.caseid = r.caseid
              AND y.report_id > r.report_id AND y.quarter <= r.quarter)""",
    "cases_as_of": " UNION ALL ".join(
        f"""SELECT '{q}' AS as_of, count(*) AS cases, sum(report_id)::BIGINT AS report_sum,
            count(*) FILTER ({_SERIOUS}) AS serious
        FROM (SELECT max(report_id) AS report_id FROM demo WHERE quarter <= '{q}' GROUP BY caseid)"""
        for q in AS_OF_QUARTERS
    ),
    "views_as_of": _views_over(_as_of(QUARTER)),
    # cleaning
    "parse_event_date": f"SELECT report_id, event_dt, {base.day('event_dt')} AS event_date FROM raw_demo",
    "age_to_years": f"SELECT report_id, age, age_cod, {base.years('age', 'age_cod')} AS age_years FROM raw_demo",
    "weight_to_kg": f"SELECT report_id, wt, wt_cod, {base.kilos('wt', 'wt_cod')} AS weight_kg FROM raw_demo",
    "duration_to_days": f"""SELECT report_id, drug_seq, dur, dur_cod,
        round({base.days('dur', 'dur_cod')}, 6) AS dur_days FROM raw_ther""",
    "clean_sex": "SELECT report_id, sex AS sex_clean FROM demo",
    "age_group": "SELECT report_id, age_group FROM demo",
    "clean_drug_name": f"""SELECT report_id, drug_seq, drugname,
        {base.name('drugname')} AS drugname_clean FROM raw_drug""",
    "clean_ingredient": "SELECT report_id, drug_seq, prod_ai_clean FROM drug",
    "clean_route": "SELECT report_id, drug_seq, route_clean FROM drug",
    "drug_role_label": "SELECT report_id, drug_seq, role_cod, drug_role FROM drug",
    "outcome_label": "SELECT report_id, outc_cod, outcome_label FROM outc",
    "clean_term": "SELECT report_id, drug_seq, indi_pt, indi_pt_clean FROM indi",
    "coerce_keys": """SELECT report_id, caseid, drug_seq::BIGINT AS drug_seq FROM raw_ther
        WHERE report_id % 5 < 3""",
    "tag_quarter": "SELECT report_id, rpsr_cod, '2026q1' AS quarter FROM raw_rpsr",
    "clean_demo": "SELECT * FROM demo",
    "clean_drug": _clean("drug"),
    "clean_reac": _clean("reac"),
    "clean_outc": _clean("outc"),
    "clean_ther": _six("dur_days", of="ther"),
    "clean_indi": _clean("indi"),
    "clean_rpsr": _clean("rpsr"),
    "parse_quarter": _keys(("demo", "kept"), *((t, f"raw_{t}") for t in _CHILDREN)),
    "resolve_generic": """SELECT report_id, drug_seq, drugname_clean, generic_name, atc_code
        FROM drug LEFT JOIN mappings ON brand = drugname_clean""",
    # filters
    "drug_search": """SELECT report_id, drug_seq, drugname_clean, prod_ai_clean FROM drug
        WHERE drugname_clean ILIKE '%d_ring%' OR prod_ai_clean ILIKE '%d_ring%'""",
    "reaction_search": f"SELECT report_id, pt_clean FROM reac WHERE pt_clean ILIKE '%{REACTION}%'",
    "ilike_any": f"""SELECT report_id, drug_seq, drugname_clean FROM drug
        WHERE {_any('drugname_clean', CLASS_NAMES)}""",
    "role_filter": "SELECT report_id, drug_seq, role_cod FROM drug WHERE role_cod = 'SS'",
    "quarter_filter": f"""SELECT report_id, quarter FROM demo
        WHERE quarter IN ('{QUARTER}', '1999q4')""",
    "nonempty_filter": """SELECT report_id, drug_seq, drugname_clean FROM drug
        WHERE drug_seq NOT IN (1, 2)""",
    "signal_filter": """SELECT drugname_clean, reaction_term, quarter, prr FROM mv_signal_prr
        WHERE is_signal""",
    "serious_filter": "SELECT report_id, outc_cod FROM outc WHERE outc_cod IN ('DE', 'LT', 'HO')",
    # joins
    "drug_reac_join": """SELECT drugname_clean, pt_clean, count(*) AS n
        FROM drug JOIN reac USING (report_id) GROUP BY 1, 2""",
    "drug_outc_join": """SELECT drugname_clean, outc_cod, drug.quarter, count(*) AS n
        FROM drug JOIN outc USING (report_id) GROUP BY 1, 2, 3""",
    "drug_demo_join": """SELECT drugname_clean, sex, age_group, count(*) AS n
        FROM drug JOIN demo USING (report_id) GROUP BY 1, 2, 3""",
    "latest_case_join": """SELECT report_id, drug_seq, drugname_clean FROM drug
        WHERE report_id IN (SELECT report_id FROM latest)""",
    "demo_outc_left": """SELECT m.report_id, m.quarter, sex, reporter_country, outc_cod
        FROM demo m LEFT JOIN outc o ON o.report_id = m.report_id""",
    "drug_outc_reac_left": """
        SELECT g.drugname_clean, g.quarter, count(DISTINCT g.report_id) AS report_count,
               count(DISTINCT g.report_id) FILTER (outc_cod = 'DE') AS deaths,
               count(DISTINCT (g.report_id, pt_clean)) FILTER (pt_clean IS NOT NULL) AS reactions
        FROM drug g LEFT JOIN outc o ON o.report_id = g.report_id
        LEFT JOIN reac e ON e.report_id = g.report_id GROUP BY 1, 2""",
    "serious_semi": f"SELECT report_id, drug_seq, drugname_clean, role_cod FROM drug WHERE {_SERIOUS}",
    "pair_self_join_name": """SELECT a.drugname_clean AS drug_a, b.drugname_clean AS drug_b,
        count(*) AS co_report_count FROM drug a JOIN drug b ON a.report_id = b.report_id
        AND a.drugname_clean < b.drugname_clean GROUP BY 1, 2 HAVING count(*) >= 2""",
    "pair_self_join_seq": """SELECT a.drugname_clean AS drug_1, b.drugname_clean AS drug_2,
        count(DISTINCT a.report_id) AS co_occurrence_reports FROM drug a JOIN drug b
        ON a.report_id = b.report_id AND a.drug_seq < b.drug_seq GROUP BY 1, 2
        HAVING count(DISTINCT a.report_id) >= 2""",
    "totals_cross_join": """SELECT drugname_clean, count(DISTINCT report_id) AS report_count,
        (SELECT count(DISTINCT report_id) FROM demo) AS grand_total FROM drug GROUP BY 1""",
    "stat_joins": """
        SELECT drug, reaction, drug_reaction_count, drug_total, reaction_total,
               (SELECT count(DISTINCT report_id) FROM demo) AS grand_total
        FROM (SELECT drugname_clean AS drug, pt_clean AS reaction,
                     count(DISTINCT report_id) AS drug_reaction_count
              FROM drug JOIN reac USING (report_id) WHERE role_cod = 'PS' GROUP BY 1, 2
              HAVING count(DISTINCT report_id) >= 2)
        JOIN (SELECT drugname_clean AS drug, count(DISTINCT report_id) AS drug_total
              FROM drug WHERE role_cod = 'PS' GROUP BY 1) USING (drug)
        JOIN (SELECT pt_clean AS reaction, count(DISTINCT report_id) AS reaction_total
              FROM reac GROUP BY 1) USING (reaction)""",
    "scalar_subquery": """SELECT prod_ai_clean, role_cod, count(DISTINCT report_id) AS report_count,
        round(count(DISTINCT report_id) /
          (SELECT count(DISTINCT report_id) FROM drug WHERE role_cod = 'PS') * 100, 6) AS pct_of_ps
        FROM drug GROUP BY 1, 2""",
    "correlated_scalar": """
        SELECT drugname_clean, sum(death_reports)::BIGINT AS death_reports,
               round(sum(death_reports) / (SELECT sum(report_count) FROM mv_top_drugs t
                 WHERE t.drugname_clean = m.drugname_clean) * 100, 6) AS death_rate_pct
        FROM mv_death_by_drug m GROUP BY drugname_clean""",
    "orphan_children": f"SELECT report_id, drug_seq, drugname_clean FROM drug WHERE NOT {_KEPT_CHILD}",
    "enforce_parent": f"SELECT report_id, drug_seq, drugname_clean FROM drug WHERE {_KEPT_CHILD}",
    # aggregations
    "count_rows": "SELECT role_cod, quarter, count(*) AS n FROM drug GROUP BY 1, 2",
    "count_distinct_reports": """SELECT pt_clean, quarter, count(DISTINCT report_id) AS report_count
        FROM reac GROUP BY 1, 2""",
    "bitmap_distinct": " UNION ALL ".join(
        f"SELECT '{r}' AS range, '{d}' AS dimension, {v} AS value, count(DISTINCT report_id) AS reports FROM {t} "
        f"WHERE quarter BETWEEN '{lo}' AND '{hi}' AND {v} IS NOT NULL AND {w} GROUP BY 3"
        for r, (lo, hi) in BITMAP_RANGES.items() for d, t, v, w in _BITMAP_VALUES
    ),
    "bitmap_conditions": " UNION ALL ".join(
        f"""SELECT '{r}' AS range, '{c}' AS condition, count(*) AS reports FROM (
            SELECT report_id FROM (SELECT DISTINCT report_id, drugname_clean FROM drug WHERE quarter BETWEEN '{lo}' AND '{hi}'
              AND drugname_clean IN (SELECT drugname_clean FROM drug WHERE quarter BETWEEN '{lo}' AND '{hi}' AND drugname_clean <> ''
                                     GROUP BY 1 ORDER BY count(DISTINCT report_id) DESC, 1 LIMIT 2))
            GROUP BY 1 HAVING count(*) >= {2 if c.startswith('both') else 1}) x"""
        + (f""" WHERE report_id IN (SELECT report_id FROM outc WHERE outc_cod IN ('DE', 'LT', 'HO')
              AND quarter BETWEEN '{lo}' AND '{hi}')""" if c.endswith("serious") else "")
        for r, (lo, hi) in BITMAP_RANGES.items() for c in ("both", "either", "both and serious", "either and serious")
    ),
    "conditional_distinct": """
        SELECT drugname_clean, quarter, count(DISTINCT report_id) AS report_count,
               count(DISTINCT CASE WHEN role_cod = 'PS' THEN report_id END) AS ps_count,
               count(DISTINCT CASE WHEN role_cod = 'SS' THEN report_id END) AS ss_count,
               count(DISTINCT CASE WHEN role_cod = 'C' THEN report_id END) AS concomitant_count
        FROM drug GROUP BY 1, 2""",
    "sum_of_counts": """SELECT reaction_term, sum(report_count)::BIGINT AS report_count
        FROM mv_top_reactions GROUP BY 1""",
    "avg": """SELECT sex, quarter, round(avg(age_years), 9) AS avg_age_years FROM demo
        GROUP BY 1, 2""",
    "avg_duration": "SELECT quarter, round(avg(dur_days), 9) AS avg_dur_days FROM ther GROUP BY 1",
    "median": """SELECT sex, age_group, round(median(age_years), 6) AS median_age_years
        FROM demo GROUP BY 1, 2""",
    "max_bool_or": """SELECT reaction_term, max(prr) AS prr, bool_or(is_signal) AS is_signal
        FROM mv_signal_prr GROUP BY 1""",
    "string_agg_distinct": f"""SELECT drugname_clean, {_quarters('quarter_list')} FROM drug
        GROUP BY 1""",
    "string_agg_ordered": """SELECT report_id, string_agg(drugname_clean, ' | '
        ORDER BY drug_seq, drugname_clean) AS drug_list FROM drug GROUP BY 1""",
    "having": """SELECT drugname_clean, role_cod, count(DISTINCT report_id) AS report_count
        FROM drug GROUP BY 1, 2 HAVING count(DISTINCT report_id) >= 250""",
    "select_distinct": "SELECT DISTINCT report_id, quarter FROM outc",
    "unique_terms": "SELECT count(DISTINCT pt_clean) AS unique_terms FROM reac",
    "top_k": """SELECT report_id, weight_kg, sex FROM demo
        ORDER BY weight_kg DESC NULLS LAST, report_id LIMIT 100""",
    "disproportionality": """
        SELECT *, round((a / n_drug) / (n_reac / total), 3) AS prr,
               round(a * (total - n_reac - n_drug + a)
                     / nullif((n_drug - a)::DOUBLE * (n_reac - a), 0), 3) AS ror,
               a >= 3 AND (a / n_drug) / (n_reac / total) >= 2 AS is_signal
        FROM (SELECT prod_ai_clean, pt_clean, count(DISTINCT report_id) AS a
              FROM drug JOIN reac USING (report_id) GROUP BY 1, 2 HAVING a >= 3)
        JOIN (SELECT prod_ai_clean, count(DISTINCT report_id) AS n_drug FROM drug GROUP BY 1)
          USING (prod_ai_clean)
        JOIN (SELECT pt_clean, count(DISTINCT report_id) AS n_reac FROM reac GROUP BY 1)
          USING (pt_clean), (SELECT count(DISTINCT report_id) AS total FROM demo)""",
    # versions of a case
    "dedup_versions": "SELECT report_id, caseid, caseversion, quarter FROM kept",
    "latest_cases": "SELECT caseid, report_id FROM latest",
    # standing views
    **{name: f"SELECT * FROM {name}" for name in views.PARTS},
    "mv_death_by_drug": _six("pct_of_all_ps_reports", of="mv_death_by_drug"),
    "mv_age_sex_distribution": _six("median_age", "avg_age", "avg_weight_kg", of="mv_age_sex_distribution"),
    "mv_quarterly_trends": _six("avg_age", of="mv_quarterly_trends"),
    # reports
    "top_drugs": """SELECT drugname_clean AS drug, prod_ai_clean AS active_ingredient,
        report_count AS total_reports, ps_count AS primary_suspect_reports, quarter
        FROM mv_top_drugs WHERE ps_count > 0 ORDER BY ps_count DESC, 1, 2, 5 LIMIT 20""",
    "top_drugs_in_role": f"""SELECT drugname_clean AS drug, prod_ai_clean AS active_ingredient,
        report_count AS total_reports, ps_count AS primary_suspect_reports, quarter
        FROM mv_top_drugs WHERE ss_count > 0 AND quarter = '{QUARTER}'
        ORDER BY ss_count DESC, 1, 2, 5 LIMIT 30""",
    "drug_reactions": f"""SELECT reaction_term AS reaction,
        sum(report_count)::BIGINT AS report_count, {_quarters()} FROM mv_drug_reaction_pairs
        WHERE drugname_clean {_LIKE} AND role_cod = 'PS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
    "drug_reactions_all_roles": f"""SELECT reaction_term AS reaction,
        sum(report_count)::BIGINT AS report_count, {_quarters()} FROM mv_drug_reaction_pairs
        WHERE drugname_clean {_LIKE} AND quarter = '{QUARTER}'
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "drug_outcomes": f"""SELECT outc_cod AS outcome_code, outcome_label AS outcome,
        sum(report_count)::BIGINT AS report_count FROM mv_drug_outcomes
        WHERE drugname_clean {_LIKE} AND role_cod = 'PS' GROUP BY 1, 2 ORDER BY 3 DESC, 1""",
    "drug_signal": f"""SELECT reaction_term AS reaction,
        sum(drug_reaction_count)::BIGINT AS report_count, max(prr) AS prr, max(ror) AS ror,
        bool_or(is_signal) AS is_signal, {_quarters()} FROM mv_signal_prr
        WHERE drugname_clean {_LIKE} GROUP BY 1 HAVING sum(drug_reaction_count) >= 3
        ORDER BY max(prr) DESC NULLS LAST, 1 LIMIT 50""",
    "drug_signal_confirmed": f"""SELECT reaction_term AS reaction,
        sum(drug_reaction_count)::BIGINT AS report_count, max(prr) AS prr, max(ror) AS ror,
        bool_or(is_signal) AS is_signal, {_quarters()} FROM mv_signal_prr
        WHERE drugname_clean ILIKE '%gear%' AND is_signal GROUP BY 1
        HAVING sum(drug_reaction_count) >= 5 ORDER BY max(prr) DESC NULLS LAST, 1 LIMIT 50""",
    "signal_count": f"""SELECT count(DISTINCT reaction_term) AS signal_count FROM mv_signal_prr
        WHERE drugname_clean {_LIKE} AND is_signal""",
    "drug_demographics": f"""SELECT age_group, sex, sum(report_count)::BIGINT AS report_count,
        round(avg(avg_age), 1) AS avg_age, round(avg(median_age), 1) AS median_age
        FROM mv_age_sex_distribution WHERE drugname_clean {_LIKE} GROUP BY 1, 2""",
    "death_top_drugs": f"""SELECT drugname_clean AS drug,
        sum(death_reports)::BIGINT AS death_reports, {_quarters()} FROM mv_death_by_drug
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "country_distribution": """SELECT reporter_country AS country,
        sum(report_count)::BIGINT AS report_count, sum(death_count)::BIGINT AS death_count,
        sum(hospitalization_count)::BIGINT AS hospitalization_count,
        sum(life_threatening_count)::BIGINT AS life_threatening_count
        FROM mv_reports_by_country WHERE reporter_country <> ''
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
    "quarterly_trends": "SELECT * REPLACE (round(avg_age, 1) AS avg_age) FROM mv_quarterly_trends",
    "top_reactions": """SELECT reaction_term AS reaction, sum(report_count)::BIGINT AS report_count
        FROM mv_top_reactions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
    "db_summary": f"""SELECT (SELECT count(*) FROM demo) AS total_cases,
        (SELECT count(*) FROM drug) AS total_drug_records,
        (SELECT count(*) FROM reac) AS total_reaction_records,
        (SELECT count(DISTINCT reporter_country) FROM demo) AS total_countries,
        (SELECT count(DISTINCT drugname_clean) FROM drug) AS unique_drugs,
        (SELECT count(DISTINCT pt_clean) FROM reac) AS unique_reactions,
        (SELECT {_quarters('q')} FROM demo) AS loaded_quarters""",
    "total_cases": "SELECT count(*) AS total_cases FROM demo",
    "prr_full": """
        WITH p AS (SELECT drugname_clean AS drug, pt_clean AS reaction,
                          count(DISTINCT report_id) AS a
                   FROM drug JOIN reac USING (report_id) WHERE role_cod = 'PS'
                   GROUP BY 1, 2 HAVING a >= 3)
        SELECT drug, reaction, a AS drug_reaction_count, d AS drug_total, r AS reaction_total,
               n AS grand_total, round((a / d) / (r / n), 3) AS prr,
               round(a * (n - r - d + a) / nullif((d - a)::DOUBLE * (r - a), 0), 3) AS ror,
               (a / d) / (r / n) >= 2 AS is_signal
        FROM p
        JOIN (SELECT drugname_clean AS drug, count(DISTINCT report_id) AS d FROM drug
              WHERE role_cod = 'PS' GROUP BY 1) USING (drug)
        JOIN (SELECT pt_clean AS reaction, count(DISTINCT report_id) AS r FROM reac GROUP BY 1)
          USING (reaction), (SELECT count(*) AS n FROM demo)""",
    "drug_trend": f"""
        SELECT g.quarter, count(DISTINCT g.report_id) AS report_count,
               count(DISTINCT g.report_id) FILTER (outc_cod = 'DE') AS deaths,
               count(DISTINCT g.report_id) FILTER (outc_cod = 'HO') AS hospitalizations,
               count(DISTINCT pt_clean) AS unique_reactions_reported
        FROM drug g LEFT JOIN outc o ON o.report_id = g.report_id
        LEFT JOIN reac e ON e.report_id = g.report_id
        WHERE drugname_clean {_LIKE} AND role_cod = 'PS' GROUP BY 1""",
    "polypharmacy": """SELECT report_id, count(*) AS drug_count, string_agg(drugname_clean, ' | '
        ORDER BY drug_seq, drugname_clean) AS drug_list FROM drug GROUP BY 1
        HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 1000""",
    "drug_pairs_serious": f"""
        WITH s AS (SELECT report_id, drugname_clean FROM drug
                   WHERE role_cod IN ('PS', 'SS') AND drugname_clean <> '' AND {_SERIOUS})
        SELECT a.drugname_clean AS drug_a, b.drugname_clean AS drug_b,
               count(*) AS co_report_count
        FROM s a, s b WHERE a.report_id = b.report_id AND a.drugname_clean < b.drugname_clean
        GROUP BY 1, 2 HAVING count(*) >= 10 ORDER BY 3 DESC, 1, 2 LIMIT 500""",
    # standard answers
    "ex_reactions_for_drug": f"""SELECT reaction_term, sum(report_count)::BIGINT AS total_reports
        FROM mv_drug_reaction_pairs WHERE drugname_clean {_LIKE} AND role_cod = 'PS'
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "ex_deaths_by_quarter": f"""SELECT drugname_clean, quarter,
        sum(death_reports)::BIGINT AS total_deaths FROM mv_death_by_drug
        WHERE drugname_clean {_LIKE} GROUP BY 1, 2""",
    "ex_countries": """SELECT reporter_country, sum(report_count)::BIGINT AS total_reports,
        sum(death_count)::BIGINT AS total_deaths FROM mv_reports_by_country
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "ex_signal_pair": f"""SELECT drugname_clean, reaction_term, quarter, drug_reaction_count,
        prr, ror, is_signal FROM mv_signal_prr
        WHERE drugname_clean {_LIKE} AND reaction_term ILIKE '%{REACTION}%'""",
    "ex_demographics": f"""SELECT age_group, sex, sum(report_count)::BIGINT AS reports,
        round(avg(avg_age), 1) AS avg_age FROM mv_age_sex_distribution
        WHERE drugname_clean {_LIKE} GROUP BY 1, 2""",
    "ex_trend": """SELECT quarter, total_cases, deaths, hospitalizations, life_threatening,
        female_cases, male_cases, round(avg_age, 1) AS avg_age FROM mv_quarterly_trends""",
    "ex_top_hospitalization": """SELECT drugname_clean,
        sum(report_count)::BIGINT AS hospitalization_reports FROM mv_drug_outcomes
        WHERE outc_cod = 'HO' AND role_cod = 'PS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "ex_class_signals": f"""SELECT drugname_clean, reaction_term, drug_reaction_count, prr, ror
        FROM mv_signal_prr WHERE quarter = '{QUARTER}' AND is_signal
        AND ({_any('drugname_clean', CLASS_NAMES)} OR drugname_clean IN
          (SELECT drugname_clean FROM drug WHERE report_id IN (SELECT report_id FROM latest)
           AND {_any('prod_ai_clean', CLASS_INGREDIENTS)}))
        ORDER BY prr DESC NULLS LAST, 1, 2 LIMIT 30""",
    "ex_compare_deaths": """
        SELECT drugname_clean, sum(death_reports)::BIGINT AS total_deaths,
               round(sum(death_reports) / any_value(n) * 100, 6) AS death_rate_pct
        FROM mv_death_by_drug LEFT JOIN (SELECT drugname_clean, sum(report_count) AS n
          FROM mv_top_drugs GROUP BY 1) USING (drugname_clean)
        WHERE drugname_clean ILIKE '%cold ring%' OR drugname_clean ILIKE '%gear%' GROUP BY 1""",
    "ex_reporter_type": """
        SELECT drugname_clean,
               count(DISTINCT report_id) FILTER (occp_cod = 'MD') AS physician_reports,
               count(DISTINCT report_id) FILTER (occp_cod = 'CN') AS consumer_reports,
               count(DISTINCT report_id) AS total_reports
        FROM drug JOIN demo USING (report_id) WHERE role_cod = 'PS' AND drugname_clean <> ''
        GROUP BY 1 HAVING count(DISTINCT report_id) >= 10 ORDER BY 4 DESC, 1 LIMIT 20""",
    "ex_drug_pairs": """SELECT a.drugname_clean AS drug_1, b.drugname_clean AS drug_2,
        count(DISTINCT a.report_id) AS co_occurrence_reports FROM drug a JOIN drug b
        ON a.report_id = b.report_id AND a.drug_seq < b.drug_seq
        GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
    # shares
    "share_of_max": f"""
        WITH d AS (SELECT drugname_clean AS drug, sum(death_reports)::BIGINT AS death_reports,
                          {_quarters()} FROM mv_death_by_drug GROUP BY 1
                   ORDER BY 2 DESC, 1 LIMIT 20)
        SELECT *, round(death_reports / (SELECT max(death_reports) FROM d) * 100, 6)
               AS share_of_max FROM d""",
    "country_death_pct": """SELECT reporter_country AS country,
        sum(report_count)::BIGINT AS report_count, sum(death_count)::BIGINT AS death_count,
        round(sum(death_count) / sum(report_count) * 100, 1) AS death_pct
        FROM mv_reports_by_country GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
    "quarter_outcome_pct": "SELECT quarter, total_cases, "
    + ", ".join(
        f"round({c} / total_cases * 100, 6) AS {c}_pct"
        for c in "deaths hospitalizations life_threatening female_cases male_cases".split()
    )
    + " FROM mv_quarterly_trends",
    "latest_six_quarters": """SELECT * REPLACE (round(avg_age, 1) AS avg_age)
        FROM mv_quarterly_trends ORDER BY quarter DESC LIMIT 6""",
    # question log
    "log_history": """SELECT query_text AS question, generated_sql, response_time_ms,
        rows_returned, from_cache, error_message AS error, created_at AS "timestamp"
        FROM log ORDER BY created_at DESC NULLS LAST, 1, 2 LIMIT 20""",
    "log_sanitize": f"""SELECT query_text, {_sanitized()} AS sanitized,
        length(query_text) > 1000 AS was_cut FROM log""",
    "log_route": f"SELECT query_text, {_route()} AS route FROM log",
    "log_route_counts": f"SELECT {_route()} AS route, count(*) AS questions FROM log GROUP BY 1",
    "log_warning": f"""SELECT query_text, CASE WHEN {_mentions(L.CAUSATION_WORDS)} THEN 'causation'
        WHEN {_mentions(L.DEATH_WORDS)} THEN 'death' END AS warning FROM log""",
    "log_sql_audit": _audit(),
    "sql_fingerprint": f"""SELECT {_fingerprint()} AS fingerprint, count(*) AS statements
        FROM log GROUP BY 1""",
    "log_latency": """SELECT CASE WHEN response_time_ms < 500 THEN 'fast'
        WHEN response_time_ms < 2000 THEN 'medium' ELSE 'slow' END AS band,
        count(*) AS questions FROM log WHERE response_time_ms IS NOT NULL GROUP BY 1""",
}


def _needed(text: str) -> list[str]:
    """Parts that a statement mentions, directly or through other parts, in order."""
    found: set[str] = set()
    pending = [text]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for part in words & PARTS.keys() - found:
            found.add(part)
            pending.append(PARTS[part])
    return [p for p in PARTS if p in found]


def oracle_sql() -> dict[str, str]:
    statements = {}
    for name, text in STATEMENTS.items():
        parts = ",\n".join(f"{p} AS ({PARTS[p]})" for p in _needed(text))
        body = text.strip()
        if body.startswith("WITH "):
            body = "," + body[len("WITH ") :]
            statements[name] = f"WITH {parts}\n{body}"
        else:
            statements[name] = f"WITH {parts}\n{body}"
    return statements
