"""DuckDB restatement of the standing views, straight from their definitions."""

from __future__ import annotations

from casetide.oracle.base import mean

_LATEST = "report_id IN (SELECT report_id FROM latest)"

PARTS: dict[str, str] = {
    "mv_latest_cases": "SELECT caseid, report_id FROM latest",
    "mv_drug_reaction_pairs": f"""
      SELECT g.drugname_clean, g.prod_ai_clean, g.role_cod, g.drug_role,
             e.pt_clean AS reaction_term, g.quarter, count(DISTINCT g.report_id) AS report_count
      FROM drug g JOIN reac e USING (report_id)
      WHERE g.{_LATEST} AND g.drugname_clean <> '' AND e.pt_clean <> ''
      GROUP BY ALL""",
    "mv_drug_outcomes": f"""
      SELECT g.drugname_clean, g.prod_ai_clean, g.role_cod, e.outc_cod, e.outcome_label,
             g.quarter, count(DISTINCT g.report_id) AS report_count
      FROM drug g JOIN outc e USING (report_id)
      WHERE g.{_LATEST} AND g.drugname_clean <> '' GROUP BY ALL""",
    "mv_death_by_drug": f"""
      SELECT drugname_clean, prod_ai_clean, quarter, count(DISTINCT report_id) AS death_reports,
             count(DISTINCT report_id) / any_value(n) * 100 AS pct_of_all_ps_reports
      FROM drug, (SELECT nullif(count(DISTINCT report_id), 0) AS n FROM drug
                  WHERE role_cod = 'PS' AND {_LATEST}) whole
      WHERE {_LATEST} AND role_cod IN ('PS', 'SS') AND drugname_clean <> ''
        AND EXISTS (SELECT 1 FROM outc o WHERE o.report_id = drug.report_id AND outc_cod = 'DE')
      GROUP BY 1, 2, 3""",
    "mv_reports_by_country": f"""
      SELECT reporter_country, m.quarter, count(DISTINCT m.report_id) AS report_count,
             count(DISTINCT m.report_id) FILTER (o.outc_cod = 'DE') AS death_count,
             count(DISTINCT m.report_id) FILTER (o.outc_cod = 'HO') AS hospitalization_count,
             count(DISTINCT m.report_id) FILTER (o.outc_cod = 'LT') AS life_threatening_count
      FROM demo m LEFT JOIN outc o ON o.report_id = m.report_id
      WHERE m.{_LATEST} AND reporter_country IS NOT NULL GROUP BY 1, 2""",
    "mv_signal_prr": f"""
      SELECT drugname_clean, reaction_term, quarter, a AS drug_reaction_count,
             n_drug AS drug_total, n_reac AS reaction_total, n AS grand_total,
             round((a / n_drug) / (n_reac / n), 3) AS prr,
             round(a * (n - n_reac - n_drug + a)
                   / nullif((n_drug - a)::DOUBLE * (n_reac - a), 0), 3) AS ror,
             (a / n_drug) / (n_reac / n) >= 2 AS is_signal
      FROM (SELECT drugname_clean, g.quarter, pt_clean AS reaction_term,
                   count(DISTINCT g.report_id) AS a
            FROM drug g JOIN reac e USING (report_id)
            WHERE role_cod = 'PS' AND drugname_clean <> '' AND g.{_LATEST}
            GROUP BY ALL HAVING a >= 3)
      JOIN (SELECT drugname_clean, quarter, count(DISTINCT report_id) AS n_drug FROM drug
            WHERE role_cod = 'PS' AND {_LATEST} GROUP BY ALL) USING (drugname_clean, quarter)
      JOIN (SELECT pt_clean AS reaction_term, count(DISTINCT report_id) AS n_reac FROM reac
            WHERE {_LATEST} GROUP BY ALL) USING (reaction_term),
      (SELECT count(DISTINCT report_id) AS n FROM demo WHERE {_LATEST})""",
    "mv_age_sex_distribution": f"""
      SELECT drugname_clean, g.quarter, sex, age_group,
             count(DISTINCT g.report_id) AS report_count, {mean('age_years')} AS avg_age,
             quantile_cont(age_years, 0.5) AS median_age, {mean('weight_kg')} AS avg_weight_kg
      FROM drug g JOIN demo m USING (report_id)
      WHERE role_cod = 'PS' AND drugname_clean <> '' AND g.{_LATEST} GROUP BY 1, 2, 3, 4""",
    "mv_quarterly_trends": f"""
      SELECT m.quarter, count(DISTINCT m.report_id) AS total_cases,
             count(DISTINCT m.report_id) FILTER (outc_cod = 'DE') AS deaths,
             count(DISTINCT m.report_id) FILTER (outc_cod = 'HO') AS hospitalizations,
             count(DISTINCT m.report_id) FILTER (outc_cod = 'LT') AS life_threatening,
             count(DISTINCT m.report_id) FILTER (sex = 'Female') AS female_cases,
             count(DISTINCT m.report_id) FILTER (sex = 'Male') AS male_cases,
             {mean('age_years')} AS avg_age, count(DISTINCT reporter_country) AS reporting_countries
      FROM demo m LEFT JOIN outc o ON o.report_id = m.report_id
      WHERE m.{_LATEST} GROUP BY 1""",
    "mv_top_drugs": f"""
      SELECT drugname_clean, prod_ai_clean, quarter, count(DISTINCT report_id) AS report_count,
             count(DISTINCT report_id) FILTER (role_cod = 'PS') AS ps_count,
             count(DISTINCT report_id) FILTER (role_cod = 'SS') AS ss_count,
             count(DISTINCT report_id) FILTER (role_cod = 'C') AS concomitant_count
      FROM drug WHERE {_LATEST} AND drugname_clean <> '' GROUP BY 1, 2, 3""",
    "mv_top_reactions": f"""
      SELECT pt_clean AS reaction_term, quarter, count(DISTINCT report_id) AS report_count
      FROM reac WHERE {_LATEST} AND pt_clean <> '' GROUP BY 1, 2""",
}
