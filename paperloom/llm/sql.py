"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_FORMS = """
lines AS (
  SELECT article_id, source, t.line_no, t.line, trim(regexp_replace(lower(t.line), '[^\\p{L}]+', ' ', 'g')) AS form
  FROM (SELECT article_id, source, str_split(text, chr(10)) AS parts FROM articles WHERE text IS NOT NULL AND source IS NOT NULL) a,
       LATERAL (SELECT unnest(a.parts) AS line, generate_subscripts(a.parts, 1) AS line_no) t),
totals AS (SELECT source, count(*) AS total FROM articles GROUP BY source),
marked AS (
  SELECT l.source, l.form FROM lines l JOIN totals t ON l.source = t.source WHERE l.form <> ''
  GROUP BY l.source, l.form, t.total HAVING count(DISTINCT l.article_id) >= 4 AND count(DISTINCT l.article_id) >= 0.02 * t.total)
"""

ORACLES = {
    "p1_found": f"WITH {_FORMS} SELECT article_id, line_no FROM lines JOIN marked USING (source, form)",
    "p1_cleaned": f"""WITH {_FORMS},
flagged AS (SELECT l.article_id, l.line_no, l.line, m.form IS NOT NULL AS gone FROM lines l LEFT JOIN marked m ON l.source = m.source AND l.form = m.form),
back AS (SELECT article_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS clean_text, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS lines_removed FROM flagged GROUP BY article_id)
SELECT a.article_id, CASE WHEN a.source IS NULL THEN a.text ELSE b.clean_text END AS clean_text, coalesce(b.lines_removed, 0) AS lines_removed FROM articles a LEFT JOIN back b ON a.article_id = b.article_id""",
}
