"""Preflight with rules as rows: more than 200 of them, made from nations, parts and document sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwarden.operators import preflight as P, rules as R
from workloads import inputs as I, oracle as O
from workloads.registry import query

_RULES = f"rules AS ({I.oracle_names(I.RULES)})"
_SCAN = O.scan("cur").replace(I.corpus_sql("cur", O.SHA), I.ruled_corpus_sql(O.SHA))
_PHRASE = "' ' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _hits(source: str, text: str) -> str:
    """CTEs ``lines`` and ``hits``: every rule beside every assignment, token and part of a path."""
    return f"""
lines AS (SELECT relative_path, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS n FROM {source}),
assigned AS (SELECT relative_path, n, unnest(regexp_extract_all(line, '([A-Za-z][A-Za-z0-9_.-]*)\\s*[:=]\\s*[^\\s,<\\[]', 1)) AS k FROM lines),
tokens AS (SELECT relative_path, n, unnest(regexp_extract_all(line, '[A-Za-z0-9][A-Za-z0-9_.+/=-]{{7,}}')) AS t FROM lines WHERE regexp_matches(line, 'pk[0-9]')),
parts AS (SELECT relative_path, unnest(string_split(relative_path, '/')) AS p FROM {source}),
hits AS (
  SELECT DISTINCT relative_path, n AS line, rule FROM assigned JOIN rules ON kind = 'key' AND contains({_PHRASE.format('k')}, {_PHRASE.format('words')})
  UNION SELECT relative_path, n, rule FROM tokens JOIN rules ON kind = 'shape' AND regexp_matches(t, pattern)
  UNION SELECT relative_path, 0, rule FROM parts JOIN rules ON kind = 'path' AND contains({_PHRASE.format('p')}, {_PHRASE.format('words')}))"""


@query(
    "rule_row_hits",
    f"WITH {_RULES}, src AS ({I.ruled_corpus_sql(O.SHA)}), {_hits('src', 'content')}"
    " SELECT relative_path, CAST(line AS INT) AS line, rule FROM hits",
)
def rule_row_hits(spark, d):
    return R.rule_hits(I.ruled_corpus(spark, d), I.rule_rows(spark, d)).select("relative_path", "line", "rule").distinct()


@query(
    "rule_row_decisions",
    f"""WITH {_RULES}, {_SCAN}, open_docs AS (SELECT * FROM cur_entries WHERE document_id IS NOT NULL), {_hits('open_docs', 'exported_text')},
      paths AS (SELECT relative_path, min(rule) AS rule FROM hits WHERE line = 0 GROUP BY relative_path),
      texts AS (SELECT DISTINCT relative_path FROM hits WHERE line > 0),
      decided AS (
        SELECT s.relative_path, s.decision AS before, p.rule AS path_hit, t.relative_path IS NOT NULL AS hit, o.exported_text,
          lower(s.parts[-1]) IN ('.env.example', '.env.sample', '.env.template') AS template
        FROM cur_scan s LEFT JOIN open_docs o USING (relative_path) LEFT JOIN paths p USING (relative_path) LEFT JOIN texts t USING (relative_path)),
      findings AS (
        SELECT f.relative_path, line, rule FROM cur_findings f WHERE relative_path NOT IN (SELECT relative_path FROM paths)
        UNION SELECT relative_path, line, rule FROM hits WHERE line > 0 AND relative_path NOT IN (SELECT relative_path FROM paths)
        UNION SELECT relative_path, 0, rule FROM paths),
      listed AS (SELECT relative_path, string_agg(line || ':' || rule, ',' ORDER BY line, rule) AS findings FROM findings GROUP BY relative_path)
    SELECT relative_path, CASE WHEN path_hit IS NOT NULL OR hit AND template THEN 'blocked' WHEN hit THEN 'redacted' ELSE before END AS decision,
      coalesce(findings, '') AS findings,
      CASE WHEN before = 'blocked' OR path_hit IS NOT NULL OR hit AND template THEN NULL ELSE
        sha256(regexp_replace(regexp_replace(exported_text, '(nation_[0-9]+_vault = )[0-9a-f]{{12}}', '\\1[REDACTED]', 'g'),
          'pk[0-9]+-[0-9a-f]{{12}} in', '[REDACTED] in', 'g')) END AS text_sha256
    FROM decided LEFT JOIN listed USING (relative_path)""",
)
def rule_row_decisions(spark, d):
    done = P.preflight(I.ruled_corpus(spark, d), rules=I.rule_rows(spark, d))
    listed = F.transform("findings", lambda f: F.concat(f["line"].cast("string"), F.lit(":"), f["rule"]))
    return done.select("relative_path", "decision", F.array_join(listed, ",").alias("findings"), F.sha2("exported_text", 256).alias("text_sha256"))
