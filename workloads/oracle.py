"""Independent SQL for the oracle engine: the rules once more, written over lists of path parts,
lines and matches instead of the expressions the library uses."""

from __future__ import annotations

from workloads import inputs as I

SHA = I.oracle_sha

_WORDS = "regexp_replace(lower(regexp_replace(p, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')"
# Words that make a path harmless, and endings of binary files and dumps.
SAFE_WORDS = (
    "policy", "policies", "guideline", "guidelines", "template", "templates", "example", "examples", "sample", "samples",
)
BINARY_ENDINGS = (
    "sql", "dump", "sqlite", "sqlite3", "pdf", "doc", "docx", "xls", "xlsx", "zip", "gz", "tar", "png", "jpg", "jpeg", "gif",
    "ico", "woff", "woff2", "ttf", "mp3", "mp4",
)
_SAFE = f"(^| )({'|'.join(SAFE_WORDS)})( |$)"

PATH_RULE = f"""
  CASE
    WHEN lower(parts[-1]) = '.env' OR (starts_with(lower(parts[-1]), '.env.')
         AND lower(parts[-1]) NOT IN ('.env.example', '.env.sample', '.env.template'))
      THEN 'path_environment_file'
    WHEN list_has_any(list_transform(parts, lambda p: lower(p)),
         ['vendor', 'node_modules', 'build', 'dist', '.cache', 'cache', '__pycache__'])
      THEN 'path_dependency_or_build_artifact'
    WHEN len(list_filter(flags, lambda f: (f.domain AND (f.strong OR (f.data AND NOT f.safe)))
                                       OR (f.bulk AND NOT f.safe))) > 0
      OR (len(list_filter(flags, lambda f: f.domain)) > 0 AND len(list_filter(flags, lambda f: f.strong)) > 0)
      OR list_has_any(list_transform(parts, lambda p: lower(p)),
         ['uploads', 'upload', 'generated', 'generated-documents', 'payroll', 'medical', 'health',
          'customers', 'customer-data', 'database', 'dumps', 'dump'])
      THEN 'path_sensitive_or_generated_data'
    WHEN regexp_matches(lower(parts[-1]), '\\.({'|'.join(BINARY_ENDINGS)})$')
      THEN 'path_binary_or_dump_candidate'
  END"""


def _parts(source: str) -> str:
    return f"""
  SELECT *, list_transform(parts, lambda p: {{
      'domain': regexp_matches({_WORDS}, 'payroll|medical|health|customer'),
      'strong': regexp_matches({_WORDS}, 'record|dump|raw|export'),
      'data': contains({_WORDS}, 'data'),
      'safe': regexp_matches({_WORDS}, '{_SAFE}'),
      'bulk': regexp_matches({_WORDS}, '(^| )(database|dumps?|uploads?|generated)( |$)')}}) AS flags
  FROM (SELECT *, list_filter(string_split(relative_path, '/'), lambda p: p <> '' AND p <> '.') AS parts
        FROM {source})"""


_UNKNOWN = "(?m)^\\s*([A-Za-z][A-Za-z0-9_.-]*)\\s*[:=]\\s*([^\\s#]+)"


def _opaque(k: str, v: str) -> str:
    phrase = (
        f"regexp_replace(lower(regexp_replace({k}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')),"
        " '[^a-z0-9]+', ' ', 'g')"
    )
    return f"""(length({v}) >= 32 AND regexp_full_match({v}, '[A-Za-z0-9_+/-]+')
  AND regexp_matches({v}, '[a-z]') AND regexp_matches({v}, '[A-Z]') AND regexp_matches({v}, '[0-9]')
  AND round(list_aggregate(string_split({v}, ''), 'entropy'), 6) >= 4.0
  AND NOT regexp_matches({phrase}, '(^| )(hash|sha|sha256|digest|checksum|uuid|id)$')
  AND NOT regexp_matches({phrase}, '(^| )(password|passphrase|secret|credential|authorization)( |$)'))"""


_ASSIGNED = "(?i)\\b(password|client_secret)(\\s*[:=]\\s*)(\"?)[^\\s\",`}\\]#]+(\"?)"
_BEARER = "(?i)\\b(bearer\\s+)[A-Za-z0-9._~+/=-]{16,}"


def scan(side: str) -> str:
    """CTEs ``<side>_scan`` with path_rule, pem, opaque, finding lines and the redacted text."""
    return f"""
{side}_src AS ({I.corpus_sql(side, SHA)}),
{side}_parts AS ({_parts(side + '_src')}),
{side}_pairs AS (
  SELECT *, list_zip(regexp_extract_all(content, '{_UNKNOWN}', 1),
                     regexp_extract_all(content, '{_UNKNOWN}', 2)) AS pairs,
    string_split(content, chr(10)) AS lines
  FROM {side}_parts),
{side}_facts AS (
  SELECT *, {PATH_RULE} AS path_rule,
    list_position(list_transform(lines, lambda l: regexp_matches(l,
      '(?i)-----BEGIN(?: [A-Z0-9]+)* (?:PRIVATE KEY|CERTIFICATE)-----')), true) AS pem_line,
    len(list_filter(pairs, lambda x: {_opaque('x[1]', 'x[2]')})) > 0 AS opaque,
    list_position(list_transform(lines, lambda l: starts_with(l, 'opaque_ref = ')), true) AS opaque_line,
    list_filter(list_transform(lines, lambda l, i: CASE WHEN regexp_matches(l, '{_ASSIGNED}') THEN i END), lambda i: i IS NOT NULL) AS assign_lines,
    list_filter(list_transform(lines, lambda l, i: CASE WHEN regexp_matches(l, '{_BEARER}') THEN i END), lambda i: i IS NOT NULL) AS bearer_lines,
    regexp_replace(regexp_replace(content, '{_ASSIGNED}', '\\1\\2\\3[REDACTED]\\4', 'g'), '{_BEARER}', '\\1[REDACTED]', 'g') AS redacted
  FROM {side}_pairs),
{side}_scan AS (
  SELECT *, CASE
      WHEN path_rule IS NOT NULL OR pem_line > 0 OR opaque THEN 'blocked'
      WHEN len(assign_lines) + len(bearer_lines) = 0 THEN 'safe'
      WHEN lower(parts[-1]) IN ('.env.example', '.env.sample', '.env.template') THEN 'blocked'
      ELSE 'redacted' END AS decision
  FROM {side}_facts),
{side}_findings AS (
  SELECT relative_path, 0 AS line, path_rule AS rule FROM {side}_scan WHERE path_rule IS NOT NULL
  UNION ALL SELECT relative_path, pem_line, 'private_key_material' FROM {side}_scan
    WHERE path_rule IS NULL AND pem_line > 0
  UNION ALL SELECT relative_path, opaque_line, 'unknown_high_entropy_assignment' FROM {side}_scan
    WHERE path_rule IS NULL AND coalesce(pem_line, 0) = 0 AND opaque
  UNION ALL SELECT relative_path, unnest(assign_lines), 'credential_assignment' FROM {side}_scan
    WHERE path_rule IS NULL AND coalesce(pem_line, 0) = 0 AND NOT opaque
  UNION ALL SELECT relative_path, unnest(bearer_lines), 'bearer_token' FROM {side}_scan
    WHERE path_rule IS NULL AND coalesce(pem_line, 0) = 0 AND NOT opaque),
{side}_entries AS (
  SELECT relative_path,
    CASE WHEN decision = 'blocked' AND path_rule IS NOT NULL THEN 'exclude'
         WHEN decision = 'blocked' THEN 'blocked_review'
         WHEN decision = 'redacted' THEN 'include_redacted' ELSE 'include' END AS classification,
    octet_length(encode(content)) AS size, source_modified_at,
    sha256(content) AS source_sha256,
    CASE WHEN decision = 'redacted' THEN sha256(redacted) END AS exported_sha256,
    CASE WHEN decision IN ('safe', 'redacted') THEN 'kb:acme:source:wiki:' || relative_path END AS document_id,
    CASE WHEN decision = 'redacted' THEN redacted WHEN decision = 'safe' THEN content END AS exported_text
  FROM {side}_scan)"""


# The comparison written with a scalar count per new entry instead of grouped origins.
DELTA = """
base AS (
  SELECT c.*, CASE WHEN c.document_id IS NULL OR p.document_id IS NULL THEN 'new'
      WHEN c.source_sha256 IS NOT DISTINCT FROM p.source_sha256
       AND c.exported_sha256 IS NOT DISTINCT FROM p.exported_sha256 THEN 'unchanged'
      ELSE 'changed' END AS first_delta
  FROM cur_entries c LEFT JOIN prev_entries p ON c.document_id = p.document_id),
origins AS (
  SELECT b.relative_path, count(p.relative_path) AS n, min(p.relative_path) AS origin
  FROM base b JOIN prev_entries p
    ON p.document_id IS NOT NULL AND p.source_sha256 = b.source_sha256
   AND p.exported_sha256 IS NOT DISTINCT FROM b.exported_sha256 AND p.relative_path <> b.relative_path
  WHERE b.first_delta = 'new' AND b.document_id IS NOT NULL GROUP BY b.relative_path),
entries AS (
  SELECT b.*, CASE WHEN o.n = 1 THEN 'renamed' ELSE b.first_delta END AS delta,
    CASE WHEN o.n = 1 THEN o.origin END AS renamed_from
  FROM base b LEFT JOIN origins o USING (relative_path)),
deleted AS (
  SELECT * FROM prev_entries WHERE document_id IS NOT NULL
   AND document_id NOT IN (SELECT document_id FROM cur_entries WHERE document_id IS NOT NULL))"""

BOTH = f"WITH {scan('prev')}, {scan('cur')}, {DELTA}"
CUR = f"WITH {scan('cur')}"

TAGS = "'kind:source,knowledge:concept,project:acme,scope:wiki,topic:reports,trust:verified,user:alice'"


def _events(side: str) -> str:
    iso = f"replace({I.STAMP}, ' ', 'T') || ':00' || CASE WHEN {I.STAMP} >= '2026-03-29 02:00' AND {I.STAMP} < '2026-10-25 03:00' THEN '+02:00' ELSE '+01:00' END"
    title = I.TITLES[side]
    chunk = I.chunk_sql(side).replace("|| text ||", "|| regexp_replace(text, '\\r\\n?', chr(10), 'g') ||")
    return f"""
{side}_events AS (
  SELECT {I.LOGBOOK_PATH} AS relative_path, {iso} AS event_timestamp, {chunk} AS chunk,
    'kb:acme:event:project-logbook:' || replace(replace({I.STAMP}, ' ', 'T'), ':', '-') || ':'
      || trim(regexp_replace(lower({title}), '[^a-z0-9]+', '-', 'g'), '-') AS identity
  FROM conversations)"""


EVENTS = f"WITH {_events('prev')}, {_events('cur')}"
NODES = I.oracle_names(I.NODES)
EDGES = I.oracle_names(I.EDGES)
FEED = I.oracle_names(I.FEED)

SUBJECTS = f"""
graph_edges AS (SELECT DISTINCT * FROM ({EDGES})),
graph_nodes AS ({NODES}),
subjects AS (
  SELECT e.*, CASE
    WHEN s.type = 'route' OR starts_with(e.source, 'route:') THEN e.source
    WHEN t.type = 'route' OR starts_with(e.target, 'route:') THEN e.target
    WHEN s.type = 'entity' OR starts_with(e.source, 'entity:') THEN e.source
    WHEN t.type = 'entity' OR starts_with(e.target, 'entity:') THEN e.target
    WHEN s.type = 'wiki' OR starts_with(e.source, 'wiki:') THEN e.source
    WHEN t.type = 'wiki' OR starts_with(e.target, 'wiki:') THEN e.target
    ELSE e.source END AS subject
  FROM graph_edges e LEFT JOIN graph_nodes s ON e.source = s.id LEFT JOIN graph_nodes t ON e.target = t.id)"""


def capsules(size: int) -> str:
    return f"""
ranked_{size} AS (
  SELECT *, row_number() OVER (PARTITION BY subject ORDER BY type, source, target, evidence, confidence) AS rn,
    count(*) OVER (PARTITION BY subject) AS n FROM subjects),
parts_{size} AS (
  SELECT subject, (rn - 1) // {size} + 1 AS part, max((n + {size - 1}) // {size}) AS parts, count(*) AS edges,
    string_agg('- type: ' || type || chr(10) || '  source: ' || source || chr(10) || '  target: ' || target
      || chr(10) || '  evidence: ' || evidence || chr(10) || '  confidence: ' || confidence, chr(10) ORDER BY rn) AS body
  FROM ranked_{size} GROUP BY 1, 2),
capsules_{size} AS (
  SELECT 'kb:acme:graph:runtime:' || substr(trim(regexp_replace(lower(subject), '[^a-z0-9]+', '-', 'g'), '-'), 1, 72)
      || '-' || substr(sha256(subject), 1, 10) || CASE WHEN part > 1 THEN ':part-' || part ELSE '' END AS document_id,
    edges,
    '# Graph projection: ' || subject || CASE WHEN parts > 1 THEN ' (part ' || part || ' of ' || parts || ')' ELSE '' END
      || chr(10) || chr(10) || 'A bounded projection of audited graph relationships.' || chr(10)
      || 'Coverage: orders, customers, places and parts' || chr(10)
      || 'Derived: maintained documents and live sources take precedence.' || chr(10) || chr(10)
      || '## Relationships' || chr(10) || body || chr(10) AS content
  FROM parts_{size})"""


ASSIGNMENTS = f"""
WITH pairs AS (
  SELECT doc_id, unnest(list_zip(regexp_extract_all(content, '{_UNKNOWN}', 1),
                                 regexp_extract_all(content, '{_UNKNOWN}', 2))) AS x
  FROM ({I.corpus_sql('cur', SHA)})),
named AS (SELECT doc_id, x[1] AS k, x[2] AS v FROM pairs)
SELECT doc_id, k AS assignment_key, sha256(v) AS value_sha256,
  CAST(regexp_matches(v, '[a-z]') AS INT) + CAST(regexp_matches(v, '[A-Z]') AS INT) + CAST(regexp_matches(v, '[0-9]') AS INT) AS classes,
  CAST(round(list_aggregate(string_split(v, ''), 'entropy') * 10000) AS BIGINT) AS entropy_1e4
FROM named WHERE length(v) >= 32"""
