"""Inputs of the registered queries, derived from the supplied tables.

Whole tables and whole texts are used; the expressions below only decide what a row looks like.
They are plain SQL that Spark and the oracle engine read alike, so both sides start from the same
input; only the hash function is named differently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docwarden.operators.graph import GraphPolicy
from docwarden.operators.profile import Profile

PROFILE = Profile(
    project_slug="acme", operator="alice", scope="wiki", topics=("topic:reports",)
)
LOGBOOK_PROFILE = Profile(project_slug="acme", operator="alice", knowledge_layer="initiative")
POLICY = GraphPolicy(
    project_slug="acme",
    operator="alice",
    scope="runtime",
    coverage_note="orders, customers, places and parts",
    included_path_prefixes=("docs", "fr", "en"),
    excluded_path_prefixes=("en/private",),
    url_node_types=("route",),
    generated_at="2026-09-01T12:00:00+02:00",
    source_path="graph/edges.json",
    source_sha256="0" * 64,
)


def spark_sha(text: str) -> str:
    return f"sha2({text}, 256)"


def oracle_sha(text: str) -> str:
    return f"sha256({text})"


ID = "cast(doc_id as string)"
BASE_PATH = f"""CASE
  WHEN doc_id % 17 = 0 THEN 'config/' || {ID} || '/.env.local'
  WHEN doc_id % 19 = 0 THEN 'vendor/lib' || {ID} || '.php'
  WHEN doc_id % 23 = 0 THEN 'docs/customer-data-policy/' || {ID} || '.md'
  WHEN doc_id % 29 = 0 THEN 'medicalRecords/' || {ID} || '.md'
  WHEN doc_id % 31 = 1 THEN 'templates/' || {ID} || '/.env.example'
  WHEN doc_id % 37 = 1 THEN 'assets/' || {ID} || '.PDF'
  ELSE 'wiki/' || source || '/' || {ID} || '.md' END"""
PATHS = {
    "prev": BASE_PATH,
    "cur": f"""CASE
  WHEN doc_id % 10 = 9 THEN 'moved/' || {ID} || '.md'
  WHEN doc_id % 10 = 7 THEN 'rewritten/' || {ID} || '.md'
  ELSE {BASE_PATH} END""",
}


def text_of(side: str, sha) -> str:
    """Document text with planted lines; credential values are derived from hashes."""
    digest = sha(f"'v' || {ID}")
    planted = f"""
      CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'password: ' || substr({digest}, 1, 12) ELSE '' END
   || CASE WHEN doc_id % 13 = 0 THEN chr(10) || 'Authorization: Bearer ' || substr({digest}, 1, 32) ELSE '' END
   || CASE WHEN doc_id % 31 = 0 THEN chr(10) || '-----BEGIN ' || 'PRIVATE KEY-----' ELSE '' END
   || CASE WHEN doc_id % 37 = 0 THEN chr(10) || 'opaque_ref = ' || upper(substr({digest}, 1, 32)) || substr({digest}, 33, 32) ELSE '' END
   || CASE WHEN doc_id % 41 = 0 THEN chr(10) || 'api_key: <API_KEY>' ELSE '' END
   || CASE WHEN doc_id % 43 = 0 THEN chr(10) || 'client_secret="' || substr({digest}, 1, 20) || '"' ELSE '' END
   || CASE WHEN doc_id % 47 = 0 THEN chr(10) || 'see bearer ' || substr({digest}, 1, 24) ELSE '' END"""
    own = {
        "prev": "CASE WHEN doc_id % 10 = 5 THEN chr(10) || 'Earlier wording.' ELSE '' END",
        "cur": "CASE WHEN doc_id % 10 = 7 THEN chr(10) || 'Rewritten section.' ELSE '' END",
    }[side]
    return f"(text || chr(10) || 'End of text.' || {planted} || {own})"


MODIFIED_AT = "'2026-09-' || lpad(cast(doc_id % 28 + 1 as string), 2, '0') || 'T10:00:00+00:00'"


def corpus_sql(side: str, sha, table: str = "documents") -> str:
    return (
        f"SELECT doc_id, {PATHS[side]} AS relative_path, {text_of(side, sha)} AS content,"
        f" {MODIFIED_AT} AS source_modified_at FROM {table}"
    )


# Rules of the user's own, one row each: nations name keys, parts name tokens, sources name folders.
RULES = """
  SELECT 'key_' || cast(n_nationkey as string) AS rule, 'key' AS kind, n_name || ' vault' AS words, cast(null as string) AS pattern FROM {nation}
  UNION ALL SELECT 'token_' || cast(p_partkey as string), 'shape', 'pk' || cast(p_partkey as string),
    '^pk' || cast(p_partkey as string) || '-[0-9a-f]+$' FROM {part}
  UNION ALL SELECT 'folder_' || source, 'path', source || ' vault', cast(null as string) FROM {documents} WHERE source IS NOT NULL GROUP BY source"""


def ruled_corpus_sql(sha, table: str = "documents") -> str:
    """The current corpus with lines and folders that the rules are about, and some that only look so."""
    digest = sha(f"'r' || {ID}")
    part, nation = "cast(doc_id % 200 as string)", "cast(doc_id % 25 as string)"
    return f"""SELECT doc_id, CASE WHEN doc_id % 53 = 2 THEN 'teams/' || source || '-vault/' || {ID} || '.md'
        WHEN doc_id % 53 = 3 THEN 'teams/' || source || '/vault/' || {ID} || '.md' ELSE relative_path END AS relative_path,
      content || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'nation_' || {nation} || '_vault = ' || substr({digest}, 1, 12) ELSE '' END
        || CASE WHEN doc_id % 14 = 1 THEN chr(10) || 'nation_1_vault: <API_KEY>' ELSE '' END
        || CASE WHEN doc_id % 9 = 0 THEN chr(10) || 'see pk' || {part} || '-' || substr({digest}, 1, 12) || ' in the log' ELSE '' END
        || CASE WHEN doc_id % 9 = 1 THEN chr(10) || 'see pk' || {part} || '-XYZ01234 in the log' ELSE '' END AS content, source_modified_at
    FROM ({corpus_sql('cur', sha, table).replace('SELECT doc_id,', 'SELECT doc_id, source,', 1)})"""


def ruled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ruled_corpus_sql(spark_sha, "{documents}"), documents=table(spark, sf_dir, "documents"))


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, RULES, "nation", "part", "documents")


# One logbook per conversation, one heading per turn.
STAMP = (
    "'2026-' || lpad(cast(conv_id % 12 + 1 as string), 2, '0') || '-'"
    " || lpad(cast(conv_id % 28 + 1 as string), 2, '0') || ' '"
    " || lpad(cast(turn % 24 as string), 2, '0') || ':' || lpad(cast(conv_id % 60 as string), 2, '0')"
)
TITLES = {
    "cur": "role || ' turn ' || cast(turn as string)",
    "prev": "CASE WHEN turn % 2 = 1 THEN 'draft ' || cast(turn as string)"
    " ELSE role || ' turn ' || cast(turn as string) END",
}
LOGBOOK_PATH = "'logbooks/' || cast(conv_id as string) || '.md'"


def chunk_sql(side: str) -> str:
    return f"'### ' || {STAMP} || ' CEST - ' || {TITLES[side]} || chr(10) || text || chr(10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASKS_PER_CORE = 4


def spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt over all cores by their values: for work per row that is heavy beside the
    reading. A file has no more reading tasks than row groups, often one."""
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return table(spark, sf_dir, name).select(*columns).repartition(tasks, *columns)


def sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Run input SQL over supplied tables."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def corpus(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return spark.sql(corpus_sql(side, spark_sha, "{documents}"), documents=documents)


def logbooks(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """A conversation's turns form one document, as long as the conversation is."""
    return sql(
        spark, sf_dir,
        f"""SELECT {LOGBOOK_PATH} AS relative_path,
              'Preamble' || chr(10) || array_join(transform(array_sort(collect_list(
                struct(turn, {chunk_sql(side)} AS chunk))), x -> x.chunk), '') AS content,
              '2026-09-01T10:00:00+00:00' AS source_modified_at
            FROM {{conversations}} GROUP BY conv_id""",
        "conversations",
    )


EDGES = """
  SELECT 'order:' || cast(o_orderkey as string) AS source, 'customer:' || cast(o_custkey as string) AS target,
         'placed_by' AS type, 'orders.parquet' AS evidence, o_orderpriority AS confidence FROM {orders}
  UNION ALL
  SELECT 'customer:' || cast(c_custkey as string), 'nation:' || cast(c_nationkey as string),
         'located_in', 'customer.parquet', c_mktsegment FROM {customer}
  UNION ALL
  SELECT 'nation:' || cast(n_nationkey as string), 'region:' || cast(n_regionkey as string),
         'part_of', 'nation.parquet', 'exact' FROM {nation}
  UNION ALL
  SELECT 'order:' || cast(l_orderkey as string), 'part:' || cast(l_partkey as string),
         'contains', 'lineitem.parquet', l_returnflag FROM {lineitem}
  UNION ALL
  SELECT 'route:supplier-' || cast(l_suppkey as string), 'order:' || cast(l_orderkey as string),
         'ships', 'lineitem.parquet', l_linestatus FROM {lineitem}"""
EDGE_TABLES = ("orders", "customer", "nation", "lineitem")

NODES = """
  SELECT 'order:' || cast(o_orderkey as string) AS id, 'order' AS type, 'order' AS label FROM {orders}
  UNION ALL SELECT 'customer:' || cast(c_custkey as string), 'entity', c_name FROM {customer}
  UNION ALL SELECT 'nation:' || cast(n_nationkey as string), 'wiki', n_name FROM {nation}
  UNION ALL SELECT 'region:' || cast(r_regionkey as string), 'place', r_name FROM {region}
  UNION ALL SELECT 'part:' || cast(p_partkey as string),
                   CASE WHEN p_size > 25 THEN 'entity' ELSE 'item' END, p_name FROM {part}
  UNION ALL SELECT 'route:supplier-' || cast(s_suppkey as string), 'component', s_name FROM {supplier}"""
NODE_TABLES = ("orders", "customer", "nation", "region", "part", "supplier")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, EDGES, *EDGE_TABLES)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, NODES, *NODE_TABLES)


def oracle_names(text: str) -> str:
    """Input SQL for the oracle engine: table names in place of parameters."""
    return text.replace("{", "").replace("}", "")


# Events as an operation feed.
FEED = """
  SELECT event_id, cast(user_id as string) || '-' || cast(cast(ts as date) as string) AS operation_id,
         CASE event_type WHEN 'signup' THEN 'intended' WHEN 'view' THEN 'acknowledged'
              WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
              ELSE 'progress' END AS phase,
         ts
  FROM {events}"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, FEED, "events")
