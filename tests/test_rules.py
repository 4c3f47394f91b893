"""Preflight rules as rows."""

import re

from pyspark.sql import functions as F

from docwarden.operators import preflight as P, rules as R

KINDS = "rule string, kind string, words string, pattern string"
RULES = [
    ("badge", "key", "acme badge", None),
    ("badge", "key", "badgeNumber", None),
    ("ticket", "shape", "tkt", "^tkt-[0-9]{6}$"),
    ("any_unit", "shape", "unit zz9", None),
    ("vault", "path", "Acme-Vault", None),
    (None, "key", "lost", None),
    ("empty", "key", " - ", None),
    ("strange", "colour", "red", None),
    ("odd", "key", "odd", "x"),
]
TEXTS = {
    "wiki/a.md": "acmeBadge: 12\nold_acme_badge_id = \"x y\"\nbadge acme = 3\nacme badge only\nplain",
    "wiki/b.md": "badge_number=${BADGE}\nbadge_number=77, see tkt-123456 and tkt-12345678 or xtkt-123456\npassword: hunter2hunter2",
    "wiki/c.md": "code unit-zz9-77 and unit-zz8-77\nodd=1",
    "acme/vault/d.md": "nothing", "my/acme_vault_2/e.md": "acme_badge=1", "wiki/.env.example": "acme_badge=1",
    "wiki/f.md": "", "wiki/g.md": None, ".env": "acme_badge=1", "wiki/h.md": "acme_badge = tkt-123456 # twice tkt-123456",
}


def tables(spark, policy=False):
    rows = [(p, t, "allow_project_staging" if p == "wiki/b.md" else "exclude") for p, t in TEXTS.items()]
    return spark.createDataFrame(rows, "relative_path string, content string, policy string"), spark.createDataFrame(RULES, KINDS)


def test_hits(spark):
    docs, rules = tables(spark)
    got = {(r.relative_path, r.line, r.rule) for r in R.rule_hits(docs, rules).collect()}
    assert got == {
        ("wiki/a.md", 1, "badge"), ("wiki/a.md", 2, "badge"), ("wiki/b.md", 2, "badge"), ("wiki/b.md", 2, "ticket"),
        ("wiki/c.md", 1, "any_unit"), ("wiki/c.md", 2, "odd"), ("my/acme_vault_2/e.md", 0, "vault"), ("my/acme_vault_2/e.md", 1, "badge"),
        ("wiki/.env.example", 1, "badge"), (".env", 1, "badge"), ("wiki/h.md", 1, "badge"), ("wiki/h.md", 1, "ticket"),
    }


def test_decisions(spark):
    docs, rules = tables(spark)
    done = P.preflight(docs, rules=rules)
    assert done.columns == [*docs.columns, "decision", "exported_text", "findings"]
    got = {r.relative_path: (r.decision, r.exported_text, [(f.line, f.rule) for f in r.findings]) for r in done.collect()}
    assert got["wiki/a.md"] == ("redacted", "acmeBadge: [REDACTED]\nold_acme_badge_id = \"[REDACTED]\"\nbadge acme = 3\nacme badge only\nplain", [(1, "badge"), (2, "badge")])
    assert got["wiki/b.md"][0] == "redacted" and got["wiki/b.md"][2] == [(2, "badge"), (2, "ticket"), (3, "credential_assignment")]
    assert got["wiki/b.md"][1].split("\n")[1] == "badge_number=[REDACTED], see [REDACTED] and tkt-12345678 or xtkt-123456"
    assert got["wiki/h.md"][1] == "acme_badge = [REDACTED] # twice [REDACTED]"
    assert got["my/acme_vault_2/e.md"] == ("blocked", None, [(0, "vault")])
    assert got["wiki/.env.example"] == ("blocked", None, [(1, "badge")])
    assert got[".env"] == ("blocked", None, [(0, "path_environment_file")])
    assert got["acme/vault/d.md"][0] == "safe" and got["wiki/f.md"] == ("safe", "", []) and got["wiki/g.md"][1] is None


def test_allowed_rows_keep_their_text(spark):
    docs, rules = tables(spark)
    row = P.preflight(docs, policy="policy", rules=rules).filter("relative_path = 'wiki/b.md'").first()
    assert row.decision == "safe" and row.exported_text == TEXTS["wiki/b.md"]
    assert {f.rule for f in row.findings} == {"badge_allowed", "ticket_allowed", "credential_assignment_allowed"}


def test_violations(spark):
    _, rules = tables(spark)
    got = {(r.rule, r.violation) for r in R.rule_violations(rules).collect()}
    assert got == {(None, "name_missing"), ("empty", "words_missing"), ("strange", "kind"), ("odd", "pattern_unused")}


def test_the_plan_does_not_grow_with_the_rules(spark):
    docs, _ = tables(spark)

    def plan(n):
        rules = spark.range(n).select(F.concat(F.lit("r"), "id").alias("rule"), F.lit("key").alias("kind"), F.concat(F.lit("word"), "id").alias("words"), F.lit(None).cast("string").alias("pattern"))
        text = R.rule_hits(docs, rules)._jdf.queryExecution().optimizedPlan().toString()
        return re.sub(r"#\d+L?|\d+", "", text)

    assert plan(3) == plan(3000)


def test_no_rules(spark):
    docs, rules = tables(spark)
    plain = P.preflight(docs)
    assert P.preflight(docs, rules=rules.filter("false")).exceptAll(plain).isEmpty()
