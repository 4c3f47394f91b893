"""Preflight rules as rows: a company's own path words, key names and token shapes.

A table of rules has ``rule`` (name), ``kind``, ``words`` and ``pattern``:

* ``path``: the words stand next to each other in one part of the path; the document is excluded.
* ``key``: the words stand next to each other in the key of an assignment on one line whose value is no
  placeholder; the value is redacted.
* ``shape``: a run of at least eight token characters, one of them a digit, has the words and matches
  ``pattern`` (whole, if the pattern is anchored; null matches any); the run is redacted.

The words form an inverted index: each rule stands under the one of its words that the fewest rules have.
Texts are cut to lines, lines to units (assignments and tokens), and the distinct words of a unit meet the
index in one equi-join, so only rules whose word occurs are compared, and the plan is the same for one rule
and for a million. The index is written first, so its true size decides whether it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docwarden import vocab
from docwarden.functions import rewrite, secrets
from docwarden.functions.fence import fence
from docwarden.functions.paths import is_env_template, posix
from docwarden.functions.text import fold_letters, key_phrase
from docwarden.operators.checks import violations
from docwarden.session import materialize

KINDS = ("path", "key", "shape")
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.+/=-]{7,}+"


def rule_violations(rules: DataFrame) -> DataFrame:
    """(rule, violation) of rows that cannot work: no name, an unknown kind, no words, or a pattern on a
    kind that has none. A pattern that does not compile fails the job that first meets it."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return violations(rules, ["rule"], {
        "name_missing": blank(F.col("rule")),
        "kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "words_missing": blank(key_phrase(F.coalesce("words", F.lit("")))),
        "pattern_unused": F.col("pattern").isNotNull() & (F.col("kind") != "shape"),
    })


def rule_index(rules: DataFrame) -> DataFrame:
    """Written rows (kind, anchor, rule, phrase, pattern). Rows that :func:`rule_violations` reports are
    left out; the same rule may have several rows, for several phrases."""
    usable = rules.filter(F.col("kind").isin(*KINDS) & F.col("rule").isNotNull())
    given = usable.select("rule", "kind", key_phrase(F.col("words")).alias("phrase"), F.when(F.col("kind") == "shape", F.col("pattern")).alias("pattern"))
    given = given.filter("phrase <> ''").distinct()
    words = given.select("kind", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    rules_of = words.groupBy("kind", "word").agg(F.count("*").alias("rules"))
    rarest = F.min_by("word", F.struct("rules", -F.length("word"), "word")).alias("anchor")
    anchors = words.join(rules_of, ["kind", "word"]).groupBy("kind", "phrase").agg(rarest)
    return materialize(given.join(anchors, ["kind", "phrase"]), "rule-index")


def _unit(kind: str, text: Column, phrase: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("unit"), phrase.alias("phrase"))


def _path_phrase(path: Column) -> Column:
    """Words of a path, a slash between its parts."""
    spaced = F.regexp_replace(posix(path), "([a-z0-9])([A-Z])", "$1 $2")
    return F.replace(F.regexp_replace(fold_letters(spaced), "[^a-z0-9/]+", " "), F.lit("/"), F.lit(" / "))


def _line_units(line: Column) -> Column:
    assigned = F.filter(
        rewrite.matches(line, secrets.ASSIGNMENT), lambda m: ~secrets.is_placeholder_assignment(secrets.assignment_value(m))
    )
    tokens = F.filter(rewrite.matches(line, TOKEN), lambda t: t.rlike("[0-9]"))
    none = F.array().cast("array<struct<kind:string,unit:string,phrase:string>>")
    return F.concat(
        F.when(line.rlike("[:=]"), F.transform(assigned, lambda m: _unit("key", m, key_phrase(secrets.assignment_key(m))))).otherwise(none),
        F.when(line.rlike("[0-9]"), F.transform(F.array_distinct(tokens), lambda t: _unit("shape", t, key_phrase(t)))).otherwise(none),
    )


def rule_hits(documents: DataFrame, rules: DataFrame, *, path: str = "relative_path", content: str = "content") -> DataFrame:
    """(path, line, rule, kind, unit): every unit that a rule fits, once; ``line`` counts from 1 and is 0
    for a rule on the path. A null or empty text has no units; documents that repeat a path are one."""
    index = rule_index(rules).select(*[F.col(c).alias(f"_{c}") for c in ("kind", "anchor", "rule", "phrase", "pattern")])
    whole = documents.select(path, F.lit(0).alias("line"), F.explode(F.array(_unit("path", F.col(path), _path_phrase(F.col(path))))).alias("u"))
    lines = documents.select(path, F.posexplode(F.split(F.col(content), "\n")).alias("at", "text")).filter(F.col("text").rlike("[0-9:=]"))
    within = lines.select(path, (F.col("at") + 1).alias("line"), F.explode(_line_units(F.col("text"))).alias("u"))
    units = whole.unionByName(within).select(path, "line", "u.*")
    worded = units.select("*", F.explode(F.array_distinct(F.split(F.trim("phrase"), " "))).alias("_word"))
    met = worded.join(index, (F.col("kind") == F.col("_kind")) & (F.col("_word") == F.col("_anchor")))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    has_words = F.contains(padded(F.col("phrase")), padded(F.col("_phrase")))
    fits = F.when(has_words, F.col("_pattern").isNull() | F.regexp_like(F.col("unit"), F.col("_pattern")))
    return met.filter(fits).select(path, "line", F.col("_rule").alias("rule"), "kind", "unit").distinct()


def apply_rules(scanned: DataFrame, rules: DataFrame, *, path: str = "relative_path", policy: Column | None = None) -> DataFrame:
    """Rule rows on top of :func:`docwarden.operators.preflight.preflight`'s columns ``decision``,
    ``exported_text`` and ``findings``.

    Only what preflight lets through is looked at; units are taken from the exported text, so values it
    has masked already are placeholders. A path rule blocks; another hit redacts, or blocks an environment
    template. Under ``allow_project_staging`` hits in the text are reported as ``<rule>_allowed`` and the text
    is kept. The scanned table is written once, as hits and texts are read apart; one document's hits are
    one row."""
    allowed = F.coalesce(policy == "allow_project_staging", F.lit(False)) if policy is not None else F.lit(False)
    columns = scanned.columns
    scanned = materialize(scanned.withColumn("_allowed", allowed), "scanned")
    open_ = scanned.filter("exported_text IS NOT NULL")
    found = rule_hits(open_, rules, path=path, content="exported_text")
    # Longer assignments first, so that one inside another does not hide it.
    hit = F.struct((-F.length("unit")).alias("order"), "line", "rule", "kind", "unit")
    grouped = found.groupBy(F.col(path).alias("_path")).agg(F.array_sort(F.collect_list(hit)).alias("_hits"))
    joined = scanned.join(grouped, (F.col(path) == F.col("_path")) & F.col("exported_text").isNotNull(), "left")

    hits, held, text = F.col("_hits"), F.col("_allowed"), F.col("exported_text")
    on_path = F.array_sort(F.filter(hits, lambda h: h["kind"] == "path"))
    in_text = F.filter(hits, lambda h: h["kind"] != "path")
    blocked = F.size(on_path) > 0
    named = lambda h: F.when(held, F.concat(h["rule"], F.lit("_allowed"))).otherwise(h["rule"])
    finding = lambda h, rule, disposition: F.struct(
        h["line"].cast("int").alias("line"), rule.alias("rule"), F.lit(disposition).alias("disposition")
    )
    listed = F.array_sort(F.array_distinct(F.concat("findings", F.transform(in_text, lambda h: finding(h, named(h), "blocked_review")))))
    excluded = F.transform(F.slice(F.array_sort(F.transform(on_path, lambda h: h["rule"])), 1, 1), lambda r: F.struct(F.lit(0).alias("line"), r.alias("rule"), F.lit("exclude").alias("disposition")))

    def masked_line(line: Column, at: Column) -> Column:
        here = F.filter(in_text, lambda h: h["line"] == at + 1)
        tokens = F.transform(F.filter(here, lambda h: h["kind"] == "shape"), lambda h: h["unit"])
        assigned = F.aggregate(
            F.filter(here, lambda h: h["kind"] == "key"), line, lambda acc, h: F.replace(acc, h["unit"], secrets.redacted_assignment(h["unit"]))
        )
        whole = rewrite.rewrite(assigned, TOKEN, lambda m: F.when(F.array_contains(tokens, m), vocab.REDACTED).otherwise(m))
        return F.when(F.size(here) == 0, line).when(F.size(tokens) == 0, assigned).otherwise(whole)

    masked = F.array_join(F.transform(F.split(text, "\n"), masked_line), "\n")
    any_hit = F.size(in_text) > 0
    template = is_env_template(F.col(path))
    decided = joined.withColumns({
        "_decision": F.when(blocked, "blocked").when(any_hit & ~held, F.when(template, "blocked").otherwise("redacted")).otherwise(F.col("decision")),
        "_text": F.when(blocked | (any_hit & ~held & template), F.lit(None).cast("string")).when(any_hit & ~held, masked).otherwise(text),
        "_findings": F.when(blocked, excluded).when(any_hit, listed).otherwise(F.col("findings")),
    })
    decided = decided.drop("decision", "exported_text", "findings").withColumnsRenamed(
        {"_decision": "decision", "_text": "exported_text", "_findings": "findings"}
    )
    computed = ["decision", "exported_text", "findings"]
    return fence(decided, [c for c in columns if c not in computed], computed).select(*columns)
