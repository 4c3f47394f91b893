"""Scalar functions on written cases."""

import json
import re
import unicodedata

from pyspark.sql import functions as F

from docwarden.functions import jsontree, jsonwalk, paths, secrets, text, times


def values(spark, rows, expr, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema).coalesce(1)
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_casefold_and_slugs(spark):
    assert values(spark, ["Straße ﬁn ΑΣ", "ABC", "İ", "ŉx"], text.casefold) == [
        s.casefold() for s in ["Straße ﬁn ΑΣ", "ABC", "İ", "ŉx"]]
    assert values(spark, ["  Export Calendario! ", "Größe", "---", "É a"], text.slug) == [
        "export-calendario", "gr-sse", None, "a"]
    assert values(spark, ["Dépôt Élan", "Größe", "ﬁve ½ Ĳ", "日本"], text.ascii_slug) == [
        "depot-elan", "groe", "five-12-ij", None]
    subject = values(spark, ["entity:" + "x" * 100, "!!!"], text.subject_slug)
    assert subject[0].startswith("entity-" + "x" * 65 + "-") and len(subject[0]) == 83
    assert subject[1].startswith("relation-")
    assert values(spark, ["a-b1", "a--b", "A", ""], text.is_tag_component) == [
        True, False, False, False]


def test_paths(spark):
    assert values(spark, ["a//./b", "a\\b", "/a", "a/../b", "", "C:\\x", "./a/."],
                  paths.normalize_path) == ["a/b", "a/b", None, None, None, None, "a"]
    assert values(spark, ["/srv/a/b"], paths.ancestors) == [["/srv", "/srv/a", "/srv/a/b"]]
    got = values(
        spark, [None, "", "docs/a", "docs/secret/x", "src/a", "/home", "//x", "../a", "docsx/a"],
        lambda p: paths.path_in_prefixes(p, F.lit("route"), ["docs"], ["docs/secret/"], ["Route"]))
    assert got == ["ok", "invalid_path", "ok", "excluded", "outside_policy", "ok", "ambiguous_url",
                   "unsafe_path", "outside_policy"]


def test_entropy(spark):
    got = values(spark, ["aaaa", "abcd", "0123456789abcdef", "aab"], secrets.shannon_entropy)
    assert [round(g, 6) for g in got] == [0.0, 2.0, 4.0, 0.918296]


def test_times(spark):
    got = values(spark, ["2026-09-01 17:20", "2026-01-05 08:00", "2026-10-25 02:30",
                         "2026-03-29 02:30", "2026-13-01 00:00"], times.local_to_offset_iso)
    assert got == ["2026-09-01T17:20:00+02:00", "2026-01-05T08:00:00+01:00",
                   "2026-10-25T02:30:00+02:00", "2026-03-29T02:30:00+01:00", None]
    assert values(spark, got[:4] + ["2026-09-01T17:20:00+00:00"], times.is_zone_offset) == [
        True, True, True, False, False]
    assert values(spark, ["2026-09-01T17:20:00+02:00", "2026-09-01T17:20:00", "2026-09-01T17:20Z",
                          "2026-02-30T00:00:00Z", None], times.is_offset_iso) == [
        True, False, True, False, False]


DIAGNOSTIC = {
    "token_budget": 800, "content_hash": "abc", "apiToken": "x", "private-key": "y",
    "Content": "body", "taskPayload": {"a": 1}, "items": [1, 2],
    "nested": [{"password": "p", "note": "secret: hunter2", "keep": None, "ok": True}],
    "text": json.dumps({"refresh_token": "r", "n": 1.5}),
    "long": "z" * 600, "many": list(range(150)),
}


def test_ascii_slug_of_every_plane(spark):
    plain = lambda c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    chars = [c for i, c in enumerate(chars) if plain(c) or i % 499 == 0]
    expected = [re.sub("[^a-z0-9]+", "-", f"x{plain(c)}y".lower()) for c in chars]
    rows = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(chars)], "i int, v string")
    got = [r[0] for r in rows.orderBy("i").select(text.ascii_slug(F.col("v"))).collect()]
    assert [(c, g) for c, g, e in zip(chars, got, expected, strict=True) if g != e] == []


def test_sanitize(spark):
    raw = json.dumps(DIAGNOSTIC)
    got = json.loads(values(spark, [raw], jsontree.sanitize_json)[0])
    assert got == {
        "token_budget": 800, "content_hash": "abc", "apiToken": "<redacted>",
        "private-key": "<redacted>",
        "nested": [{"password": "<redacted>", "note": "<redacted>", "keep": None, "ok": True}],
        "text": '{"n":1.5,"refresh_token":"<redacted>"}', "long": "z" * 512,
        "many": list(range(100)),
    }
    kept = json.loads(values(spark, [raw], lambda v: jsontree.sanitize_json(v, keep_listings=True))[0])
    assert kept["items"] == [1, 2] and "Content" not in kept
    assert values(spark, ["plain password=abc"], jsontree.sanitize_json) == ["plain <redacted>"]
    df = spark.range(1).select(F.create_map(
        F.lit("apiKey"), F.lit("v"), F.lit("body"), F.lit("b"), F.lit("n"), F.lit("ok")).alias("m"))
    assert df.select(jsontree.sanitize_map(F.col("m"))).first()[0] == {"apiKey": "<redacted>", "n": "ok"}


def test_sanitize_far_down(spark):
    deep = {"password": "p", "note": "token sk-" + "a" * 24, "text": json.dumps({"x": json.dumps({"api_key": "k", "z": [1]})})}
    expected = {"password": "<redacted>", "note": "token <redacted>", "text": json.dumps({"x": '{"api_key":"<redacted>","z":[1]}'}, separators=(",", ":"))}
    for level in range(40):
        deep, expected = {"a": [deep, {"content": 1}], "b": level}, {"a": [expected, {}], "b": level}
    rows = [json.dumps(deep), '{"a": [1, 2', '{"a": tru}', "[" * 1200 + "]" * 1200, None, '{"b":[],"a":{}, "c": "\\u00e9\\n", "d": 1e3, "\\"q": null}']
    got = values(spark, rows, jsontree.sanitize_json)
    assert json.loads(got[0]) == expected
    assert got[1:3] == rows[1:3] and got[3] == "[" * 512 and got[4] is None
    assert json.loads(got[5]) == json.loads(rows[5])


def test_walk_steps_by_runs_of_values(spark):
    """A step of the machine takes a run of scalars; one a token would be thousands here."""
    rows = spark.createDataFrame([(json.dumps({"a": list(range(2000)), "b": {str(i): i for i in range(1000)}}),)], "v string")
    keys, tokens = jsonwalk.items(F.col("v"))
    units = F.transform(F.arrays_zip(keys.alias("k"), tokens.alias("t")), lambda u: F.struct(jsonwalk.kind(u["t"]).alias("c")))
    count = {"steps": "a.steps + 1"}
    made = jsonwalk.walk(units, {}, {"steps": ("int", "0")}, run={}, open_={}, close={}, note_run=count, note_open=count)
    got = rows.select(made.alias("m")).select("m.valid", "m.steps").first()
    assert tuple(got) == (True, 5)  # three containers and two runs; ends are not counted


def test_walk_refuses_text_behind_a_value(spark):
    ends = ["x", ",", "}", "]", "{", ":", '"', " 1", "null", '"a": 1', "{}"]
    rows = [value + end for value in ('{"token":1}', "[1]", '"x"', "null") for end in ends if value + end != "nullnull"]
    assert values(spark, rows, jsontree.sanitize_json) == rows
    assert values(spark, [*rows, "nullnull", '"a":1'], lambda v: jsontree.config_contains(v, v)) == [False] * (len(rows) + 2)
    assert values(spark, ['{"token":1,"b":[1,{"password":"x"}],"a":2}'], jsontree.sanitize_json) == ['{"a":2,"b":[1,{"password":"<redacted>"}],"token":"<redacted>"}']


def test_list_cap_and_equal_keys_across_runs(spark):
    mixed = json.dumps([*range(98), {"a": 1}, [2], {"b": 3}, 4], separators=(",", ":"))
    kept = json.dumps([*range(98), {"a": 1}, [2]], separators=(",", ":"))
    masked = '{"password: a1":1,"z":[2],"password: b2":{"x":3},"password: c3":4,"body":[5],"y":6}'
    got = values(spark, [mixed, masked], jsontree.sanitize_json)
    assert got == [kept, '{"<redacted>":4,"y":6,"z":[2]}']


def test_masking_with_and_without_placeholders(spark):
    rows = ["password: a1 and secret=b2", "password: <TOKEN> and secret=b2", "password: <TOKEN>", "plain", ""]
    got = values(spark, rows, secrets.mask_credentials)
    assert got == ["<redacted> and <redacted>", "password: <TOKEN> and <redacted>", "password: <TOKEN>", "plain", ""]


def test_sanitised_events_are_spread_over_cores(spark, tmp_path):
    """One file with one row group is worked on by every core, rows whole."""
    from workloads import relation_queries

    events = spark.range(5000).selectExpr("if(id % 7 = 0, null, id) event_id", "id % 50 user_id", "if(id % 3 = 0, 'view', null) event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    rows = relation_queries.metadata_sanitized(spark, str(tmp_path))
    parts = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 5000
    assert len(parts) >= spark.sparkContext.defaultParallelism


def test_secret_scan(spark):
    deep, clean = {"password": 1}, {"note": 1}
    for _ in range(30):
        deep, clean = {"a": [deep]}, {"a": [clean]}
    rows = [json.dumps(x) for x in (
        {"a": {"b": [{"password": 1}]}}, {"a": ["secret: plum"]}, {"token_budget": 3}, deep, clean)]
    rows += ['{"a": 1, "a": {"password": "x"}}', '{"\\u0070assword": 1}', '{"note": "a \\"b\\" : c"}', "[1]"]
    assert values(spark, rows, jsontree.has_secrets) == [True, True, False, True, False, True, True, False, False]
    assert values(spark, rows, jsontree.is_json_object) == [True] * 5 + [False, True, True, False]
    assert values(spark, ['{"token": 1}', '{"credential_sources": ["a"]}'],
                  lambda v: jsontree.has_secrets(v, "registry")) == [True, False]


def test_config_contains(spark):
    actual = json.dumps({"a": {"b": 1, "c": [1, 2]}, "d": "5"})
    rows = [json.dumps(e) for e in ({}, {"a": {"b": 1}}, {"a": {"b": "1"}}, {"a": {"c": [1, 2]}},
                                    {"a": {"c": [1]}}, {"d": 5}, {"x": None})]
    got = values(spark, rows, lambda v: jsontree.config_contains(F.lit(actual), v))
    assert got == [True, True, False, True, False, False, False]
    below, above = '{"x": 1}', '{"x": 1, "y": 2}'
    for _ in range(25):
        below, above = '{"k": %s}' % below, '{"k": %s, "z": 0}' % above
    assert values(spark, [below, above, '{"x": 1}'], lambda v: jsontree.config_contains(F.lit(above), v)) == [True, True, False]
    assert values(spark, [above, "no json"], lambda v: jsontree.config_contains(F.lit(below), v)) == [False, False]
    lists = '{"a": [{"x": 1, "y": [2]}, []], "n": 1.0, "t": true, "e": "\\u0061"}'
    rows = ['{"a": [{"y": [2], "x": 1.0}, []]}', '{"a": [{"y": [2]}, []]}', '{"a": [{"x": 1, "y": [2]}]}', '{"n": 1, "t": 1, "e": "a"}', '{"t": 0}', '{"a": {}}', '{"n": 1, "n": 1}']
    assert values(spark, rows, lambda v: jsontree.config_contains(F.lit(lists), v)) == [True, False, False, True, False, False, False]
    nested = '{"k":' * 300 + "1" + "}" * 300
    assert values(spark, [nested, "[" * 1200 + "]" * 1200], lambda v: jsontree.config_contains(v, v)) == [True, False]
