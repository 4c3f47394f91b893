"""Preflight decisions, texts and findings on small written cases."""

import base64
import hashlib

import pytest

from pyspark.sql import functions as F

from docwarden.functions import secrets
from docwarden.operators.preflight import preflight, rule_histogram

VENDOR = "ghp" + "_" + hashlib.sha256(b"vendor").hexdigest()[:36]
OPAQUE = base64.urlsafe_b64encode(hashlib.sha384(b"opaque value").digest()).decode()[:44]
PLAIN = "mnbvcxzlkjhgfdsa"
HEADER = "-----BEGIN " + "PRIVATE KEY-----"

# path, content, decision, exported text (None when blocked), [(line, rule)]
CASES = [
    ("wiki/keys.md", HEADER + "\nbody\n", "blocked", None, [(1, "private_key_material")]),
    ("wiki/keys.md", "x\ny\n-----begin RSA X9 certificate-----", "blocked", None,
     [(3, "private_key_material")]),
    ("ops/mixer-notes.md", "refresh_token: violet-lamp\npassphrase = 'seven otters'\n", "redacted",
     "refresh_token: [REDACTED]\npassphrase = '[REDACTED]'\n",
     [(1, "credential_assignment"), (2, "credential_assignment")]),
    ("guide.md", "Each nightly run spends at most 12 tokens. Credential limits: see below.\n"
     "Fill in CLIENT_SECRET=<TOKEN> or keep CLIENT_SECRET=${ENV_VAR}; never CLIENT_SECRET=[REDACTED].\n", "safe", "=", []),
    ("guide/setup.md", "access_key: 1\nsigning_secret=<YOUR_TOKEN>\npassphrase=${PASSWORD}\ncredential=CHANGEME\n", "safe", "=", []),
    ("guide/setup.md", f"signing_secret=<{VENDOR}>\npassphrase=<plum jam>\n", "redacted",
     "signing_secret=[REDACTED]\npassphrase=[REDACTED] jam>\n",
     [(1, "credential_assignment"), (2, "credential_assignment")]),
    ("guide/setup.md", 'access_token=<YOUR_TOKEN>!\nprivate_key=${API_KEY}?\nSecret: "[REDACTED],"\n',
     "safe", "=", []),
    ("wiki/gateway.md", f"Call it with (Authorization: Bearer {PLAIN}) only.\n\n"
     "    private-key: four-crates\n\nEnd.\n", "redacted",
     "Call it with (Authorization: Bearer [REDACTED]) only.\n\n    private-key: [REDACTED]\n\nEnd.\n",
     [(1, "bearer_token"), (3, "credential_assignment")]),
    ("wiki/gateway.md", f"access-token={OPAQUE}\n", "redacted", "access-token=[REDACTED]\n",
     [(1, "credential_assignment")]),
    ("guide/lab.md", f"LAB_SECRET=green-kettle # for the bench\nrefresh-token: Bearer {PLAIN}\n",
     "redacted", "LAB_SECRET=[REDACTED] # for the bench\nrefresh-token: [REDACTED]\n",
     [(1, "credential_assignment"), (2, "credential_assignment")]),
    (".env.example", "LAB_SECRET=green-kettle\n", "blocked", None, [(1, "credential_assignment")]),
    ("notes.txt", f"\nfeeder_state={OPAQUE}\n", "blocked", None,
     [(1, "unknown_high_entropy_assignment")]),
    ("notes.txt", f"c: d\nchunk_digest={OPAQUE}\n", "safe", "=", []),
    ("notes.txt", f"text {OPAQUE} in prose", "safe", "=", []),
    ("notes.txt", "blob=" + "0123456789abcdef" * 4, "safe", "=", []),
    # A separator may span lines; the match starts on the key's line.
    ("n.md", "intro\n\npassword:\n  deep\nend", "redacted", "intro\n\npassword:\n  [REDACTED]\nend",
     [(3, "credential_assignment")]),
    # An earlier assignment swallows the key as its value.
    ("n.md", "note: password: abc", "safe", "=", []),
    # A key starts at a word boundary of Unicode text.
    ("n.md", "épassword: abc", "safe", "=", []),
    ("n.md", "é password: abc", "redacted", "é password: [REDACTED]",
     [(1, "credential_assignment")]),
    ("n.md", "password\u00a0: abc", "redacted", "password\u00a0: [REDACTED]",
     [(1, "credential_assignment")]),
    ("n.md", '{"clientSecret": "a\\"b c", "n": 1}', "redacted",
     '{"clientSecret": "[REDACTED]", "n": 1}', [(1, "credential_assignment")]),
    ("n.md", "\"password': abc", "safe", "=", []),
    ("n.md", f"the bearer {PLAIN} beside a bearer of news", "redacted",
     "the bearer [REDACTED] beside a bearer of news", [(1, "bearer_token")]),
    ("n.md", "Authorization: Bearer CHANGEME", "safe", "=", []),
    ("n.md", "Authorization: Bearer CHANGEME2", "redacted", "Authorization: Bearer [REDACTED]",
     [(1, "bearer_token")]),
    ("n.md", "secret_count: 4 password_policy: strict", "safe", "=", []),
    ("n.md", 'token = "abc"', "safe", "=", []),
    ("n.md", "", "safe", "=", []),
]

PATHS = {
    "path_environment_file": ["srv/.env", ".env.stage2", "A/.ENV.x"],
    "path_dependency_or_build_artifact": ["k/vendor/q.md", "site/node_modules/z.js", "x/Dist/y.md"],
    "path_sensitive_or_generated_data": [
        "q/database/rows.md", "uploads/otter.md", "payroll/q3.md", "n/medical/visit.md",
        "health-data/w.md", "payroll-export/w.md", "HealthDumps/w.md", "customerraw/w.md",
        "exports/customerList.md", "medicalExport/w.md", "health-record-policy/w.md",
        "a/generated-documents/b.md", "customer/x/raw.md", "my-upload/x.md",
    ],
    "path_binary_or_dump_candidate": ["a/b.PDF", "x.tar", "q/.sql", "f.woff2"],
    None: [
        "k/.env.example", ".env.sample", "k/.env.template", "n/health-guidelines.md",
        "n/payroll-data-sample.md", "n/customer-template.md", "n/medical-visit.md",
        "n/upload-example/x.md", "a//./b.md", "environment/x.envy",
    ],
}


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, path, text) for i, (path, text, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, relative_path string, content string")
    return {r["i"]: r for r in preflight(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_decision_text_and_findings(scanned, i):
    _, text, decision, exported, findings = CASES[i]
    row = scanned[i]
    assert row["decision"] == decision
    assert row["exported_text"] == (text if exported == "=" else exported)
    assert [(f["line"], f["rule"]) for f in row["findings"]] == findings


def test_path_rules(spark):
    rows = [(p, r) for r, paths in PATHS.items() for p in paths]
    df = spark.createDataFrame([(p, "prose") for p, _ in rows], "relative_path string, content string")
    got = {r["relative_path"]: r for r in preflight(df).collect()}
    for path, rule in rows:
        found = got[path]["findings"]
        assert [f["rule"] for f in found] == ([rule] if rule else []), path
        assert all(f["line"] == 0 and f["disposition"] == "exclude" for f in found)
        assert got[path]["decision"] == ("blocked" if rule else "safe"), path


def test_bytes(spark):
    rows = [("a.txt", bytearray(b"plain\x00data")), ("b.txt", bytearray(b"\xff\xfe")),
            ("c.txt", bytearray("pässword".encode()))]
    df = spark.createDataFrame(rows, "relative_path string, content binary")
    got = {r["relative_path"]: r for r in preflight(df).collect()}
    assert got["a.txt"]["findings"][0]["rule"] == "binary_content"
    assert got["b.txt"]["findings"][0]["rule"] == "undecodable_content"
    assert got["a.txt"]["findings"][0]["disposition"] == "blocked_review"
    assert got["c.txt"]["decision"] == "safe"
    assert got["c.txt"]["exported_text"] == "pässword"


def test_staging_policy_keeps_text_and_reports(spark):
    text = f"{HEADER}\nAuthorization: Bearer {PLAIN}\nblob={OPAQUE}\npassword: CHANGEME\n"
    rows = [(".env", text, "allow_project_staging"), (".env", text, "exclude"),
            ("vendor/x.md", text, "allow_project_staging")]
    df = spark.createDataFrame(rows, "relative_path string, content string, policy string")
    held, plain, vendor = preflight(df, policy="policy").collect()
    assert held["decision"] == "safe" and held["exported_text"] == text
    assert [(f["line"], f["rule"]) for f in held["findings"]] == [
        (1, "credential_material_allowed"),
        # the assignment, the authorization pattern and the bare pattern each report the line
        (2, "credential_assignment_allowed"),
        (2, "credential_assignment_allowed"),
        (2, "credential_assignment_allowed"),
        (3, "credential_assignment_allowed"),
    ]
    assert plain["findings"][0]["rule"] == "path_environment_file"
    assert vendor["findings"][0]["rule"] == "path_dependency_or_build_artifact"


def test_redaction_is_idempotent(spark):
    rows = [(p, t) for p, t, *_ in CASES]
    df = spark.createDataFrame(rows, "relative_path string, content string")
    once = preflight(df).filter("decision = 'redacted'")
    twice = preflight(once.select("relative_path", F.col("exported_text").alias("content")))
    assert {r["decision"] for r in twice.collect()} == {"safe"}


def test_long_quoted_value_and_many_assignments(spark):
    long_line = 'secret="' + 'a\\"' * 400_000 + '"\n'
    many = "".join(f"key{i}: value\n" for i in range(20_000)) + "password: x\n"
    df = spark.createDataFrame([("a.md", long_line), ("b.md", many)],
                               "relative_path string, content string")
    got = {r["relative_path"]: r for r in preflight(df).collect()}
    assert got["a.md"]["exported_text"] == 'secret="[REDACTED]"\n'
    assert got["b.md"]["findings"][0]["line"] == 20_001


def test_rule_histogram(spark):
    df = spark.createDataFrame([(p, t) for p, t, *_ in CASES], "relative_path string, content string")
    counts = {r["rule"]: r["findings"] for r in rule_histogram(preflight(df)).collect()}
    expected = {}
    for case in CASES:
        for _, rule in case[4]:
            expected[rule] = expected.get(rule, 0) + 1
    assert counts == expected


KEYS = {
    "preflight": (["api_key", "LAB_PASSWORD", "labSecret", "refresh-token", "authorization"],
                  ["token", "secretCount", "password_policy", "key", "apikey", "tokenBudget"]),
    "registry": (["apiToken", "apikey", "token", "my_token", "privateKeyPem", "db.password"],
                 ["credential_sources", "token_budget", "/opt/secret", "C:\\secret", "secret_rules",
                  "passphrase"]),
    "audit": (["api_token", "Content", "task-payload", "items", "my_private_key_id", "client secret"],
              ["token_budget", "content_hash", "item_count", "document_ids"]),
    "transport": (["signingSecret", "ACCESS_TOKEN", "private-key"],
                  ["private_key_id", "total_tokens", "items"]),
}


@pytest.mark.parametrize("family", KEYS)
def test_key_families(spark, family):
    sensitive, plain = KEYS[family]
    df = spark.createDataFrame([(k,) for k in sensitive + plain], "k string")
    got = {r[0] for r in df.filter(secrets.is_sensitive_key(F.col("k"), family)).collect()}
    assert got == set(sensitive)


def test_credential_values(spark):
    shapes = [
        ("Bearer " + PLAIN + "poiu", True, True),
        (VENDOR, True, True),
        ("github_pat_" + "a" * 22, True, False),
        ("AKIA" + "A1B2C3D4E5F6G7H8", True, True),
        ("eyJ" + "abcde.fghij.klmno", True, True),
        ("password: plum", True, True),
        ("password: <TOKEN>", False, True),
        ("api key = CHANGEME, secret: 'x y'", True, True),
        ("private key: abc", False, True),
        (HEADER + "\nabc\n-----END " + "PRIVATE KEY-----", True, True),
        (HEADER + "\nabc\n-----END " + "CERTIFICATE-----", False, False),
        ("twelve tokens a night", False, False),
    ]
    df = spark.createDataFrame([(s[0],) for s in shapes], "v string").coalesce(1)
    got = df.select(secrets.has_credential_value(F.col("v"), "audit").alias("audit"),
                    secrets.has_credential_value(F.col("v"), "registry").alias("registry"),
                    secrets.mask_credentials(F.col("v")).alias("masked")).collect()
    assert [(r["audit"], r["registry"]) for r in got] == [(a, b) for _, a, b in shapes]
    assert got[5]["masked"] == "<redacted>"
    assert got[7]["masked"] == "api key = CHANGEME, <redacted>"
