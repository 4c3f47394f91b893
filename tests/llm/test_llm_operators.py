"""Operators of the subpackage llm beside brute force, on small inputs with every odd case."""

import collections
import hashlib
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from docwarden.llm import op01_sharding, op02_toxicity, op03_license_scan, op04_warc, op05_exact_dedup
from docwarden.llm import op06_jaccard_join, op07_fingerprints, op08_mixing, op09_bpe, op10_quality_gam

ODD = "doc_id long, text string, lang string, source string, n_chars long, row long, bucket string, entry int, class string, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and ids, clashing columns."""
    words = [hashlib.md5(str(i).encode()).hexdigest()[: 3 + i % 6] for i in range(400)]
    base = " ".join(words[:120])
    texts = [
        (0, None), (1, ""), (2, " \t\n"), (3, base), (4, base + "  "), (5, base.upper()), (6, base + " tail"),
        (7, " ".join(words[:118] + ["x", "y"])), (8, "two words"), (9, "Two words"), (10, "one"), (None, base + " tail"),
        (12, "Naïve Ωmega.\nUnder the MIT License! It's 10% <|endoftext|> done.\n" * 3), (13, " ".join(words * 60)),
        (14, " ".join(words * 60)), (15, "a.b.c\n\n\nd"), (15, "other text of the same id"), (16, base[::-1]), (16, base[::-1]),
        (None, None), (18, "\x00 \x1c nul"), (19, "cc by nc 4"), (20, "Licensed under the Apache License, Version 2.0."),
    ]
    return [(i, t, None, "s", None, 1, "b", 2, "c", "d") for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (8, 0, 1), (13, 1, 0), (13, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def text_of(rows):
    return [(r[0], r[1] or "") for r in rows]


# ---------------------------------------------------------------- 1


def extendible(rows, limit):
    """Shards by splitting one bucket at a time: {(depth, prefix): ids}."""
    codes = [(int(hashlib.sha256(str(i).encode()).hexdigest()[:15], 16), size, i) for i, size in rows]
    open_, done = [(0, 0, codes)], {}
    while open_:
        depth, prefix, held = open_.pop()
        if sum(x[1] for x in held) <= limit or len(held) == 1:
            done[depth, prefix] = sorted(x[2] for x in held)
            continue
        for bit in (0, 1):
            part = [x for x in held if (x[0] >> (59 - depth)) & 1 == bit]
            if part:
                open_.append((depth + 1, 2 * prefix + bit, part))
    return done


@pytest.mark.parametrize("limit", [1 << 20, 5000, 200])
def test_shards_are_those_of_single_splits(spark, limit):
    rows = [(i, "x" * (i * 37 % 900 if i % 50 else 9000)) for i in range(600)]
    got = op01_sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), limit).collect()
    shards = collections.defaultdict(list)
    for r in got:
        shards[tuple(map(int, r.shard_id.split(":")))].append(r.doc_id)
        assert r.shard_bytes <= limit or r.shard_rows == 1
    assert {k: sorted(v) for k, v in shards.items()} == extendible([(i, len(t) + 16) for i, t in rows], limit)


def test_shards_of_one_id_still_fit(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("y" * 84).alias("text"))
    got = op01_sharding.assign_shards(rows, 2000).agg(F.max("shard_bytes"), F.count("*"), F.sum("n_bytes")).first()
    assert got[0] <= 2000 and got[1] == 4000 and got[2] == 400_000


def test_written_shards(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("z"), 100).alias("text"), F.lit(1).alias("code"), F.lit(2).alias("shard_id"))
    op01_sharding.write_shards(docs, str(tmp_path / "shards"), 4000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 300 and back.select("_shard").distinct().count() > 5


# ---------------------------------------------------------------- 2, 8, 10: fitted models


def test_toxicity_of_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = op02_toxicity.toxicity(docs, labels.filter(~apart)).select("doc_id", F.col("toxic").alias("said"), "p_toxic")
    rows = scored.join(labels.filter(apart), "doc_id").collect()
    toxic, clean = [r.said for r in rows if r.toxic], [r.said for r in rows if not r.toxic]
    assert sum(toxic) > 0.7 * len(toxic) and sum(clean) < 0.02 * len(clean)


def test_chain_uses_out_of_fold_predictions(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.random((300, 5)) < 0.3).astype(float)
    y = np.column_stack([x[:, 0], np.maximum(x[:, 0], x[:, 1])])
    seen = []
    real = op02_toxicity.fit_logistic
    monkeypatch.setattr(op02_toxicity, "fit_logistic", lambda x, y: seen.append(x.shape) or real(x, y))
    chain = op02_toxicity.fit_chain(np.zeros(0), x, y, np.arange(300) % 5)
    assert seen == [(300, 5), *[(240, 5)] * 5, (300, 6)]
    assert ((chain.score(x)[:, 1] > 0.5) == y[:, 1]).mean() > 0.99


def test_quality_of_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = op10_quality_gam.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = [r.predicted for r in rows if r.quality], [r.predicted for r in rows if not r.quality]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.15 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_learns_from_no_held_out_label(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = labels.withColumn("quality", F.when(op10_quality_gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in op10_quality_gam.quality_scores(docs, x).collect()} for x in (labels, other))
    assert one == two


def test_mixture_meets_its_targets(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")  # the smallest has too few labels to tell domains apart
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    targets = {"clean": 0.7, "junk": 0.2, "toxic": 0.1}
    got = op08_mixing.mixing_rates(docs, op08_mixing.label_domains(labels), targets).toPandas()
    tokens = {r.doc_id: len(re.findall(r"[^ \t\n\x0b\x0c\r\x00]+", r.text)) for r in docs.collect()}
    assert dict(zip(got.doc_id, got.n_tokens)) == tokens
    for name, weight in targets.items():
        assert abs((got.rate * got.n_tokens * got[f"p_{name}"]).sum() / got.n_tokens.sum() / weight - 1) < 0.01
    assert (got.rate >= 0).all() and ((got.copies - got.rate).abs() < 1).all()


def test_rates_of_a_known_problem(spark):
    """Two pure domains: the rates are target over present share."""
    table = spark.createDataFrame([(10, [1.0, 0.0])] * 9 + [(10, [0.0, 1.0])], "n_tokens long, p array<double>")
    rated, steps = op08_mixing.fit_rates(table, {"a": 0.5, "b": 0.5}, 1e-3)
    rates = {tuple(r.p): r.rate for r in rated.collect()}
    assert abs(rates[1.0, 0.0] - 5 / 9) < 1e-3 and abs(rates[0.0, 1.0] - 5) < 1e-2 and len(steps) > 15


def test_rates_of_scarce_domains(spark):
    """Shares of 86.8, 0.2 and 13 %: plain steps would leave the junk at half its target."""
    rows = [(868, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (130, [0.0, 0.0, 1.0])]
    table = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    rated, steps = op08_mixing.fit_rates(table, {"clean": 0.9, "junk": 0.06, "toxic": 0.04})
    for r in rated.collect():
        target = 1000 * sum(x * y for x, y in zip(r.p, (0.9, 0.06, 0.04)))
        assert abs(r.n_tokens * r.rate / target - 1) < op08_mixing.TOLERANCE
        rate = 1.0
        for step in steps:
            rate = max(0.0, rate - float(step @ r.p))
        assert abs(rate - r.rate) < 1e-9 * r.rate


def test_targets_out_of_reach_end_at_least_squares(spark):
    """Only the first kind is used: S = R (0.6, 0.4) with R = 1 / (0.36 / 0.1 + 0.16 / 0.9)."""
    table = spark.createDataFrame([(30, [0.6, 0.4]), (70, [0.8, 0.2])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="least-squares optimum.* a [+]58.*b -88"):
        rated, _ = op08_mixing.fit_rates(table, {"a": 0.1, "b": 0.9})
    rows, best = rated.collect(), 1 / (0.36 / 0.1 + 0.16 / 0.9)
    for place, target in ((0, 0.1), (1, 0.9)):
        assert abs(sum(r.n_tokens * r.rate * r.p[place] for r in rows) / 100 - best * (0.6, 0.4)[place]) < op08_mixing.TOLERANCE * target


def test_mixing_repeats_whole_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("rate", F.lit("mine"))
    domains = op08_mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = op08_mixing.mix_documents(docs, domains)
    assert mixed.columns == docs.columns and mixed.exceptAll(docs).join(docs, "doc_id", "left_anti").count() == 0
    times = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    expected = {r.doc_id: r.copies for r in op08_mixing.mixing_rates(docs, domains).collect() if r.copies}
    assert times == expected


# ---------------------------------------------------------------- 3


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = []
    for phrase, label in op03_license_scan.BASE.items():
        want = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(want)] == want]
    return len(words), sorted(places)


def test_base_scan_equals_brute_force(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    extra = spark.createDataFrame([(900, "under the mit license under the mit license"), (901, "under the MIT-License x cc.by,nc cc by nc")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    expected, hits = collections.Counter(), 0
    for r in docs.collect():
        n, places = base_places(r.text)
        hits += len(places)
        labels = ",".join(sorted({p[1] for p in places}))
        expected[r.doc_id, n, len(places), places[0][0] if places else None, places[-1][0] if places else None, labels] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in op03_license_scan.license_scan(docs).collect())
    assert got == expected and hits >= 7


@pytest.mark.parametrize("text, accepted", [
    ("a b c d", True), ("a c d", True), ("A, (b) c-d", True), ("a b d", False), ("a x c d", False), ("a b c e d", False),
    ("q 1 end", True), ("q 1 2 end", True), ("q 1 2 3 end", True), ("q end", False), ("q 1 2 3 4 end", False), ("q 1 z end", False),
])
def test_templates_need_their_mandatory_wording(text, accepted):
    machine = op03_license_scan.compile_templates({
        "one": "a <<beginOptional>>b<<endOptional>> c d", "two": 'q <<var;name="n";match="[0-9]+";words="1-3">> end',
    })
    _, found = op03_license_scan.scan_block(machine, sorted(machine.first_words()), [text.encode()])
    assert bool(found[0]) == accepted


def test_nested_optional_regions_and_errors():
    machine = op03_license_scan.compile_templates({"n": "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d"})
    run = lambda text: machine.matches(iter(text.encode().split()))
    assert [bool(run(t)) for t in ("a d", "a b d", "a b c d", "a c d")] == [True, True, True, False]
    for bad in ("a <<endOptional>>", "a <<beginOptional>>b", "a <<what>> b"):
        with pytest.raises(ValueError):
            op03_license_scan.compile_templates({"x": bad})
    with pytest.raises(ValueError):
        op03_license_scan.compile_templates({"x": '<<var;match="a">> b'}).first_words()


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    long = "payload Ω\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
    rows = [
        (1, "http://a/ b", long), (2, None, long), (3, "http://c#page=9&same=1", long + "x"), (4, "http://d", None), (5, "http://e", ""),
        (6, "http://f", "short"), (7, "http://f", "short"), (8, "http://g", "é" * 600), (9, "http://g", "é" * 600), (None, "http://h", long), (9, "http://g", "other"),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = collections.Counter(map(tuple, op04_warc.convert_pages(pages, version).drop("url").collect()))
    expected = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None)
        revisit = page is not None and len(data) >= 1000 and page < top
        expected[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert got == expected


def test_arc_is_read_by_declared_length_and_version():
    for version in (1, 2):
        payload = b"http://fake 1.2.3.4 20000101000000 text/html 3\nabc"
        data = op04_warc.arc_filedesc("x.arc", version) + b"\n" + op04_warc.arc_record("http://a", "20240102030405", "text/html", payload, version, "x.arc", 7) + b"\n"
        ((header, read),) = op04_warc.read_arc(data)
        assert read == payload and tuple(header) == op04_warc.ARC_FIELDS[version]
        record = op04_warc.warc_record(header, read, "5", None)
        ((fields, block),) = op04_warc.read_warc(record + b"\r\n\r\n")
        assert block == payload and fields["warc-date"] == "2024-01-02T03:04:05Z"
        with pytest.raises(ValueError):
            list(op04_warc.read_arc(data[:-9]))


# ---------------------------------------------------------------- 5


def groups_by_content(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((i, t))
    best = lambda held: min(held, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
    return collections.Counter(
        (i, best(held), len(held), hashlib.sha256(content.encode()).hexdigest()) for content, held in groups.items() for i, _ in held
    )


@pytest.mark.parametrize("bucket_bytes", [32 << 20, 200])
def test_exact_duplicates_equal_brute_force(spark, odd, bucket_bytes):
    got = op05_exact_dedup.exact_duplicates(odd, bucket_bytes).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == groups_by_content(text_of(odd.collect()))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_open_addressing_compares_contents():
    table = op05_exact_dedup.ContentTable()
    assert [table.place(7, str(i % 3000).encode()) for i in range(6000)] == [(i % 3000, i < 3000) for i in range(6000)]


def test_kept_rows_have_all_columns(spark, odd):
    rows = op05_exact_dedup.drop_exact_duplicates(odd)
    assert rows.columns == odd.columns
    assert rows.count() == len({re.sub(r"\s", "", t) for _, t in text_of(odd.collect()) if "\x1c" not in t}) + 1


# ---------------------------------------------------------------- 6


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def components_by_pairs(rows, min_shared, width):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    find = lambda x: x if label[x] == x else find(label[x])
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= min_shared * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("min_shared, width, members", [(85, 4, 1024), (80, 5, 3), (60, 2, 2)])
def test_components_equal_all_pairs(spark, odd, monkeypatch, min_shared, width, members):
    monkeypatch.setattr(op06_jaccard_join, "BLOCK_MEMBERS", members)
    rows = text_of(odd.collect())
    words = [f"w{i}" for i in range(40)]
    for i in range(60):  # a large group of near copies, and chains
        changed = list(words)
        changed[i * 7 % 40] = f"x{i % 5}"
        rows.append((100 + i, " ".join(changed[: 40 - i % 3])))
        rows.append((200 + i, " ".join(f"c{k}" for k in range(i, i + 20))))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pivot int").repartition(4)
    got = op06_jaccard_join.jaccard_components(docs, min_shared, width).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_by_pairs(rows, min_shared, width)


def test_near_copies_leave_one_document(spark, odd):
    rows = op06_jaccard_join.drop_near_duplicates(odd, 85, 4)
    assert rows.columns == odd.columns
    ids = collections.Counter(r.doc_id for r in rows.collect())
    assert ids[3] == 1 and not ids[4] and not ids[5] and not ids[6] and ids[1] == ids[2] == ids[0] == 1 and ids[13] == 1 and not ids[14]


def test_tree_finds_what_pairs_find():
    import numpy as np

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, size=int(rng.integers(5, 60)))) for _ in range(90)]
    sets += [np.unique(np.concatenate([s[1:], pool[:1]])) for s in sets]
    signed, found = op06_jaccard_join.Signatures(sets), op06_jaccard_join.Components(len(sets))
    tree = signed.tree(np.arange(len(sets)))
    op06_jaccard_join.dual_traversal(tree, tree, sets, found, 85)
    other = op06_jaccard_join.Components(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if op06_jaccard_join.links(sets[a], sets[b], 85):
                other.join(a, b)
    same = lambda c: {frozenset(np.flatnonzero(c.label == x).tolist()) for x in set(c.label.tolist())}
    assert same(found) == same(other) and len(same(found)) < len(sets)


# ---------------------------------------------------------------- 7


def paragraphs(text):
    parts = (p[1:] if p.startswith(" ") else p for p in re.split("[\n\r.!?\x00]", text))
    return collections.Counter(p for p in parts if p)


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    every = sum((a | b).values())
    return sum((a & b).values()) / every if every else 1.0


def test_fingerprints_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "a. a. a.\na"), (10_003, "x" * 30_001)], "doc_id long, text string"))
    rows = sorted(text_of(docs.collect()))
    got = {r.doc_id: r for r in op07_fingerprints.fingerprints(docs.withColumn("part", F.lit(1)).repartition(5)).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - near(text, edited)) < 1e-9 and abs(r.near_next - near(text, after)) < 1e-9
    texts = dict(rows)
    by_text = collections.defaultdict(set)
    for i, r in got.items():
        by_text[texts[i]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r.near_edited for r in got.values()) > 5 * sum(r.near_next for r in got.values())


def test_fingerprints_of_odd_rows(spark, odd):
    got = op07_fingerprints.fingerprints(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    alone = op07_fingerprints.fingerprints(odd.filter("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_peeling_lists_the_difference():
    import numpy as np

    old, new = [b"a. b. c. c", b"same", b"x. " * 2], [b"a. c. d", b"same", b""]
    a, b = op07_fingerprints.paragraph_keys(old), op07_fingerprints.paragraph_keys(new)
    pair, key, sign, took = op07_fingerprints.differences(3, a, b, 3)
    for n in range(3):
        mine, other = set(a[1][a[0] == n].tolist()), set(b[1][b[0] == n].tolist())
        assert set(key[(pair == n) & (sign == 1)].tolist()) == mine - other
        assert set(key[(pair == n) & (sign == -1)].tolist()) == other - mine
    assert took[0] > 3 and np.all(took % 3 == 0)


# ---------------------------------------------------------------- 9


def test_bpe_equals_the_library(spark, sf_dir, odd):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(op09_bpe.default_path())
    known.no_truncation(), known.no_padding()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    expected = collections.Counter()
    for i, text in text_of(docs.collect()):
        ids = known.encode(text, add_special_tokens=False).ids
        decoded = known.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, op09_bpe.bpe_digests(docs).collect())) == expected
    coded = op09_bpe.bpe_encode(docs).collect()
    assert sum(len(r.ids) for r in coded) == sum(n * k[1] for k, n in expected.items())
    model = op09_bpe.tokenizer(op09_bpe.default_path())
    assert all(model.decode(struct.pack(f"<{len(r.ids)}I", *r.ids)) == r.decoded for r in coded[:50])


def test_bpe_of_every_letter():
    tokenizers = pytest.importorskip("tokenizers")
    known, model = tokenizers.Tokenizer.from_file(op09_bpe.default_path()), op09_bpe.WordBpe(op09_bpe.default_path())
    texts = [f"a{chr(c)}b {chr(c)}c" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for text, (ids, _) in zip(texts, model.encode(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == known.encode(text, add_special_tokens=False).ids, repr(text)


# ---------------------------------------------------------------- empty tables, odd rows, whole pipeline

RUNS = {
    1: lambda docs, labels: op01_sharding.assign_shards(docs),
    2: lambda docs, labels: op02_toxicity.toxicity(docs, labels),
    3: lambda docs, labels: op03_license_scan.license_scan(docs),
    5: lambda docs, labels: op05_exact_dedup.exact_duplicates(docs),
    6: lambda docs, labels: op06_jaccard_join.jaccard_components(docs),
    7: lambda docs, labels: op07_fingerprints.fingerprints(docs),
    8: lambda docs, labels: op08_mixing.mixing_rates(docs, op08_mixing.label_domains(labels)),
    9: lambda docs, labels: op09_bpe.bpe_digests(docs),
    10: lambda docs, labels: op10_quality_gam.quality_scores(docs, labels),
}


@pytest.mark.parametrize("number", RUNS)
def test_every_row_is_answered_once(odd, labels, number):
    answered = RUNS[number](odd, labels).select("doc_id").collect()
    assert collections.Counter(r.doc_id for r in answered) == collections.Counter(r.doc_id for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("number", RUNS)
def test_empty_tables(odd, labels, number):
    assert RUNS[number](odd.filter("false"), labels).count() == 0
    assert RUNS[number](odd.filter("doc_id = 3"), labels.filter("false")).count() == 1


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert op04_warc.convert_pages(pages).count() == 0


def test_models_of_odd_rows_keep_columns(odd, labels):
    kept = op10_quality_gam.keep_quality(odd, labels)
    assert kept.schema == odd.schema and kept.exceptAll(odd).count() == 0
