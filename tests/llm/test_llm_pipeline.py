"""The pipeline's stages, each beside brute force on its own input, and the registered queries."""

import collections
import re

import pytest
from check_oracle import compare, oracle_connection
from test_llm_operators import components_by_pairs

import __spark_entry__ as entry
import corpus_pipeline
from docwarden.llm import op08_mixing, op09_bpe, op10_quality_gam
from docwarden.llm.common import durable


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"test-{name.split()[0]}")
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(stages) == 6


def test_quality_stage(spark, sf_dir, stages):
    scores = op10_quality_gam.quality_scores(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert set(ids(stages[1])) == {r.doc_id for r in scores.filter("predicted = 1").collect()}


def test_exact_stage(stages):
    best = {}
    for i, text in sorted(ids(stages[1]).items()):
        key = re.sub(r"[\x20\x09-\x0D]", "", text)
        if key not in best or len(text) > len(best[key][1]):
            best[key] = (i, text)
    assert ids(stages[2]) == dict(best.values())


def test_near_stage(stages):
    rows = sorted(ids(stages[2]).items())
    expected = {top for _, n, top in components_by_pairs(rows, 80, 5) if n} | {i for i, n, _ in components_by_pairs(rows, 80, 5) if not n}
    assert set(ids(stages[3])) == expected


def test_mixing_stage(spark, sf_dir, stages):
    """Rates scaled so that clean tokens do not become fewer, worked out here from the plain ones."""
    domains = op08_mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = op08_mixing.mixing_rates(stages[3], domains).toPandas()
    clean = plain.p_clean >= plain[["p_clean", "p_junk", "p_toxic"]].max(axis=1)
    after = (plain.rate * plain.n_tokens)[clean].sum()
    scale = max(1.0, plain.n_tokens[clean].sum() / after) if after else 1.0
    rate = (plain.rate * scale).where(~clean, (plain.rate * scale).clip(lower=1.0))
    expected = op08_mixing.mixing_rates(stages[3], domains, keep="clean").toPandas().set_index("doc_id")
    assert abs(expected.rate.loc[plain.doc_id].to_numpy() - rate.to_numpy()).max() < 1e-6 * rate.max()
    copies = {i: n for i, n in expected.copies.items() if n}
    assert collections.Counter(r.doc_id for r in stages[4].select("doc_id").collect()) == copies
    assert set(plain.doc_id[clean]) <= set(copies)


def test_mixing_of_its_own_input_meets_targets_or_least_squares(spark, sf_dir, stages):
    """Rates are a least-squares optimum when no document could lower the squares (p . off >= 0), and
    none with a rate could by losing it (p . off = 0); the sums are within the tolerance of one."""
    rates = op08_mixing.mixing_rates(stages[3], op08_mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))).toPandas()
    share = rates.n_tokens / rates.n_tokens.sum()
    off = {name: (rates.rate * share * rates[f"p_{name}"]).sum() / weight - 1 for name, weight in op08_mixing.TARGETS.items()}
    if max(map(abs, off.values())) >= op08_mixing.TOLERANCE:
        slope = sum(rates[f"p_{name}"] * value for name, value in off.items())
        assert slope[rates.n_tokens > 0].min() > -2 * op08_mixing.TOLERANCE
        assert abs((rates.rate * share * slope).sum()) < 2 * op08_mixing.TOLERANCE


def test_encoding_stage(stages):
    expected = collections.Counter((r.doc_id, r.n_tokens) for r in op09_bpe.bpe_digests(stages[4]).collect())
    assert collections.Counter((r.doc_id, len(r.ids)) for r in stages[5].collect()) == expected


def test_run_is_all_stages(spark, sf_dir, stages):
    got, want = (df.select("doc_id", "ids", "decoded") for df in (corpus_pipeline.run(spark, sf_dir), stages[5]))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_all_queries():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op1_sharding", "op4_arc_to_warc", "op5_exact_dedup"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    message, rows = compare(spark, oracle_connection(sf_dir), name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert message == "" and rows > 0
