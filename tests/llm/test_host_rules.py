from collections import Counter

import pytest

from alarmlake.llm import host_rules
from tests.llm.brute import quality_counts


def check(df):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in host_rules.measure(df).collect())
    assert got == Counter((r.doc_id, *quality_counts(r.text)) for r in df.select("doc_id", "text").collect())


def test_counts(spark, edge, clashing, documents):
    check(edge)
    check(clashing)
    check(spark.createDataFrame(documents, "doc_id long, text string, lang string, source string"))


def test_verdicts(spark, edge, nothing):
    for r in host_rules.judge_documents(edge).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_rejected) and (r.host is not None or not r.host_rejected)
    assert host_rules.judge_documents(nothing).collect() == []


def rated(spark, hosts):
    return spark.createDataFrame([(h, n, f) for h, (n, f) in hosts.items()], "host string, n long, base long")


def test_rates_are_shrunk(spark):
    hosts = {f"h{i}": (100, 10 + i) for i in range(10)} | {"bad": (200, 190), "one": (1, 1)}
    rates = rated(spark, hosts)
    a, b = host_rules.beta_prior(rates, "base")
    got = {r.host: r for r in host_rules.judge_hosts(rates, {"base": "x"}).collect()}
    for h, (n, f) in hosts.items():
        assert got[h].base_rate == pytest.approx((f + a) / (n + a + b))
    assert got["bad"].rejected and not got["h0"].rejected
    assert a + b > 0 and got["one"].base_rate < 1


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad words", None, "bad") for i in range(60)] + [(100 + i, good, None, "bad") for i in range(5)] + [(200 + 10 * h + i, good, None, f"h{h}") for h in range(8) for i in range(9)]
    got = {r.doc_id: r for r in host_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[100 + i].host_rejected and not got[100 + i].base_failed and not got[100 + i].kept for i in range(5))
    assert all(got[d].kept for d in got if d >= 200)


def test_prior_of_equal_or_single_hosts(spark):
    assert sum(host_rules.beta_prior(rated(spark, {"a": (10, 5), "b": (10, 5)}), "base")) == pytest.approx(1)
    assert sum(host_rules.beta_prior(rated(spark, {"a": (10, 1)}), "base")) == pytest.approx(1)
    assert sum(host_rules.beta_prior(rated(spark, {}), "base")) == pytest.approx(1)
