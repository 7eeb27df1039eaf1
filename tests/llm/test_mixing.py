import math
from collections import Counter, defaultdict

import pytest

from alarmlake.llm import mixing


def source_rows(sizes, tokens=lambda i: 1 + i % 7):
    rows, n = [], 0
    for s, count in sizes.items():
        for _ in range(count):
            rows.append((str(n), s, tokens(n)))
            n += 1
    return rows


def totals_of(rows):
    t = Counter()
    for _, s, k in rows:
        t[s] += k
    return t


@pytest.fixture(scope="module")
def rows(spark):
    data = source_rows({"big": 900, "mid": 120, "small": 30, None: 15})
    return data, spark.createDataFrame(data, "uid string, source string, tokens long").cache()


def table_of(spark, totals):
    return spark.createDataFrame([(str(s), t) for s, t in totals.items()], "source string, tokens long")


def test_exponent_meets_the_target_entropy(spark, rows):
    totals = totals_of(rows[0])
    for target in (0.7, 0.9, 0.999):
        a = mixing.fit_exponent(table_of(spark, totals), target_entropy=target)
        z = sum(t**a for t in totals.values())
        entropy = -sum(t**a / z * math.log(t**a / z) for t in totals.values())
        assert 0 <= entropy - target * math.log(len(totals)) < 1e-4
    assert mixing.fit_exponent(table_of(spark, totals), target_entropy=0.1) == 1.0  # diverse enough as it is


def test_exponent_keeps_the_repetition_limit(spark, rows):
    totals = totals_of(rows[0])
    for limit, budget in ((1.5, None), (3.0, None), (2.0, 2000)):
        a = mixing.fit_exponent(table_of(spark, totals), max_repeats=limit, budget=budget)
        z = sum(t**a for t in totals.values())
        repeats = [t ** (a - 1) * (budget / z if budget else 1 / min(x ** (a - 1) for x in totals.values())) for t in totals.values()]
        assert limit - 1e-3 < max(repeats) <= limit + 1e-6
    both = mixing.fit_exponent(table_of(spark, totals), target_entropy=0.999, max_repeats=1.5)
    assert both == mixing.fit_exponent(table_of(spark, totals), max_repeats=1.5)  # the limit wins
    assert mixing.fit_exponent(table_of(spark, {"one": 5}), None, 1.5) == 0.0


@pytest.mark.parametrize("blocks", [1, 4, 4096])
@pytest.mark.parametrize("options", [{"target_entropy": 0.9}, {"max_repeats": 1.5}, {"target_entropy": 0.9, "budget": 1500}])
def test_draws_meet_the_quotas(spark, rows, options, blocks):
    data, df = rows
    got = mixing.draw(df, blocks=blocks, **options).collect()
    totals = totals_of(data)
    a = mixing.fit_exponent(table_of(spark, totals), **options)
    z = sum(t**a for t in totals.values())
    whole = options.get("budget") or z / min(t ** (a - 1) for t in totals.values())
    drawn, passes = Counter(), defaultdict(Counter)
    for r in got:
        drawn[r.source] += r.tokens
        passes[r.uid][r["pass"]] += 1
    for s, t in totals.items():
        quota = whole * t**a / z
        assert quota - 8 - 1 <= drawn[s] <= quota + 0.2  # one document less at most
    assert all(n == 1 for c in passes.values() for n in c.values())
    if "budget" not in options:
        assert set(passes) == {u for u, _, _ in data}
    again = mixing.draw(df, blocks=blocks, **options).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edge_cases(edge, clashing, nothing):
    plan = mixing.mix_plan(edge, max_repeats=1.5)
    assert plan.filter("tokens < 1").count() == 0
    texts = Counter((r.doc_id, r.text) for r in clashing.collect())
    mixed = mixing.mix(clashing, max_repeats=1.5)
    assert mixed.schema == clashing.schema
    got = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(got) == set(texts) and all(got[k] >= n for k, n in texts.items())
    assert mixing.mix(nothing, target_entropy=0.9, max_repeats=1.5).collect() == []
