import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from alarmlake.llm import ppm
from alarmlake.llm.common import held_out


def plain_bits(texts, context, byte, order):
    """Bits of ``byte`` after ``context`` by the textbook recursion with exclusion, counted in plain dictionaries."""
    seen = {}
    for t in texts:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen.setdefault(t[i - k : i], Counter())[t[i]] += 1

    @cache
    def free(k):
        n = seen[context[len(context) - k :]]
        return sum(chance(k - 1, x) for x in range(256) if x not in n)

    @cache
    def chance(k, s):
        if k < 0:
            return 1 / 256
        n = seen.get(context[len(context) - k :])
        if n is None:
            return chance(k - 1, s)
        total, kinds = sum(n.values()), len(n)
        if kinds == 256:
            return n[s] / total
        away = kinds / (total + kinds)
        return n[s] / total * (1 - away) if s in n else away * chance(k - 1, s) / free(k)

    return -math.log2(chance(order, byte))


def model_of(spark, taught, **options):
    rows = spark.createDataFrame([(lang, bytearray(t)) for lang, texts in taught.items() for t in texts], "lang string, text binary")
    return list(ppm.train(rows, **options))


TAUGHT = {"a": [b"abracadabra", b"abba\n\nab", bytes(range(256))], "b": ["über grüße".encode(), b"xyxyx", b"ab"]}


def test_costs_are_those_of_the_textbook(spark):
    for order in (2, 3):
        [model] = model_of(spark, TAUGHT, order=order)
        assert model.languages == ["a", "b"]
        for context in (b"abr", b"\n\n\n", b"zzz", b"xyx", "zü".encode()):
            cells = np.array([int.from_bytes(context[3 - order :] + bytes([s]), "big") for s in range(256)], np.uint64)
            bits = model.costs(cells)
            assert np.allclose(np.exp2(-bits.astype(float)).sum(0), 1, atol=1e-4)
            for j, name in enumerate("ab"):
                for s in (0, 10, 97, 98, 114, 120, 195, 255):
                    assert math.isclose(bits[s, j], plain_bits(TAUGHT[name], context[3 - order :], s, order), rel_tol=1e-4)


def test_code_lengths_are_sums(spark, monkeypatch):
    [model] = model_of(spark, TAUGHT)
    texts = [b"", b"abra", "grüß".encode() * 9, b"", b"q", bytes(range(256)) * 3, b""]
    want = [[sum(plain_bits(TAUGHT[name], (b"\n" * 3 + t)[i : i + 3], t[i], 3) for i in range(len(t))) for name in "ab"] for t in texts[:5]]
    whole = ppm.code_lengths(model, texts)
    assert np.allclose(whole[:5], want, rtol=1e-4)
    for chunk in (1, 7, 100):  # pieces of a text cost what the whole costs
        monkeypatch.setattr(ppm, "CHUNK", chunk)
        assert np.allclose(ppm.code_lengths(model, texts), whole, rtol=1e-4)


def test_groups_of_languages_give_the_same_lengths(spark, edge, documents):
    models = model_of(spark, TAUGHT, max_bytes=1)
    assert [m.languages for m in models] == [["a"], ["b"]]
    [model] = model_of(spark, TAUGHT)
    texts = [b"abra", "grüß".encode()]
    assert np.allclose(np.hstack([ppm.code_lengths(m, texts) for m in models]), ppm.code_lengths(model, texts), rtol=1e-4)
    rows = lambda **options: Counter((r.key, r.lang_pred, round(r.score, 6)) for r in ppm.identify(edge, F.lit(True), **options).collect())
    assert rows(max_bytes=1) == rows()


def test_unlearned_languages_and_noise_are_rejected(spark, documents):
    noise = ["xqzt vvvk pqqq zzzx wkjq qqzx vvkj wzzq", "ქართული ენა არის ქართველების მშობლიური ენა და საქართველოს ენა", "Съешь же ещё этих мягких французских булок да выпей чаю"]
    rows = [(d, t, lang) for d, t, lang, _ in documents] + [(-1 - i, t, None) for i, t in enumerate(noise)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in ppm.keep_known(docs, F.lit(True)).collect()}
    assert not [d for d in kept if d < 0]
    assert kept == {d for d, t, _ in rows if d >= 0 and any(c.isalpha() for c in t or "")}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.key: r for r in ppm.identify(docs, ~held_out("doc_id", 3, 1)).collect()}
    rows = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edge_cases(edge, clashing, nothing):
    got = ppm.identify(edge, F.lit(True)).collect()
    assert len(got) == edge.count()
    letters = {r.doc_id: r.text is not None and any(c.isalpha() for c in r.text) for r in edge.collect() if r.doc_id is not None}
    for r in got:
        if r.key is not None:
            assert (r.lang_pred == ppm.UNKNOWN) != letters[r.key]
            assert r.score == 0 if r.lang_pred == ppm.UNKNOWN else 0 < r.score <= 1
    assert all(r.lang_pred == ppm.UNKNOWN for r in ppm.identify(edge, F.lit(False)).collect())  # nothing learned
    assert ppm.identify(nothing, F.lit(True)).collect() == []
    kept = ppm.keep_known(clashing, F.lit(True), min_score=0.0, slack=100.0)  # both rules off but for letters
    assert kept.schema == clashing.schema
    want = Counter(r.doc_id for r in clashing.collect() if r.text is not None and any(c.isalpha() for c in r.text))
    assert Counter(r.doc_id for r in kept.collect()) == want
    strict = Counter(r.doc_id for r in ppm.keep_known(clashing, F.lit(True), min_score=0.0).collect())
    assert want - strict == Counter([11])  # a long text that taught nothing and is unlike the few sentences that did
    assert ppm.keep_known(clashing, F.lit(False)).collect() == []
    assert ppm.keep_known(nothing, F.lit(True)).collect() == []
