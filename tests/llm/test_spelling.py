import random
import re
import zlib
from collections import Counter

import pytest

from alarmlake.llm import spelling
from alarmlake.session import materialize
from tests.llm.brute import LOWER


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_variants(words):
    """All pairs compared."""
    form, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) <= 1 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(near)
    found = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        found.append((w, form[w], root, n, out[w], words.get(form[w])))
    return sorted(found)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_documents_against_all_pairs(spark, documents):
    rows = [(d, t) for d, t, *_ in documents[:120]]
    words = plain_words(rows)
    assert len(words) > 300 and any("ñ" in w or "ä" in w for w in words)
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got) == plain_variants(words)


@pytest.mark.parametrize("size", [4, 16, 32])
def test_every_size_gives_the_same_variants(spark, size):
    draw = random.Random(size)
    words = {"".join(draw.choice("abñÿ") for _ in range(draw.randint(5, 7))): draw.randint(3, 400) for _ in range(300)}
    words |= {f"chain{'x' * i}": 3 * 2**i for i in range(12)}  # a long way to the root
    held = materialize(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    assert result(spelling.variants(held, size=size)) == plain_variants(words)


def test_neighbours_meet_once(spark):
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 4))) for _ in range(200)})
    found = spelling.neighbours(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 4).collect()
    code = {w: "".join(spelling.SYMBOLS[ord(c) % 4] for c in w) for w in words}
    reach = Counter((r.word, r.r) for r in found)
    assert max(reach.values()) == 1 and len(set(code.values())) == len(words)
    for a in words:
        assert reach[a, code[a]] == 1
        for b in words:
            if a < b:
                assert reach[a, code[b]] + reach[b, code[a]] == one_edit(a, b)


def test_alphabet_grows_with_the_crowd(spark):
    few = spark.createDataFrame([("apple", 3), ("zebra", 4)], "word string, n long")
    many = spark.range(6000).selectExpr("concat('w', translate(id, '0123456789', 'abcdefghij'), 'w') AS word", "3L AS n")
    assert spelling.alphabet_size(few) == 4 < spelling.alphabet_size(many)


def test_long_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = b"abc defghijklmnop qr 12 \xc3\xa9t\xc3\xa9 abcdefghijk"
    assert [r for p in spelling.pieces(text) for r in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


def test_edge_cases(edge, clashing, nothing):
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in edge.collect()]))
    assert result(spelling.spelling_variants(edge)) == want == result(spelling.spelling_variants(clashing))
    assert spelling.spelling_variants(nothing).collect() == []
