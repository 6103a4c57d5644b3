"""The additive quality model: measures, trees, tables and held-out accuracy against plain versions."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from callweave.llm import additive, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [None, "", " \n\t", "a", "A b", "é\x0bÀ x 😀", "w " * 3000, "x" * 5000, "# $ %\n# $ %\n\n1 2", "a.b\nA.B\nc", "\n\n a a"]


def plain_features(text):
    text = text or ""
    words = WORD.findall(text)
    low = [w.translate(LOWER) for w in words]
    n, chars = len(words), sum(map(len, words))
    count = lambda chars_: sum(text.count(c) for c in chars_)
    symbols, others = "#*$%&|<>", "\"'()[]{}@^~=+_/\\`-"
    mean = chars / n if n else 0.0
    lines = [w for w in (WORD.findall(line.translate(LOWER)) for line in text.split("\n")) if w]
    pairs = list(itertools.pairwise(low))
    some, share, ahead = max(n, 1), max(chars, 1), max(n - 1, 1)
    return [
        math.log1p(n),
        mean,
        math.sqrt(max(sum(len(w) ** 2 for w in words) / some - mean * mean, 0)),
        math.log1p(max(map(len, words), default=0)),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / share,
        count("0123456789") / share,
        count(symbols) / share,
        count(".!?") / some,
        count(",;:") / some,
        count(others) / some,
        sum(ord(c) > 127 for c in text) / share,
        n / max(len(lines), 1),
        sum(any(c in symbols + others for c in w) for w in words) / some,
        sum(not any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words) / some,
        len(set(low)) / some,
        len(set(pairs)) / ahead,
        max(collections.Counter(low).values(), default=0) / some,
        sum(a == b for a, b in pairs) / ahead,
        (len(lines) - len(set(map(tuple, lines)))) / max(len(lines), 1),
    ]


@pytest.mark.parametrize("group", [1, 300, 1 << 22])
def test_features_are_those_of_plain_python(rng, monkeypatch, group):
    monkeypatch.setattr(additive, "GROUP_BYTES", group)
    texts = ODD + ["".join(rng.choice(" \nabAB.,;#1é😀-") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    got = additive.text_features(pa.array(texts).slice(1))
    assert np.allclose(got, np.array([plain_features(t) for t in texts[1:]]), atol=2e-6)
    assert additive.text_features(pa.array(texts[:1], pa.string())).tolist() == [[0.0] * len(additive.FEATURES)]
    assert additive.text_features(pa.array([], pa.string())).shape == (0, len(additive.FEATURES))


def gain(g, h):
    return g.sum() ** 2 / (h.sum() + additive.RIDGE)


def test_a_tree_takes_the_best_cut_of_all():
    draw = np.random.default_rng(3)
    for _ in range(100):
        g, h, n = draw.normal(size=12), draw.random(12) + 0.1, draw.integers(0, 30, 12)
        cut, found = additive._best_cut(g, h, n)
        tried = {
            c: gain(g[:c], h[:c]) + gain(g[c:], h[c:]) - gain(g, h)
            for c in range(1, 12)
            if min(n[:c].sum(), n[c:].sum()) >= additive.LEAST_ROWS
        }
        best = max(tried.values(), default=0)
        assert found == pytest.approx(max(best, 0))
        assert not found or tried[cut] == pytest.approx(best)
        table = additive.shallow_tree(g, h, n)
        assert 1 <= len(np.unique(table)) <= 3 and (cut == 0 or table[0] != table[-1])
    flat = additive.shallow_tree(draw.normal(size=(8, 8)), draw.random((8, 8)), np.full((8, 8), 20))
    assert flat.shape == (64,) and len(np.unique(flat)) <= 4


def test_tables_learn_shapes_and_pairs(spark):
    draw = np.random.default_rng(5)
    x = draw.random((4000, 4))
    # a bump in one feature, which no line can follow, and an exclusive or of two others, which no single feature shows
    truth = 6.0 * (np.abs(x[:, 0] - 0.5) < 0.2) + 10.0 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 8.0
    y = (draw.random(4000) < 1 / (1 + np.exp(-truth))).astype(float)
    model = additive.fit_additive(spark, x[:3000], y[:3000])
    assert (1, 2) in model.pairs
    score = model.scores(x[3000:])
    likely = truth[3000:] > 0
    assert ((score >= 0.5) == likely).mean() > 0.93
    # the score is the sum of one entry of each table
    row = x[3000]
    total = model.constant + sum(t[sum(row[k] >= c for c in model.cuts[k])] for k, t in enumerate(model.tables))
    place = lambda k: sum(row[k] >= c for c in model.pair_cuts[k])
    total += sum(t[place(i)][place(j)] for (i, j), t in zip(model.pairs, model.pair_tables))
    assert score[0] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-8)
    assert additive.fit_additive(spark, x[:3000], y[:3000]) == model


def sentences(rng, good):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 60))]
    if not good and rng.random() < 0.5:
        return " ".join(w + rng.choice(["###", "%%%"]) for w in words)
    return " ".join(words) + "." if good else " ".join([words[0]] * len(words))


def test_query_of_quality_on_rows_it_did_not_learn_from(spark, rng, tmp_path):
    rows = [(k, sentences(rng, rng.random() < 0.7), "en", "s", 0) for k in range(900)]
    rows += [(900, None, "en", "s", 0), (901, "", None, None, None), (None, "some text.", "en", "s", 0), (5, rows[5][1], "en", "t", 1)]
    good = {k: int("#" not in t and "%" not in t and len(set(t.split())) > 1) for k, t, *_ in rows[:900]}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    # labels of held-out rows are wrong on purpose: the query may not read them
    label = {k: good[k] if zlib.crc32(str(k).encode()) % 5 else 1 - good[k] for k in good}
    given = [*((k, v, 0) for k, v in label.items()), (None, 1, 0), (3, None, 0)]
    spark.createDataFrame(given, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op11_quality_classifier(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == good[r.doc_id] for r in held if r.doc_id < 900]) > 0.95
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1 and len({r.score for r in out if r.doc_id == 5}) == 1


def test_tables_without_rows_labels_or_a_second_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    clash = docs.selectExpr("*", "1 as scored", "'x' as Score")
    for known, likely in ((labels, True), (labels.limit(0), False)):
        model = additive.fit_quality(docs, known)
        out = additive.score_quality(clash, model)
        assert out.columns == ["doc_id", "text", "scored", "score", "predicted"]
        assert {r.score > 0.6 for r in out.collect()} == {likely}
    assert additive.score_quality(docs.limit(0), model).count() == 0
    assert additive.fit_quality(docs.limit(0), labels) == model
