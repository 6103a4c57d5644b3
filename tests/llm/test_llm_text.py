"""Mixing, line dedup, near duplicates, quality, toxicity, pieces and language model against plain versions."""

import collections
import itertools
import math
import re
import types
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.llm import hashing, katz, line_dedup, mixing, near_dup, pieces, quality, toxicity
from callweave.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [None, "", " \n\t", "a", "A b", "é\x0bÀ x 😀", "w " * 3000, "x" * 5000]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- hashing ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_words_are_told_apart(rng, monkeypatch, piece):
    monkeypatch.setattr(hashing, "PIECE_BYTES", piece)
    texts = ["".join(rng.choice(" \nabCÄé\x0b😀") for _ in range(rng.choice([0, 1, 30, 200]))) for _ in range(200)] + ODD
    hashes, at = hashing.word_hashes(pa.array(texts))
    known = {}
    for i, text in enumerate(texts):
        own = words(text)
        assert at[i + 1] - at[i] == len(own)
        for word, value in zip(own, hashes[at[i] : at[i + 1]]):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_sliced_arrays_and_no_texts():
    array = pa.array(["one two", "three", None, "four five"])
    assert hashing.word_hashes(array.slice(1, 3))[1].tolist() == [0, 1, 1, 3]
    assert len(hashing.word_hashes(pa.array([], pa.string()))[0]) == 0


# --- components ------------------------------------------------------------------------------------------------


def components(edges):
    root = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark, rng):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(300)] + [(7, 7), (5, None), (100, 201), (900, 901), (901, 900)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components([e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: mixing -------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        stop = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        if not stop:
            out.update({s: level * weight[s] for s in open_})
            break
        out.update({s: 2.0 * sizes[s] for s in stop})
        open_ -= stop
    return out


def test_mix_meets_its_targets(spark, rng, docs_of):
    rows = [(i, "w " * int(rng.expovariate(1 / 60)), rng.choice(["a", "b", "é", None, "c", "c", "c", "c"])) for i in range(700)]
    rows += [(i, t, "c") for i, t in enumerate(ODD)] + [(3, "x y", "a")] * 3 + [(None, "z " * 50, "b")] * 2 + [(9, None, "empty source")]
    mix = mixing.mix_sources(docs_of(rows))
    got = sorted(map(tuple, mix.select("doc_id", "source", "size", "source_size", "target", "taken", "copies").collect()), key=repr)
    assert len(got) == len(rows)
    assert sorted((repr(d), repr(s), n) for d, s, n, *_ in got) == sorted((repr(i), repr(s), len(words(t))) for i, t, s in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = plain_targets(sizes)
    taken = collections.Counter()
    for _, source, size, source_size, target, took, copies in got:
        assert source_size == sizes[source] and math.isclose(target, want[source], abs_tol=1e-6)
        assert took == copies * size and 0 <= copies <= 2
        taken[source] += took
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(60, 0.02 * target), (source, taken[source], target)
    again = mixing.mix_sources(docs_of(rows[::-1]).repartition(5))
    assert got == sorted(map(tuple, again.select("doc_id", "source", "size", "source_size", "target", "taken", "copies").collect()), key=repr)


def test_rates_solve_the_dual(spark, rng, docs_of):
    rows = [(i, "w " * rng.randint(1, 80), "big") for i in range(60)] + [(i, "w " * rng.randint(1, 80), "small") for i in range(60, 75)]
    got = mixing.mix_sources(docs_of(rows), weights=(7.0, 3.0), share=1.0).select("source", "size", "rate", "target").collect()
    for source in ("big", "small"):
        own = [r for r in got if r.source == source]
        assert math.isclose(sum(r.size * r["rate"] for r in own), own[0].target, rel_tol=1e-6)
        inner = [(r.size, math.log(r["rate"])) for r in own if r["rate"] < 2 - 1e-9]
        tilts = [y / x for x, y in inner]
        assert max(tilts) - min(tilts) < 1e-6  # one multiplier a source


def test_mix_of_nothing(spark, docs_of):
    assert mixing.mix_sources(docs_of([])).count() == 0
    assert [r.taken for r in mixing.mix_sources(docs_of([(1, None, None), (2, "", "a")])).collect()] == [0, 0]


# --- 3: lines --------------------------------------------------------------------------------------------------


def plain_lines(rows):
    rows = sorted(set((i, t) for i, t, _ in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        full = [(k, line.strip(" \t\n\x0b\x0c\r")) for k, line in enumerate(lines)]
        full = [x for x in full if x[1]]
        gone = set()
        for window in zip(full, full[1:], full[2:]):
            body = tuple(x[1] for x in window)
            if body in seen:
                gone.update(range(window[0][0], window[2][0] + 1))
            seen.add(body)
        out[i, text] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return out


def test_lines(spark, rng, docs_of):
    pool = [f"line {k}" for k in range(12)] + ["", " \t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))), "s") for i in range(120)]
    rows += [(200 + i, t, "s") for i, t in enumerate(ODD)] + [(300, "a\n\nb\nc", "s"), (301, "x\n a\nb \n\nc\ny", "s"), (302, "a\nb\nc\na\nb\nc\nd", "s")]
    got = line_dedup.remove_repeated_lines(docs_of(rows)).collect()
    want = plain_lines(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.text is None) if (r.doc_id, r.text) == (200, None) else r.text in {v for (i, _), v in want.items() if i == r.doc_id}
        assert r.n_chars == (None if r.text is None else len(r.text)) and r.class_id == "x"
    by_id = {r.doc_id: r.text for r in got}
    assert by_id[301] == "x\ny" and by_id[302] == "d"


def test_lines_of_repeated_rows_and_null_ids(spark, docs_of):
    text = "one\ntwo\nthree"
    got = line_dedup.remove_repeated_lines(docs_of([(1, text, "a"), (1, text, "b"), (None, "zero\n" + text, "a"), (2, text + "\nfour", "c")])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got) == [(False, 1, text), (False, 1, text), (False, 2, "four"), (True, None, "zero")]
    assert line_dedup.remove_repeated_lines(docs_of([])).count() == 0


# --- 5: near duplicates ----------------------------------------------------------------------------------------


def shingle_set(text, size):
    own = words(text)
    return set(zip(*(own[k:] for k in range(size)))) if len(own) >= size else {tuple(own)} if own else set()


def plain_near(rows, size):
    sets = [shingle_set(t, size) for _, t in rows]
    edges = [(k, k) for k in range(len(rows))]
    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            edges.append((a, b))
    group = components(edges)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    return [(i, len(s), least.get(group[k]) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, rng, docs_of, size):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50 + i, t) for i, t in enumerate(ODD)] + [(None, "null id text"), (None, "null id text"), (3, "a")]
    vocabulary = [f"w{k}" for k in range(400)]
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 150, 400]))]
        for copy in range(rng.choice([1, 3, 12])):
            own = [rng.choice(vocabulary) if rng.random() < copy * 0.012 else w for w in text]
            rows.append((1000 - 20 * base - copy, " ".join(own).title() if copy == 1 else " ".join(own)))
    got = near_dup.near_duplicates(docs_of([(i, t, "s") for i, t in rows]), size).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(plain_near(rows, size), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(docs_of([]), size).count() == 0


def test_unconnected_members_of_a_bucket_are_compared_in_blocks(monkeypatch):
    import pandas as pd

    sets = {k: np.arange(k, k + 100, dtype=np.uint32) for k in range(0, 300, 7)}
    group = pd.DataFrame([(1, k, k, 100, s.tobytes(), asks, 0, 0) for k, s in sets.items() for asks in (True, False)],
                         columns=["band", "class_id", "c", "n", "held", "asks", "i", "j"])
    got = {tuple(x) for x in near_dup._matcher(80)(group).to_numpy().tolist()}
    assert got == {(a, a + 7) for a in sets if a + 7 in sets}


def test_groups_of_a_long_bucket_stay_bounded(spark, rng, docs_of, monkeypatch):
    """Texts that share boilerplate fill buckets with unconnected members, which are repeated for each block."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "PART", 20)

    def bounded(match, most):
        def check(group):
            if len(group) > most:
                raise ValueError(f"a group of {len(group)} rows")
            return match(group)

        return check

    plain = near_dup._matcher
    monkeypatch.setattr(near_dup, "_matcher", lambda percent: bounded(plain(percent), 60))
    common = [f"w{k}" for k in range(84)]
    rows = [(i, " ".join([*common, *(f"own{i}x{k}" for k in range(15 if i < 78 else 1))])) for i in range(80)]
    got = near_dup.near_duplicates(docs_of([(i, t, "s") for i, t in rows]), 1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_near(rows, 1))


def test_sketches_estimate_similarity(rng):
    universe = hashing.mix(np.arange(1, 4001, dtype=np.uint64))
    for share in (0.5, 0.8, 0.95):
        common = int(1000 * share)
        a, b = universe[:1000], np.concatenate([universe[:common], universe[2000 : 2000 + 1000 - common]])
        texts = [np.sort(a), np.sort(b)]
        least, filled = np.zeros((2, near_dup.BUCKETS), np.uint64), np.zeros((2, near_dup.BUCKETS), bool)
        for r, s in enumerate(texts):
            bucket = s >> np.uint64(64 - near_dup.BUCKET_BITS)
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            least[r, bucket[first]], filled[r, bucket[first]] = s[first] << np.uint64(near_dup.BUCKET_BITS), True
        packed = near_dup.registers(least, filled)
        truth = common / (2000 - common)
        assert abs((packed[0] == packed[1]).mean() - truth) < 0.17


# --- 9: quality ------------------------------------------------------------------------------------------------


def test_statistics(spark, rng, docs_of):
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["#* $x|<y>\nline\n\nline \nline", "one two three one two three one", "A!! B!!\r\n!"]
    got = {r.doc_id: r for r in quality.text_statistics(docs_of([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        own, text = WORD.findall(text or ""), text or ""
        seen = collections.Counter(zip(own, own[1:], own[2:]))
        held = {k + d for k in range(len(own) - 2) if seen[tuple(own[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(held), text.count("!"))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_lines, got[i].n_dup_lines, got[i].n_repeat_words, got[i].n_exclamations) == want


def plain_estimate(patterns, m):
    prior, good, bad = 0.8, [0.99] * m, [0.2] * m
    for _ in range(quality.ROUNDS):
        sums = np.zeros(2 + 4 * m)
        for votes, n in patterns.items():
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                odds += math.log(good[j] / (1 - bad[j])) if v == 1 else math.log((1 - good[j]) / bad[j]) if v == -1 else 0
            p = 1 / (1 + math.exp(-odds))
            sums[:2] += [n * p, n]
            for j, v in enumerate(votes):
                sums[2 + 4 * j : 6 + 4 * j] += [n * p * (v == 1), n * p * (v != 0), n * (1 - p) * (v == -1), n * (1 - p) * (v != 0)]
        share = lambda a, b, start: round((a + start) / (b + 1), 9)
        old = [prior, *good, *bad]
        prior = share(*sums[:2], 0.8)
        good = [share(*sums[2 + 4 * j : 4 + 4 * j], 0.99) for j in range(m)]
        bad = [share(*sums[4 + 4 * j : 6 + 4 * j], 0.2) for j in range(m)]
        if max(abs(a - b) for a, b in zip(old, [prior, *good, *bad])) <= quality.SETTLED:
            break
    return prior, good, bad


def test_expectation_maximisation(spark, rng):
    patterns = collections.Counter()
    for _ in range(3000):
        y = 1 if rng.random() < 0.85 else -1
        patterns[tuple(0 if rng.random() < 0.3 else y if rng.random() < (0.97 if y > 0 else acc) else -y for acc in (0.9, 0.6, 0.4, 0.8))] += 1
    table = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long")
    model = quality.estimate(table, 4)
    prior, good, bad = plain_estimate(patterns, 4)
    assert np.allclose([model.prior, *model.good, *model.bad], [prior, *good, *bad], atol=1e-6)
    assert abs(model.prior - 0.85) < 0.05


def test_quality_verdicts(spark, rng, docs_of):
    prose = [" ".join(rng.choice(["river", "and", "stone", "walked", "over", "morning"]) + str(rng.randint(0, 99)) for _ in range(120)) for _ in range(80)]
    junk = [" ".join(f"w{rng.randint(0, 999)}###" for _ in range(120)) for _ in range(12)]
    rows = [(i, t, "s") for i, t in enumerate(prose + junk + ODD)]
    got = {r.doc_id: r for r in quality.judge_quality(docs_of(rows)).collect()}
    assert all(got[i].kept for i in range(80)) and not any(got[i].kept for i in range(80, 92))
    assert all(got[i].base_failed and not got[i].kept for i in range(92, 92 + len(ODD)))
    assert quality.judge_quality(docs_of([])).count() == 0


# --- 7: toxicity -----------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def test_automata_equal_edit_distance(rng):
    terms = ("abc", "abbac", "cabbage", "abcabcabc", "bcabcabca", "cccccaaaaa")
    stems = ("caba", "bbb")
    matcher = toxicity.Matcher(terms, stems)
    samples = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 11))) for _ in range(3000)}
    for term in terms:
        for _ in range(200):
            word = list(term)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(word) + 1)
                word[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "g"])
            samples.add("".join(word))
    for word in samples:
        allowed = [distance(word, t) for t in terms if distance(word, t) <= toxicity.edits_allowed(t)]
        want = min(allowed, default=toxicity.Matcher.NONE)
        if want and any(word.startswith(s) for s in stems):
            want = toxicity.Matcher.STEM
        assert matcher.match(word) == want, word
    matcher.forget()
    assert matcher.match("abbac") == 0


def test_quotation_is_told_from_abuse():
    matcher = toxicity.Matcher(("wretch",), ())
    plain = toxicity.text_features(matcher, "You are a wretch and a wretsh")
    quoted = toxicity.text_features(matcher, 'The word "wretch" is old. She said it: wretch')
    assert plain[0] > 0 and plain[1] > 0 and plain[2] > 0 and plain[5] == 0
    assert quoted[:5] == [0, 0, 0, 0, 0] and quoted[5] > 0
    assert toxicity.text_features(matcher, None) == toxicity.text_features(matcher, "") == [0.0] * 7


def test_toxicity_is_learned(spark, rng, docs_of):
    vocabulary = [f"{a}{b}{c}" for a in ("mor", "lin", "ta", "ves") for b in ("a", "el", "ort") for c in ("ing", "en", "o")]
    rows, labels = [], []
    for i in range(300):
        own = [rng.choice(vocabulary) for _ in range(60)]
        if i % 5 == 0:
            for place in rng.sample(range(60), 3):
                own[place] = rng.choice(["grobnik", "scummel"]) if i < 250 else "grobnick"
        rows.append((i, " ".join(own), "s"))
        labels.append((i, int(i % 5 == 0)))
    docs, table = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, table.where("doc_id < 200"))
    assert {"grobnik", "scummel"} <= set(model.terms)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(300))  # misspelled ones too
    odd = toxicity.score_toxicity(docs_of([(i, t, "s") for i, t in enumerate(ODD)]), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in odd) and len(odd) == len(ODD)
    empty = toxicity.fit_toxicity(docs, table.where("doc_id < 0"))
    assert 0 <= toxicity.score_toxicity(docs, empty).first().score <= 1
    assert toxicity.score_toxicity(docs_of([]), model).count() == 0


def test_sample_keeps_the_share_of_toxic_texts(spark, docs_of, monkeypatch):
    """A word that toxic texts share with clean ones is no term when rows are sampled either."""
    monkeypatch.setattr(toxicity, "MAX_ROWS", 200)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 10 == 0
        own = ["plain", "words", f"number{chr(97 + i % 26)}"] + ["grobnik"] * toxic + ["halfway"] * (toxic and i % 20 == 0 or i % 60 == 7)
        rows.append((i, " ".join(own), "s"))
        labels.append((i, int(toxic)))
    model = toxicity.fit_toxicity(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "grobnik" in model.terms and "halfway" not in model.terms and not any("halfway".startswith(s) for s in model.stems)


def test_terms_stay_beside_their_stem():
    terms, stems = toxicity._lexicon({"grobnische": 10, "grobnischer": 9, "grobnisches": 9, "grobni*": 28, "grobnisc*": 28})
    assert stems == ("grobni",) and set(terms) == {"grobnische", "grobnischer", "grobnisches"}
    matcher = toxicity.Matcher(terms, stems)
    assert [matcher.match(w) for w in ("grobnische", "grobnischt", "gropnischer", "krobnixche")] == [0, matcher.STEM, 1, 2]


def test_signs_inside_a_word_are_edits():
    matcher = toxicity.Matcher(("idiot", "stupid", "scum", "pathetic", "worthless"), ("grob",))
    alone = ["idi0t", "st*pid", "id-iot", "sc*m", "skum", "scu", "p4thetic", "w0rthl3ss", "w-orth.less", "(idi0t).", "$tupid", "you,idi0t", "say:st*pid!"]
    for text in alone * 2:
        assert toxicity.text_features(matcher, text)[0] == pytest.approx(math.log(2)), text
    for text in ("id10t", "s--m", "i.d.i.o.t", "don't re-use a.b 3x3 c_d", "id iot", "stu pid", 'id"iot'):
        assert toxicity.text_features(matcher, text)[0] == 0, text
    assert toxicity.text_features(matcher, "stupid,idiot grob-idi0t/scum")[1:5] == pytest.approx([math.log(4), math.log(2), 0, math.log(2)])


# --- 8: pieces -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return pieces.load_pieces(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def sample_text(rng, n):
    return "".join(rng.choice(["a", "the", "   ", " ", "\n", "\t", "é", "ing", "==", "  ", "****", "Z", "1", "你", "😀", "entre", " re"]) for _ in range(n))


def test_encoding_equals_the_model(rng, model):
    own, theirs = model
    for _ in range(600):
        text = sample_text(rng, rng.randint(1, 16))
        assert own.encode(" " + text) == theirs.encode(text), text
        assert own.decode(own.encode(" " + text))[1:] == text
    assert own.decode(own.encode(" ▁ a▁b"))[1:] == "▁ a▁b"


def test_texts_together_equal_texts_alone(rng, model, monkeypatch):
    own, theirs = pieces.load_pieces(), model[1]
    monkeypatch.setattr(pieces, "KEPT_UNITS", 30)  # units are forgotten and learned again
    for _ in range(40):
        texts = [sample_text(rng, rng.randint(0, 12)) for _ in range(rng.randint(0, 9))]
        ids, ends, same = own.encode_all([f" {t}" if t else "" for t in texts])
        assert len(ends) == len(texts) + 1 and same.tolist() == [True] * len(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [theirs.encode(t) for t in texts]
        assert len(own.units) < 30 + sum(map(len, texts)) + len(texts)
    own.learn([" told"])
    own.exact[own.units[" told"]] = False  # a unit that did not decode to itself
    assert own.encode_all([" a", " it told", " told"])[2].tolist() == [True, False, False]


@pytest.mark.parametrize("block", [1, 40, 1 << 21])
def test_blocks_of_texts_do_not_change_rows(spark, rng, docs_of, monkeypatch, block):
    texts = [None, "", " ", "a", None, *(sample_text(rng, rng.randint(1, 30)) for _ in range(20)), ""]
    p = pieces.load_pieces()
    monkeypatch.setattr(pieces, "BLOCK", block)
    run = pieces._whole(types.SimpleNamespace(value=p)).func
    got = [row for part in run(iter([pa.array(texts[:9]), pa.array(texts[9:], pa.string()), pa.array([], pa.string())])) for row in part.to_pylist()]
    assert got == [{"ids": None if t is None else p.encode(" " + t) if t else [], "round_trip": None if t is None else True} for t in texts]


def test_chunks_meet_in_one_path(rng, model):
    own, _ = model
    for _ in range(120):
        text = " " + sample_text(rng, rng.randint(20, 60))
        size = rng.choice([16, 19, 40])
        chunks = [(text[max(0, k - 16) : k], text[k : k + size], text[k + size : k + size + 16]) for k in range(0, len(text), size)]
        matrices = [set(pieces.transfer(own, *c)) for c in chunks]
        ids = []
        for chunk, (enter, leave) in zip(chunks, pieces.boundary_states(matrices)):
            part, same = pieces.chunk_ids(own, *chunk, enter, leave)
            assert same
            ids += part
        assert ids == own.encode(text)
        if len(matrices) > 2:
            a, b, c = matrices[:3]
            assert pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))


def test_encode_and_decode_tables(spark, rng, docs_of, model):
    texts = ODD + [sample_text(rng, 300), "ab" * 900, " " * 200, "▁x▁"]
    docs = docs_of([(i, t, "s") for i, t in enumerate(texts)])
    coded = pieces.encode_texts(docs, chunk=100)
    rows = sorted(coded.collect(), key=lambda r: (r.doc_id, r.chunk))
    assert all(r.round_trip is not False for r in rows) and "class_id" in coded.columns
    decoded = collections.defaultdict(str)
    for r in sorted(pieces.decode_ids(coded).collect(), key=lambda r: (r.doc_id, r.chunk)):
        decoded[r.doc_id] = None if r.text is None else decoded[r.doc_id] + r.text
    for i, text in enumerate(texts):
        ids = [x for r in rows if r.doc_id == i for x in r.ids or []]
        assert decoded[i] == text
        assert "▁" in (text or "") or ids == model[1].encode(text or "")
        assert len([r for r in rows if r.doc_id == i]) == (1 if len(text or "") <= 100 else -(-(len(text) + 1) // 100))
    assert pieces.encode_texts(docs_of([])).count() == 0


# --- 10: language model ----------------------------------------------------------------------------------------


def plain_discounts(counts, k=5):
    """From the definition: the adjusted count of Good and Turing, moved so that counts above ``k`` stay as they are."""
    n = collections.Counter(counts)
    out = []
    for r in range(1, k + 1):
        if n[1] and n[r] and n[r + 1]:
            adjusted, kept = Fraction((r + 1) * n[r + 1], n[r]), Fraction((k + 1) * n[k + 1], n[1])
            d = (adjusted / r - kept) / (1 - kept) if kept < 1 else 0
        else:
            d = 0
        out.append(float(d) if 0 < d < 1 else 1 - 1 / (2 * r))
    return out


def test_discounts_free_what_is_seen_once():
    seen = {1: 900, 2: 310, 3: 150, 4: 90, 5: 62, 6: 45, 7: 30}
    d = katz.good_turing(seen)
    assert d == pytest.approx(plain_discounts([r for r, times in seen.items() for _ in range(times)]))
    assert sum(seen[r] * (1 - d[r - 1]) * r for r in range(1, 6)) == pytest.approx(seen[1])  # Katz's condition
    assert katz.good_turing({}) == pytest.approx(plain_discounts([]))
    assert katz.good_turing({1: 3, 2: 9, 6: 4}) == pytest.approx(plain_discounts([1] * 3 + [2] * 9 + [6] * 4))


def plain_katz(rows):
    tokens = [words(t) + ["</s>"] for _, t, _ in rows]
    uni, pairs, texts = collections.Counter(), collections.Counter(), 0
    for (_, _, out), own in zip(rows, tokens):
        if not out:
            uni.update(own)
            pairs.update(zip(["<s>"] + own, own))
            texts += 1
    total, distinct = sum(uni.values()), len(uni)
    d = plain_discounts(pairs.values())
    cut = lambda c: (d[c - 1] if c <= katz.DISCOUNTED else 1) * c
    single = lambda w: (uni[w] + 0.5) / (total + 0.5 * (distinct + 1)) if total else 1.0
    context = collections.defaultdict(lambda: [0.0, 0.0])
    for (a, b), c in pairs.items():
        context[a][0] += cut(c)
        context[a][1] += single(b)

    def probability(a, b):
        n = texts if a == "<s>" else uni[a]
        if not n:
            return single(b)
        mass, share = context[a]
        over = n + (n - mass < 1e-9 * n)
        return cut(pairs[a, b]) / over if (a, b) in pairs else (1 - mass / over) / (1 - share) * single(b)

    scores = [(sum(math.log10(single(w)) for w in own), sum(math.log10(probability(a, b)) for a, b in zip(["<s>"] + own, own))) for own in tokens]
    return scores, probability, uni, total, tokens


@pytest.mark.parametrize("block", [40, 4 << 20])
def test_katz_scores(spark, rng, docs_of, monkeypatch, block):
    monkeypatch.setattr(katz, "BLOCK_BYTES", block)
    monkeypatch.setattr(katz, "KEYS_PER_PART", 50)
    texts = [" ".join(rng.choice(["a", "b", "the", "The", "x%d" % rng.randint(0, 30)]) for _ in range(rng.randint(0, 30))) for _ in range(80)] + ODD
    rows = [(i % 70, t, i % 5 == 1) for i, t in enumerate(texts)]
    rows[4] = (None, rows[4][1], False)
    docs = docs_of([(i, t, "s") for i, t, _ in rows])
    docs = spark.createDataFrame([(*r, o) for r, (_, _, o) in zip(map(tuple, docs.collect()), rows)], docs.schema.add("held_out", "boolean"))
    want, probability, uni, total, tokens = plain_katz(rows)
    got = sorted(katz.score_texts(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score, r.score))
    plain = sorted(
        ((str(i), len(own), base, score, sum(uni[w] > 0 for w in own), o) for (i, _, o), own, (base, score) in zip(rows, tokens, want)),
        key=lambda x: x[:4],
    )
    assert len(got) == len(rows)
    for r, (i, n, base, score, known, out) in zip(got, plain):
        assert (str(r.doc_id), r.n_tokens, r.n_known, r.held_out, r.train_tokens) == (i, n, known, out, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)
    for a in ("<s>", "the", "x3", "never seen"):
        assert math.isclose(sum(probability(a, w) for w in uni) + probability(a, "unknown word"), 1)


def test_katz_without_training_or_rows(spark, docs_of):
    docs = docs_of([(1, "a b", "s"), (2, None, "s")]).withColumn("held_out", F.lit(True))
    assert sorted((r.n_tokens, r.base_score, r.score) for r in katz.score_texts(docs).collect()) == [(1, 0.0, 0.0), (3, 0.0, 0.0)]
    assert katz.score_texts(docs_of([]).withColumn("held_out", F.lit(False))).count() == 0


def test_frequent_followers_leave_something(spark, docs_of):
    docs = docs_of([(i, "a b", "s") for i in range(20)] + [(99, "a c", "s")]).withColumn("held_out", F.col("doc_id") == 99)
    assert all(math.isfinite(r.score) for r in katz.score_texts(docs).collect())
