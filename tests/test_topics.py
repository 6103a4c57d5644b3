"""Similarity, ranking, topic assignment."""

import math
import sys
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from callweave.operators import similarity, term_index
from callweave.operators.calls import split_sentences
from callweave.operators.ranking import top_topics
from callweave.operators.similarity import SENTENCE_NO, _dense_in_tiles, dense_matches, dense_tiles, label_centroids, lexical_matches
from callweave.operators.term_index import TermIndex
from callweave.plans.topics import assign_topics, encoded_candidates, rerank, ranked_topics, topic_candidates, unidentified_calls
from callweave.operators.scoring import LABELS, TEXT, VECTOR, labels_of, texts_of, vectors_of, with_model
from callweave.scorers.builtin import ExtractiveModel, HashingEncoder, LexicalClassifier, RefusingModel
from callweave.scorers.resources import gpu_profile
from callweave.session import number_rows
from callweave.sources.catalogue import Catalogue


def catalogue(spark, *descriptions, **options):
    rows = [(i, f"T{i}", d) for i, d in enumerate(descriptions)]
    return Catalogue(spark.createDataFrame(rows, "topic_no bigint, topic string, description string"), **options)


def sentence_rows(spark, *sentences, conv=0):
    return spark.createDataFrame(
        [(conv, i, s) for i, s in enumerate(sentences)], "conv_id bigint, position bigint, sentence string"
    )


def brute_force(sentences, descriptions, threshold=Fraction(2, 5)):
    found = set()
    for i, s in enumerate(sentences):
        a = Counter(s.lower().split())
        for j, d in enumerate(descriptions):
            b = Counter(d.lower().split())
            dot = sum(n * b[t] for t, n in a.items())
            aa, bb = (sum(n * n for n in c.values()) for c in (a, b))
            if Fraction(dot * dot) > threshold**2 * aa * bb:
                found.add((i, j, dot, aa, bb))
    return found


def as_set(df):
    return {(r.position, r.topic_no, r.dot, r.sentence_sq, r.topic_sq) for r in df.collect()}


# dot 8, squared norms 10 and 40: the cosine is exactly 0.4
EDGE_SENTENCE = "a a a b"
EDGE_TOPIC = "a a b b c c c c c d e"


def test_cosine_of_exactly_the_threshold_is_no_match(spark):
    a, b = Counter(EDGE_SENTENCE.split()), Counter(EDGE_TOPIC.split())
    assert (sum(n * b[t] for t, n in a.items()), sum(n * n for n in a.values())) == (8, 10)
    assert sum(n * n for n in b.values()) == 35
    topic = EDGE_TOPIC + " f g h i j"
    assert sum(n * n for n in Counter(topic.split()).values()) == 40
    for options in ({}, {"max_broadcast_bytes": 0}):
        assert lexical_matches(sentence_rows(spark, EDGE_SENTENCE), catalogue(spark, topic, **options)).count() == 0
        assert lexical_matches(sentence_rows(spark, EDGE_SENTENCE), catalogue(spark, EDGE_TOPIC, **options)).count() == 1


def random_texts(seed, n, words, vocabulary):
    rng = np.random.default_rng(seed)
    # one word makes up a third of everything
    pool = ["the"] * (vocabulary // 2) + [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choice(pool, size=rng.integers(0, words))) for _ in range(n)]


@pytest.mark.parametrize("bound,block", [(8_000_000, 8_000_000), (0, 8_000_000), (0, 400), (0, 1)])
def test_lexical_matches_equal_brute_force(spark, bound, block):
    sentences, descriptions = random_texts(1, 200, 14, 30), random_texts(2, 25, 30, 30)
    topics = catalogue(spark, *descriptions, max_broadcast_bytes=bound, block_bytes=block)
    matches = lexical_matches(sentence_rows(spark, *sentences), topics)
    assert as_set(matches) == brute_force(sentences, descriptions)
    assert all(r.cos_sim == round(r.dot / math.sqrt(r.sentence_sq * r.topic_sq), 6) for r in matches.collect())


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("abcdefg"), max_size=9), min_size=1, max_size=12),
    st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=9), min_size=1, max_size=5),
    st.sampled_from([1, 7, 1000]),
)
def test_term_index_equals_brute_force_for_any_tile_size(sentences, topics, tile):
    rows = [
        (i, t, n, sum(m * m for m in Counter(topic).values())) for i, topic in enumerate(topics) for t, n in Counter(topic).items()
    ]
    index = TermIndex.build(pd.DataFrame(rows, columns=["topic_no", "term", "topic_tf", "topic_sq"]))
    before, term_index.TILE_CELLS = term_index.TILE_CELLS, tile
    try:
        lists = index.matches(pa.array(sentences, pa.list_(pa.string())), (2, 5)).to_pylist()
    finally:
        term_index.TILE_CELLS = before
    got = {(i, m["topic_no"], m["dot"], m["sentence_sq"], m["topic_sq"]) for i, ms in enumerate(lists) for m in ms}
    assert got == brute_force([" ".join(s) for s in sentences], [" ".join(t) for t in topics])


def test_dense_matches_in_one_block_or_many(spark):
    rng = np.random.default_rng(3)
    side, topics = rng.normal(size=(300, 8)), rng.normal(size=(11, 8))
    side[7] = 0
    topics[3] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(side)], "id bigint, vector array<float>")
    targets = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(topics)], "topic_no bigint, vector array<double>")
    side = side.astype(np.float32).astype(float)
    with np.errstate(invalid="ignore"):
        cos = side @ topics.T / np.outer(np.linalg.norm(side, axis=1), np.linalg.norm(topics, axis=1))
    want = {(i, j): cos[i, j] for i, j in zip(*np.nonzero(cos > 0.3))}
    for bound in (8_000_000, 200):
        got = {(r.id, r.topic_no): r.cos_sim for r in dense_matches(vectors, targets, 0.3, max_broadcast_bytes=bound).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert dense_matches(vectors, targets.where("false"), 0.3).count() == 0


@pytest.mark.parametrize("threshold", [-2.0, 0.0, 0.4, 0.93, 1.0])
def test_tiles_of_vectors_lose_no_match(spark, threshold):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    side = np.concatenate([rng.normal(size=(150, 16)), *[c + 0.1 * rng.normal(size=(60, 16)) for c in centres]])
    targets = np.concatenate([rng.normal(size=(40, 16)), *[c + 0.1 * rng.normal(size=(20, 16)) for c in centres], 3 * side[:4]])
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(side)] + [(-1, v) for v in odd], "id long, vector array<double>")
    topics = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(targets)] + [(-1, v) for v in odd], "topic_no long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = unit(side) @ unit(targets).T
    far = dense_matches(vectors, topics, threshold, max_broadcast_bytes=0, block_bytes=16 * 8 * 16)
    got = {(r.id, r.topic_no) for r in far.collect()}
    sure, possible = ({(int(i), int(j)) for i, j in zip(*np.nonzero(cosine > threshold + e))} for e in (1e-9, -1e-9))
    assert sure <= got <= possible and far.columns == ["id", "topic_no", "cos_sim"]


def test_vectors_go_only_to_tiles_within_reach(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32))
    near = lambda n: [(centres[i % 12] + 0.05 * rng.normal(size=32)).tolist() for i in range(n)]
    vectors = spark.createDataFrame(list(enumerate(near(600))), f"{SENTENCE_NO} long, vector array<double>")
    topics = spark.createDataFrame(list(enumerate(near(240))), "topic_no long, vector array<double>")
    tiles = dense_tiles(vectors, topics, 0.9, "vector", 10)
    assert tiles.rows.count() < 0.25 * tiles.total_rows * tiles.blocks
    sizes = tiles.topics.groupBy("block").count()
    assert sizes.count() <= tiles.blocks and sizes.agg(F.max("count")).first()[0] <= 30
    assert tiles.topics.count() == 240


def test_a_vector_is_moved_once_for_many_blocks(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(900, 12)).tolist()
    vectors = spark.createDataFrame(list(enumerate(rows)), f"{SENTENCE_NO} long, vector array<double>")
    topics = vectors.withColumnRenamed(SENTENCE_NO, "topic_no")
    tiles = dense_tiles(vectors, topics, 0.4, "vector", 4)
    plan = _dense_in_tiles(tiles, 0.4, "vector", 4)
    found = {(r[0], r[1]) for r in plan.collect()}
    units = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(units @ units.T > 0.4))}
    dealt, shelved = tiles.on_shelves(64)
    assert shelved.count() == 900 and dealt.groupBy("row_no", "block").count().where("count > 1").count() == 0
    assert dealt.count() * 8 < tiles.rows.count()


def test_tiles_move_fewer_copies_than_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame(list(enumerate(rng.normal(size=(800, 12)).tolist())), "id long, vector array<double>")
    moved, in_tiles = [], similarity.match_in_tiles

    def counting(rows, *rest):
        moved.append(rows.count())
        return in_tiles(rows, *rest)

    monkeypatch.setattr(similarity, "match_in_tiles", counting)
    dense_matches(vectors, vectors.withColumnRenamed("id", "topic_no"), 0.4, max_broadcast_bytes=0, block_bytes=4 * 8 * 12)
    assert 800 <= moved[0] <= 800 * 9  # of over 200 blocks


def test_no_topics_or_no_vectors_beyond_the_bound(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    topics = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "topic_no long, vector array<double>")
    assert dense_matches(vectors, topics, 0.1, max_broadcast_bytes=0).count() == 0
    directions = topics.selectExpr("topic_no", "array(1.0D, 1.0D) AS vector")
    assert dense_matches(vectors.limit(0), directions, 0.1, max_broadcast_bytes=0).count() == 0
    assert dense_matches(vectors, directions, 0.1, max_broadcast_bytes=0).count() == 2
    assert lexical_matches(sentence_rows(spark, "a b c"), catalogue(spark, "", max_broadcast_bytes=-1)).count() == 0


def test_centroids_are_means(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 6.0]), (5, [1.0, 1.0])], "label int, embedding array<float>")
    assert {r.topic_no: r.vector for r in label_centroids(df).collect()} == {0: [2.0, 4.0], 5: [1.0, 1.0]}


@pytest.mark.parametrize("n,kept", [(9, 9), (10, 10), (11, 10)])
def test_top_ten(spark, n, kept):
    rows = [(1, i % 3, i, 0.5) for i in range(n)] + [(2, 0, 0, 0.9)]
    df = spark.createDataFrame(rows, "conv_id bigint, position bigint, topic_no bigint, cos_sim double")
    got = top_topics(df).where("conv_id = 1").orderBy("rank").collect()
    assert [(r.position, r.topic_no) for r in got] == sorted((i % 3, i) for i in range(n))[:kept]


def summaries(spark, *texts):
    rows = [(i, t, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conv_id bigint, summary string, error string")


TOPICS = ("my bill is far too high", "the internet line is down again", "please cancel my contract now")


def test_topics_of_calls(spark):
    calls = summaries(
        spark,
        "my bill is too high. my bill is far too high. the internet is down again today. my bill was far too high",
        "the internet line is down again",
        "short. words. only",
        "no summary generated",
        "one two three four five six",
    )
    calls = calls.unionByName(calls.where("conv_id = 1").selectExpr("9L AS conv_id", "'Error: x' AS summary", "'x' AS error"))
    topics = catalogue(spark, *TOPICS)
    rows = {r.conv_id: r for r in assign_topics(calls, topics, LexicalClassifier()).collect()}
    got = {k: (r.primary_topic, r.secondary_topic, r.error) for k, r in rows.items()}
    assert got == {
        0: ("T0", "T1", None),  # topic 0 is found by three sentences and still named once
        1: ("T1", "None", None),
        2: ("Unidentified", "None", None),
        3: ("Unidentified", "None", None),
        4: ("Unidentified", "None", None),
        9: ("Unidentified", "None", "x"),
    }
    matches = lexical_matches(split_sentences(calls, text="summary"), topics)
    ranked = ranked_topics(matches, topics)
    first = rerank(calls, ranked, LexicalClassifier()).where("conv_id = 0").first()
    assert sorted(first.top_topics) == ["T0", "T0", "T0", "T1"]
    left = unidentified_calls(calls.where("error is null"), matches).collect()
    assert sorted(r.conv_id for r in left) == [2, 3, 4]


@pytest.mark.parametrize("encoder", [None, HashingEncoder(1 << 14)])
def test_rows_that_share_an_id_or_have_none_keep_topics_of_their_own(spark, encoder):
    texts = [(2, TOPICS[0]), (2, TOPICS[1]), (None, TOPICS[2]), (None, "nothing that is known to anyone"), (None, TOPICS[0]), (7, TOPICS[2])]
    texts += [(2, TOPICS[0]), (2**53, TOPICS[0]), (2**53 + 1, TOPICS[1])]
    calls = spark.createDataFrame([(c, t, None) for c, t in texts], "conv_id long, summary string, error string")
    failed = spark.createDataFrame([(None, TOPICS[0], "bad"), (2, None, "bad")], calls.schema)
    rows = assign_topics(calls.unionByName(failed), catalogue(spark, *TOPICS), LexicalClassifier(), encoder).collect()
    first = {TOPICS[0]: "T0", TOPICS[1]: "T1", TOPICS[2]: "T2"}
    want = [(c, t, first.get(t, "Unidentified"), None) for c, t in texts]
    want += [(None, TOPICS[0], "Unidentified", "bad"), (2, None, "Unidentified", "bad")]
    assert sorted(map(str, ((r.conv_id, r.summary, r.primary_topic, r.error) for r in rows))) == sorted(map(str, want))


def test_steps_tell_rows_apart_by_the_key_they_are_given(spark):
    texts = [(2, TOPICS[0]), (2, "nothing that is known to anyone"), (None, TOPICS[2]), (None, "and nothing here that is known")]
    numbered = number_rows(spark.createDataFrame([(c, t, None) for c, t in texts], "conv_id long, summary string, error string"))
    topics = catalogue(spark, *TOPICS)
    found = topic_candidates(numbered, topics, key="row_no")
    assert found.columns[0] == "row_no" and found.count() == 2
    left = unidentified_calls(numbered, found, "row_no").collect()
    assert sorted(r.summary for r in left) == sorted(t for _, t in texts if "nothing" in t)
    ranked = ranked_topics(found.drop("topic"), topics, key="row_no")
    lists = {r.summary: r.top_topics for r in rerank(numbered, ranked, LexicalClassifier(), "row_no").collect()}
    assert lists == {TOPICS[0]: ["T0"], TOPICS[2]: ["T2"], texts[1][1]: None, texts[3][1]: None}
    # by id alone, calls without one are one call, and none of them is lost
    by_id = unidentified_calls(numbered, topic_candidates(numbered, topics)).collect()
    assert by_id == []


def test_no_call_is_lost_with_an_odd_number(spark):
    calls = summaries(spark, *[TOPICS[i % 3] for i in range(3)])
    assert assign_topics(calls, catalogue(spark, *TOPICS), LexicalClassifier()).count() == 3


def test_failing_classifier_leaves_the_call_unidentified(spark):
    class Broken:
        def load(self):
            def run(text, candidates):
                raise RuntimeError("no model")

            return run

    row = assign_topics(summaries(spark, TOPICS[0]), catalogue(spark, *TOPICS), Broken()).first()
    assert (row.primary_topic, row.secondary_topic, row.error) == ("Unidentified", "None", "no model")


def test_encoder_form_finds_the_same_pairs(spark):
    # every term has a slot of its own, so the vectors are the term counts
    calls, topics = summaries(spark, *TOPICS), catalogue(spark, *TOPICS)
    dense = encoded_candidates(calls, topics, HashingEncoder(1 << 14), threshold=0.5)
    lexical = topic_candidates(calls, topics)
    pick = ("conv_id", "position", "topic", "cos_sim", "sentence")
    assert sorted(dense.select(*pick).collect()) == sorted(lexical.where("cos_sim > 0.5").select(*pick).collect())
    assert assign_topics(calls, topics, LexicalClassifier(), HashingEncoder(64)).count() == 3


def test_one_call_with_a_third_of_all_sentences(spark):
    hot = ". ".join([TOPICS[0]] * 3000)
    calls = summaries(spark, hot, *([TOPICS[1] + ". " + TOPICS[2]] * 3000))
    topics = catalogue(spark, *TOPICS)
    matches = lexical_matches(split_sentences(calls, text="summary"), topics)
    counts = matches.groupBy("conv_id").count().agg(F.max("count"), F.sum("count")).first()
    assert tuple(counts) == (3000, 9000)
    assert top_topics(matches).count() == 10 + 2 * 3000


# --- models in batches, once a text, on their own resources -----------------------------------------------


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import this file


class Counting:
    """Counts the calls and the texts that a model is shown."""

    def __init__(self, spark, inner):
        self.inner, self.calls, self.texts = inner, spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def _counted(self, run):
        def call(batch):
            self.calls.add(1)
            self.texts.add(len(batch))
            return run(batch)

        return call

    def load(self):
        return self._counted(self.inner.load())


class CountingPairs(Counting):
    def load_pairs(self):
        return self._counted(self.inner.load_pairs())


def test_pairs_of_many_rows_go_to_the_classifier_in_one_call(spark):
    texts = [TOPICS[0], TOPICS[0] + ". " + TOPICS[1], TOPICS[2], "nothing that is known to anyone"] * 65
    calls, topics = summaries(spark, *texts).coalesce(1), catalogue(spark, *TOPICS)
    ranked = ranked_topics(lexical_matches(split_sentences(calls, text="summary"), topics), topics)
    one_by_one = {r.conv_id: r.labels for r in rerank(calls, ranked, RowByRow()).collect()}
    counting = CountingPairs(spark, LexicalClassifier())
    asked = rerank(calls, ranked, counting).select("conv_id", "labels").cache()
    assert {r.conv_id: r.labels for r in asked.collect()} == one_by_one
    batches = asked.rdd.getNumPartitions()
    assert 195 / 64 <= counting.calls.value <= 195 / 64 + batches and counting.texts.value == 65 * 4


class RowByRow:
    """The same scores, asked for row by row."""

    def load(self):
        score = LexicalClassifier().load_pairs()

        def run(text, candidates):
            values = score([(text, *one) for one in candidates])
            total = sum(values)
            order = sorted(range(len(values)), key=lambda k: -values[k])
            return [(candidates[k][0], values[k] / total if total else 1 / len(values)) for k in order]

        return run


class Choosy:
    """Fails where a text holds ``bad``, and gives too few scores where it holds ``few``."""

    def load_pairs(self):
        def run(pairs):
            if any("bad" in text for text, _, _ in pairs):
                raise RuntimeError("refused")
            return [1.0] * (len(pairs) - any("few" in text for text, _, _ in pairs))

        return run


def test_a_failing_row_leaves_the_others_of_its_call_alone(spark):
    texts = [TOPICS[k % 3] + {17: " bad", 40: " few"}.get(k, "") for k in range(100)]
    rows = assign_topics(summaries(spark, *texts).coalesce(1), catalogue(spark, *TOPICS), Choosy()).collect()
    problems = {r.conv_id: r.error for r in rows if r.error}
    assert problems == {17: "refused", 40: "the classifier gave scores of shape (0,) to 1 pairs"}
    assert all(r.primary_topic == f"T{r.conv_id % 3}" for r in rows if not r.error)


def test_each_distinct_sentence_is_encoded_once(spark):
    texts = [TOPICS[k % 3] + ". " + TOPICS[0] for k in range(200)]
    counting, topics = Counting(spark, HashingEncoder(1 << 14)), catalogue(spark, *TOPICS)
    got = assign_topics(summaries(spark, *texts), topics, LexicalClassifier(), counting).collect()
    plain = assign_topics(summaries(spark, *texts), topics, LexicalClassifier()).collect()
    pick = lambda rows: sorted((r.conv_id, r.primary_topic, r.secondary_topic) for r in rows)
    assert pick(got) == pick(plain)
    # " " + T0 and the three topics as sentences, and the three descriptions
    assert counting.texts.value == 4 + 3


def test_a_profile_is_asked_for_by_the_stage_of_the_model_only(spark):
    profile = gpu_profile(gpus_per_executor=2, tasks_per_gpu=2, memory="4g")
    assert profile.taskResources["gpu"].amount == 0.5 and profile.executorResources["gpu"].amount == 2
    calls = summaries(spark, *TOPICS).repartition(2, "conv_id")
    model = RefusingModel(ExtractiveModel(), "cancel")
    placed = with_model(calls, "answer", texts_of(model), TEXT, "summary", profile=profile).groupBy("answer.error").count()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Profile" in line]
    assert len(lines) == 1 and "MapInArrow" in lines[0] and "gpu" in lines[0]
    free = with_model(calls, "answer", texts_of(model), TEXT, "summary").groupBy("answer.error").count()
    assert "Profile" not in free._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["text", "vector", "labels"])
def test_whole_rows_through_a_model_stage_give_the_same_rows(spark, kind, monkeypatch):
    # a local session cannot grant a profile, so the stage runs without its request
    rows = [(2**53 + 1, "a b c", [("T", "a b"), ("U", "c d")]), (None, None, None), (3, "bad", []), (4, "c", [("U", "c")])]
    table = spark.createDataFrame(rows, "conv_id long, summary string, candidates array<struct<topic: string, description: string>>")
    work, type_, inputs = {
        "text": (texts_of(RefusingModel(ExtractiveModel(), "bad")), TEXT, ["summary"]),
        "vector": (vectors_of(RefusingModel(HashingEncoder(8), "bad")), VECTOR, ["summary"]),
        "labels": (labels_of(LexicalClassifier()), LABELS, ["summary", "candidates"]),
    }[kind]
    plain = with_model(table, "out", work, type_, *inputs).collect()
    original = type(table).mapInArrow
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, run, schema, profile: original(self, run, schema))
    staged = with_model(table, "out", work, type_, *inputs, profile=object())
    assert staged.columns == [*table.columns, "out"] and sorted(map(str, staged.collect())) == sorted(map(str, plain))
