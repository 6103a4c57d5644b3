"""Merging, gating and scoring."""

import sys
import tracemalloc
import types
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from callweave.constants import NO_ACTIONS, NO_SUMMARY, NULL_LIST_ERROR, NULL_TEXT_ERROR
from callweave.functions.splitting import boundary_chunks, split_text
from callweave.operators.merge import merge_turns, merge_utterances, utterance_arrays
from callweave.operators.scoring import _answers, classify, encode, generate, loaded
from callweave.plans.summarise import extractive_summaries, summarise_calls, summarise_in_place
from callweave.scorers.builtin import HashingEncoder, ExtractiveModel, LexicalClassifier, RefusingModel, extract_text
from callweave.scorers.registered import RegisteredModel
from callweave.sources.sinks import read_runs
from callweave.sources.transcripts import CALLS_SCHEMA, SUMMARIES_SCHEMA, TURNS_SCHEMA, read_calls
from callweave.streaming.drops import process_new_drops

LONG = "the quick brown fox jumps over the lazy dog. " * 4


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # models defined here travel to the tasks


def test_empty_and_null_utterances(spark):
    calls = spark.createDataFrame(
        [(1, []), (2, [(0, "user", "Hi"), (1, "agent", " there")]), (3, [(0, "user", "x"), (1, "user", None)])], CALLS_SCHEMA
    )
    rows = {r.conv_id: r for r in extractive_summaries(merge_utterances(calls).drop("anonymized")).collect()}
    assert (rows[1].transcription, rows[1].word_count) == ("", 0)
    assert (rows[1].actions_taken, rows[1].summary, rows[1].error) == (NO_ACTIONS, NO_SUMMARY, None)
    assert (rows[2].transcription, rows[2].error) == ("Hi there", None)
    assert rows[3].summary == rows[3].actions_taken == f"Error: {NULL_TEXT_ERROR}"
    assert rows[3].error == NULL_TEXT_ERROR


def test_long_calls_are_merged_by_segment(spark):
    turns = [(c, t, "user", f"{c}.{t} ") for c, n in ((1, 3), (2, 10), (3, 1000), (4, 4)) for t in range(n)]
    turns += [(5, 7, "user", "late only"), (6, 0, "user", None), (6, 9, "user", "b"), (7, None, "user", "no turn")]
    df = spark.createDataFrame(turns, TURNS_SCHEMA).repartition(7)
    want = {}
    for conv, _, _, text in sorted(turns, key=lambda t: (t[0], -1 if t[1] is None else t[1])):
        want[conv] = want.get(conv, "") + (text or "")
    rows = merge_turns(df, segment_turns=4).collect()
    assert {r.conv_id: r.transcription for r in rows} == want and len(rows) == len(want)
    assert [r.conv_id for r in rows if r.error] == [6]
    arrays = merge_utterances(utterance_arrays(df, segment_turns=4)).collect()
    assert {r.conv_id: r.transcription for r in arrays} == want and len(arrays) == len(want)


def test_a_call_of_5000_turns_is_one_row_in_every_form(spark):
    turns = [(1, t, "assistant" if t % 2 else "user", f"turn {t} said. ") for t in range(5000)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(turns, TURNS_SCHEMA).repartition(5)
    want = sorted(merge_turns(df).collect())
    got = merge_utterances(utterance_arrays(df)).select("conv_id", "transcription", "agent_text", "error")
    assert sorted(got.collect()) == want and len(want) == 2
    assert want[0].agent_text == "".join(t for _, _, role, t in turns[:5000] if role == "assistant")
    assert want[1].agent_text == "x"  # nobody is marked as the agent


def test_null_utterance_list_is_an_error_row(spark):
    calls = merge_utterances(spark.createDataFrame([(1, None), (2, [])], CALLS_SCHEMA))
    for rows in (extractive_summaries(calls), summarise_calls(calls, ExtractiveModel(), ExtractiveModel())):
        first, second = sorted(rows.collect())
        assert first.error == NULL_LIST_ERROR and first.summary == first.actions_taken == f"Error: {NULL_LIST_ERROR}"
        assert second.error is None and second.summary == NO_SUMMARY


def test_repeated_and_null_ids_keep_every_row(spark):
    rows = [(1, LONG, None), (1, LONG + "again.", None), (None, LONG, None), (None, None, None), (2, "hi", None), (2, "hi", None)]
    calls = spark.createDataFrame(rows, "conv_id bigint, transcription string, error string")
    order = lambda df: sorted(df.collect(), key=repr)
    got = order(summarise_calls(calls, ExtractiveModel(), ExtractiveModel()))
    assert len(got) == 6
    assert got == order(extractive_summaries(calls)) == order(summarise_in_place(calls, ExtractiveModel(), ExtractiveModel()))


def test_actions_are_asked_of_the_agent(spark):
    said = [(0, "user", "The first of all these words belongs to somebody else. " * 2), (1, "assistant", "Then the agent closed the ticket. ")]
    calls = merge_utterances(spark.createDataFrame([(1, said)], CALLS_SCHEMA))
    for rows in (extractive_summaries(calls), summarise_calls(calls, ExtractiveModel(), ExtractiveModel())):
        assert rows.first().actions_taken == "Then the agent closed the ticket." != rows.first().summary


@dataclass(frozen=True)
class ShortModel:
    """Gives too few answers, as a text or as a list."""

    kind: str

    def load(self):
        answers = {"text": lambda prompts: "only one", "list": lambda prompts: ["only one"], "long": lambda prompts: ["a"] * (len(prompts) + 1)}
        return answers[self.kind]


@pytest.mark.parametrize("kind", ["text", "list", "long"])
def test_answers_are_counted(spark, kind):
    calls = calls_of(spark, LONG, LONG + "b", LONG + "c").coalesce(1)
    for form in (summarise_calls, summarise_in_place):
        rows = form(calls, ShortModel(kind), ShortModel(kind)).collect()
        if kind == "long":
            assert all("answers to 1 prompts" in r.error for r in rows)
        else:
            assert [(r.summary, r.error) for r in rows] == [("only one", None)] * 3


def test_registered_model_with_one_text(spark, monkeypatch):
    fake = types.ModuleType("mlflow.pyfunc")
    fake.load_model = lambda uri: types.SimpleNamespace(predict=lambda frame: frame["text"].iloc[0].upper())
    package = types.ModuleType("mlflow")
    package.pyfunc = fake
    monkeypatch.setitem(sys.modules, "mlflow", package)
    monkeypatch.setitem(sys.modules, "mlflow.pyfunc", fake)
    texts, errors = _answers(RegisteredModel("models:/x").load(), ["a", "b", "c"])
    assert texts == ["A", "B", "C"] and errors == [None] * 3


@dataclass
class Unhashable:
    name: str

    def load(self):
        return list


def test_models_without_hash_are_loaded_each_time():
    assert loaded(Unhashable("a")) is list

def test_one_call_with_a_third_of_all_turns(spark):
    turns = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("conv_id"),
        F.when(F.col("id") % 3 == 0, F.col("id") / 3).otherwise(0).cast("bigint").alias("turn"),
        F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    merged = merge_turns(turns)
    assert merged.count() == 20001
    assert merged.where("conv_id = 0").first().transcription == "".join(str(3 * i) for i in range(10000))


def test_missing_source_raises(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_calls(spark, str(tmp_path / "nothing"))


def calls_of(spark, *texts):
    return spark.createDataFrame(
        [(i, t, None) for i, t in enumerate(texts)], "conv_id bigint, transcription string, error string"
    )


def test_scored_calls_equal_the_column_form(spark):
    calls = calls_of(spark, "", "too short", LONG, "word. " * 3000, "{} %s " * 30, "x. " * 20, "ab" * 5000, "é-" * 4500 + "tail", " " * 5000, " " * 9000 + LONG)
    got = sorted(summarise_calls(calls, ExtractiveModel(), ExtractiveModel()).collect())
    assert got == sorted(extractive_summaries(calls).collect())
    assert got == sorted(summarise_in_place(calls, ExtractiveModel(), ExtractiveModel()).collect())
    other = summarise_calls(calls, ExtractiveModel(10), ExtractiveModel(20), parallelism=3)
    assert other.count() == 10
    row = other.where("conv_id = 2").first()
    assert len(row.summary.split()) < 10 <= len(row.actions_taken.split()) < 20


def test_chunks_may_end_at_boundaries(spark):
    calls = calls_of(spark, "word. " * 1500, "too short")
    row, short = summarise_calls(calls, ExtractiveModel(), ExtractiveModel(), chunker=boundary_chunks).orderBy("conv_id").collect()
    want = [extract_text(c) for c in split_text("word. " * 1500, 4096, 50)]
    assert row.summary == "\n".join(want) and len(want) == 3 and row.word_count == 3000
    assert short.summary == NO_SUMMARY and short.word_count == 2


def test_calls_with_an_error_are_not_scored(spark):
    calls = calls_of(spark, LONG).withColumn("error", F.lit("broken"))
    row = summarise_calls(calls, ExtractiveModel(), ExtractiveModel()).first()
    assert (row.summary, row.actions_taken, row.error) == ("Error: broken", "Error: broken", "broken")
    assert row.transcription == LONG


def test_a_failing_prompt_fails_alone(spark):
    calls = calls_of(spark, *(LONG + ("bad" if i == 5 else f"n{i}") for i in range(11)))
    rows = summarise_calls(calls.coalesce(1), RefusingModel(ExtractiveModel(), "bad"), ExtractiveModel()).collect()
    failed = [r for r in rows if r.error]
    assert len(rows) == 11 and [r.conv_id for r in failed] == [5]
    assert failed[0].summary == failed[0].actions_taken == "Error: prompt refused"


@pytest.mark.parametrize("form", [summarise_calls, summarise_in_place])
def test_the_first_failing_part_decides(spark, form):
    calls = calls_of(spark, LONG, "ok. " * 2000 + " bad " + "x. " * 500, LONG + "bad")
    rows = {r.conv_id: r for r in form(calls, RefusingModel(ExtractiveModel(), "bad"), ExtractiveModel()).collect()}
    assert [bool(rows[i].error) for i in range(3)] == [False, True, True]
    assert rows[1].summary == rows[1].actions_taken == "Error: prompt refused"
    assert rows[1].word_count == 2 * 2000 + 1 + 2 * 500


def test_more_prompts_than_one_model_call_takes(spark):
    rows = calls_of(spark, *(f"n{i}. " + ("bad" if i % 50 == 7 else "") for i in range(200))).coalesce(1)
    got = rows.select("conv_id", generate(RefusingModel(ExtractiveModel(), "bad"), "transcription").alias("o")).collect()
    assert {r.conv_id for r in got if r.o.error} == {7, 57, 107, 157}
    assert all(r.o.text == f"n{r.conv_id}." for r in got if not r.o.error)


def test_models_with_value_equality_are_loaded_once_per_worker():
    assert loaded(ExtractiveModel(7)) is loaded(ExtractiveModel(7))


def test_every_row_is_predicted(spark):
    got = calls_of(spark, "a b. c", None, "d").select("conv_id", generate(ExtractiveModel(), "transcription").alias("o")).collect()
    assert [(r.o.text, r.o.error) for r in got] == [("a b. c.", None), (None, None), ("d.", None)]


def test_encoder_keeps_nulls_and_width(spark):
    got = [r[0] for r in calls_of(spark, "a b a", None).select(encode(HashingEncoder(16), "transcription")).collect()]
    assert len(got[0].vector) == 16 and sum(got[0].vector) == 3 and got[1] == (None, None)
    refusing = RefusingModel(HashingEncoder(16), "bad")
    got = [r[0] for r in calls_of(spark, "a", "bad", "b").select(encode(refusing, "transcription")).collect()]
    assert [r.error for r in got] == [None, "prompt refused", None] and got[1].vector is None and sum(got[2].vector) == 1


def test_classifier_orders_and_isolates(spark):
    rows = [(0, "pay the bill", [("X", "weather report"), ("Y", "pay a bill"), ("Z", "the bill")]), (1, "t", None), (2, "t", [])]
    df = spark.createDataFrame(rows, "id int, text string, c array<struct<topic string, description string>>")
    got = [r[0] for r in df.orderBy("id").select(classify(LexicalClassifier(), "text", "c")).collect()]
    assert [label.label for label in got[0].labels] == ["Z", "Y", "X"]
    assert abs(sum(label.score for label in got[0].labels) - 1) < 1e-9
    assert got[1].labels is None and got[2].labels is None
    bad = df.where("id = 0").withColumn("c", F.array(F.struct(F.lit("X").alias("topic"), F.lit(None).cast("string").alias("description"))))
    assert bad.select(classify(LexicalClassifier(), "text", "c").alias("o")).first().o.error


@dataclass(frozen=True)
class TracingModel:
    """Answers with the bytes of Python objects that are held when it is asked."""

    def load(self):
        tracemalloc.start()
        return lambda prompts: [str(tracemalloc.get_traced_memory()[0])] * len(prompts)


def test_texts_of_a_batch_are_not_all_held_at_once(spark):
    text = F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(". ")), 1500)
    calls = spark.range(2400).coalesce(1).select(F.col("id").alias("conv_id"), text.alias("transcription"), F.lit(None).cast("string").alias("error"))
    assert calls.agg(F.sum(F.length("transcription"))).first()[0] > 35e6
    rows = summarise_in_place(calls, TracingModel(), TracingModel()).select("actions_taken", "summary", "error").collect()
    assert len(rows) == 2400 and not any(r.error for r in rows)
    assert max(int(held) for r in rows for held in (r.actions_taken, *r.summary.split())) < 60e6  # the Arrow batch itself is 43e6


def test_a_drop_is_summarised_slice_by_slice(spark, tmp_path):
    text = F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(". ")), 1500)
    said = F.array(F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("assistant").alias("role"), text.alias("text")))
    spark.range(2400).coalesce(1).select(F.col("id").alias("conv_id"), said.alias("anonymized")).write.parquet(f"{tmp_path}/drops")
    summarise = lambda calls: summarise_in_place(merge_utterances(calls), TracingModel(), TracingModel())
    process_new_drops(spark, f"{tmp_path}/drops", summarise, f"{tmp_path}/out", f"{tmp_path}/progress", "2026_02_01")
    rows = read_runs(spark, f"{tmp_path}/out", SUMMARIES_SCHEMA).select("actions_taken", "summary", "error").collect()
    assert len(rows) == 2400 and not any(r.error for r in rows)
    assert max(int(held) for r in rows for held in (r.actions_taken, *r.summary.split())) < 60e6
