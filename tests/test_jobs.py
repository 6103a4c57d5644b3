"""Jobs, files, streams, and the registered queries against their SQL twins."""

import sys
import types
from dataclasses import dataclass
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from callweave.operators.merge import merge_utterances
from callweave.operators.scoring import predict
from callweave.operators.similarity import SENTENCE_NO, lexical_matches, lexical_tiles, term_vectors
from callweave.plans.jobs import RunReport, run_summarise_job, run_topic_job
from callweave.plans.summarise import extractive_summaries
from callweave.plans.topics import assign_topics
from callweave.scorers.builtin import ExtractiveModel, HashingEncoder, LexicalClassifier, RefusingModel
from callweave.scorers.registered import RegisteredFrameModel, RegisteredModel
from callweave.session import number_rows
from callweave.sources.catalogue import Catalogue, read_catalogue
from callweave.sources.files import file_inventory, read_files
from callweave.sources.sinks import add_to_run, read_runs, write_run
from callweave.sources.spread import fill_cluster
from callweave.sources.transcripts import CALLS_SCHEMA, read_summaries
from callweave.streaming.drops import process_new_drops
from check import normalise

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in sorted(Path(SF_DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) & {query.__name__ for query in entry_point.QUERIES}))
def test_query_equals_sql(spark, sql, name):
    got, want = QUERIES[name](spark, SF_DIR).toPandas(), sql.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normalise(got) == normalise(want)


def test_queries_without_sql_are_known():
    own = {query.__name__ for query in entry_point.QUERIES}
    assert own == own & set(ORACLES)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 20


def calls(spark, *texts, start=0):
    rows = [(start + i, [(0, "user", t[: len(t) // 2]), (1, "assistant", t[len(t) // 2 :])]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CALLS_SCHEMA)


BILL = "my bill is far too high. please lower my bill this month because it is far too high"


def test_both_jobs_hand_over_by_run_date(spark, tmp_path):
    source, summaries, topics = (str(tmp_path / name) for name in ("calls", "summaries", "topics"))
    calls(spark, BILL, "hello", BILL).write.parquet(source)
    (tmp_path / "topics.json").write_text('{"zeta bill": "my bill is far too high", "alpha line": "the line is down"}')
    catalogue = Catalogue(read_catalogue(spark, str(tmp_path / "topics.json")).drop("file"))
    assert [tuple(r) for r in catalogue.topics.select("topic_no", "topic").collect()] == [(0, "zeta bill"), (1, "alpha line")]

    assert run_summarise_job(spark, source, summaries, "2026_01_31") == RunReport(3, 0, 1)
    assert run_summarise_job(spark, source, summaries, "2026_02_01", ExtractiveModel()) == RunReport(3, 0, 1)
    for _ in range(2):  # a repeated run replaces its own day only
        report = run_topic_job(spark, summaries, catalogue, topics, "2026_01_31", LexicalClassifier())
        assert report == RunReport(3, 0, 1)
    run_topic_job(spark, summaries, catalogue, topics, "2026_02_01", LexicalClassifier())
    got = read_runs(spark, topics, "conv_id long, primary_topic string")
    assert got.groupBy("run_date").count().count() == 2 and got.count() == 6
    assert {r.conv_id: r.primary_topic for r in got.collect()} == {0: "zeta bill", 1: "Unidentified", 2: "zeta bill"}


@pytest.mark.parametrize("whole_file", [True, False])
def test_catalogue_numbers_run_through_the_source(spark, tmp_path, whole_file):
    first, second = '{"b": "one", "a": "two"}', '{"c": "three", "b": "last"}'
    if whole_file:
        (tmp_path / "1.json").write_text(first)
        (tmp_path / "2.json").write_text(second)
    else:
        (tmp_path / "t.json").write_text(f"{first}\n\n{second}\n")
    rows = read_catalogue(spark, str(tmp_path), whole_file).collect()
    assert sorted((r.topic_no, r.topic, r.description) for r in rows) == [(0, "b", "last"), (1, "a", "two"), (2, "c", "three")]


@pytest.mark.parametrize("text", ['{"a": ', "null", "[1]"])
def test_malformed_catalogue_raises(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|no topic catalogue|FAILFAST|parse"):
        read_catalogue(spark, str(tmp_path)).collect()


def test_topics_of_two_files_are_told_apart(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"bill": "my bill is too high"}')
    (tmp_path / "2.json").write_text('{"line": "the line is dead again today"}')
    summaries = spark.createDataFrame([(1, "my bill is too high", None)], "conv_id long, summary string, error string")
    row = assign_topics(summaries, Catalogue(read_catalogue(spark, str(tmp_path))), LexicalClassifier()).first()
    assert (row.primary_topic, row.secondary_topic) == ("bill", "None")


def test_a_sentence_the_encoder_refuses_marks_its_call(spark):
    texts = [(1, "my bill is too high. this is a bad sentence here", None), (2, "my bill is too high", None)]
    summaries = spark.createDataFrame(texts, "conv_id long, summary string, error string")
    topics = Catalogue(spark.createDataFrame([(0, "bill", "my bill is too high")], "topic_no long, topic string, description string"))
    rows = assign_topics(summaries, topics, LexicalClassifier(), RefusingModel(HashingEncoder(64), "bad"), parallelism=2)
    assert sorted((r.conv_id, r.primary_topic, r.error) for r in rows.collect()) == [(1, "bill", "prompt refused"), (2, "bill", None)]


def days_of(spark, path):
    return {r.run_date: r["count"] for r in read_runs(spark, path, "id long").groupBy("run_date").count().collect()}


def test_a_run_replaces_its_own_date_only(spark, tmp_path):
    path = str(tmp_path / "out")
    write_run(spark.range(3), path, "2026_01_30")
    write_run(spark.range(5), path, "2026_01_31")
    write_run(spark.range(2).selectExpr("id", "'other' AS run_date", "1 AS version"), path, "2026_01_31")
    assert days_of(spark, path) == {"2026_01_30": 3, "2026_01_31": 2}
    write_run(spark.range(0), path, "2026_01_31")
    assert days_of(spark, path) == {"2026_01_30": 3}
    assert read_runs(spark, path, "id long", "2026_01_31").count() == 0
    for missing in (lambda: read_runs(spark, path, "id long", "2026_02_01"), lambda: read_runs(spark, str(tmp_path / "no"), "id long")):
        with pytest.raises(ValueError, match="no run"):
            missing()


def test_a_failing_rerun_leaves_the_old_run(spark, tmp_path):
    path = str(tmp_path / "out")
    write_run(spark.range(0, 40, 1, 4), path, "2026_01_31")
    before = read_runs(spark, path, "id long", "2026_01_31")
    broken = spark.range(0, 40, 1, 4).withColumn("id", F.when(F.col("id") < 30, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        write_run(broken, path, "2026_01_31")
    assert read_runs(spark, path, "id long", "2026_01_31").count() == before.count() == 40
    # files of an attempt whose job was killed are not read either, and a reader that began before a new run ends with the old one
    (spark.range(9).write.parquet(f"{path}/data/run_date=2026_01_31/version=killed"))
    write_run(spark.range(7), path, "2026_01_31")
    assert days_of(spark, path) == {"2026_01_31": 7} and before.count() == 40


def test_parts_are_added_once_and_replaced_together(spark, tmp_path):
    path = str(tmp_path / "out")
    assert add_to_run(spark.range(3), path, "a", "s-0") and add_to_run(spark.range(4), path, "a", "s-1")
    assert not add_to_run(spark.range(3), path, "a", "s-0") and not add_to_run(spark.range(3), path, "b", "s-0")
    assert days_of(spark, path) == {"a": 7}
    write_run(spark.range(1), path, "a")
    assert add_to_run(spark.range(2), path, "a", "s-2")
    assert days_of(spark, path) == {"a": 3}


def test_a_batch_that_ended_early_or_is_run_again_counts_once(spark, tmp_path):
    drops, out, progress = (str(tmp_path / name) for name in ("drops", "out", "progress"))
    step = lambda df: extractive_summaries(merge_utterances(df))
    calls(spark, BILL, "hi").coalesce(1).write.parquet(drops)
    process_new_drops(spark, drops, step, out, progress, "2026_01_01")
    # the job ends after the result is in the run, before the checkpoint knows
    for marker in Path(progress, "commits").iterdir():
        marker.unlink()
    # and an attempt at some batch left files behind
    step(calls(spark, BILL, start=50)).write.parquet(f"{out}/data/run_date=2026_01_01/version=early")
    calls(spark, BILL, start=10).coalesce(1).write.mode("append").parquet(drops)
    process_new_drops(spark, drops, step, out, progress, "2026_01_01")
    assert sorted(r.conv_id for r in read_summaries(spark, out, "2026_01_01").collect()) == [0, 1, 10]
    # a new checkpoint is another stream: its batches are not taken for those of the first
    process_new_drops(spark, drops, step, out, str(tmp_path / "new"), "2026_01_02")
    assert sorted(r.conv_id for r in read_summaries(spark, out, "2026_01_02").collect()) == [0, 1, 10]


def test_file_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "one.bin").write_bytes(b"12")
    (tmp_path / "a" / "b" / "two.bin").write_bytes(b"345")
    (tmp_path / "a" / "skip.txt").write_bytes(b"")
    assert sorted((r.name, r.length) for r in file_inventory(spark, str(tmp_path), "*.bin").collect()) == [("one.bin", 2), ("two.bin", 3)]
    assert sorted(bytes(r.content) for r in read_files(spark, str(tmp_path), "*.bin").collect()) == [b"12", b"345"]
    assert "content" not in file_inventory(spark, str(tmp_path)).columns


def test_drops_are_processed_once(spark, tmp_path):
    drops, out, progress = (str(tmp_path / name) for name in ("drops", "out", "progress"))
    step = lambda df: extractive_summaries(merge_utterances(df))
    for day in range(3):
        if day < 2:
            calls(spark, BILL, "hi", start=10 * day).write.mode("append").parquet(drops)
        process_new_drops(spark, drops, step, out, progress, f"2026_01_0{day}", files_per_batch=1)
    rows = read_runs(spark, out, "conv_id long").collect()
    assert sorted((r.run_date, r.conv_id) for r in rows) == [(f"2026_01_0{c // 10}", c) for c in (0, 1, 10, 11)]
    topics = Catalogue(spark.createDataFrame([(0, "bill", BILL)], "topic_no long, topic string, description string"))
    report = run_topic_job(spark, out, topics, str(tmp_path / "topics"), "2026_01_01", LexicalClassifier())
    assert report == RunReport(rows=2, failed=0, left_out=1)


def test_only_a_source_with_few_partitions_is_spread(spark):
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 64)
    assert fill_cluster(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert fill_cluster(many, "id").rdd.getNumPartitions() == 64


def test_registered_model_needs_its_library_only_where_it_runs():
    assert RegisteredModel("models:/x/1") == RegisteredModel("models:/x/1")
    with pytest.raises(ImportError):
        RegisteredModel("models:/x/1").load()


@dataclass(frozen=True)
class Ratio:
    """Two inputs, two outputs; refuses a frame with a zero."""

    inputs: tuple[str, ...] = ("a", "b")
    outputs: str = "ratio double, larger string"

    def load(self):
        def run(frame):
            if (frame["b"] == 0).any():
                raise ZeroDivisionError("b is zero")
            if (frame["a"] == 99).any():
                return pd.DataFrame({"ratio": [], "larger": []})
            return pd.DataFrame({"larger": ["a" if a > b else None for a, b in zip(frame.a, frame.b)], "ratio": frame.a / frame.b, "more": 1})

        return run


def test_a_model_with_several_columns_scores_every_row(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = [(k, float(k % 7), float(k % 5)) for k in range(150)] + [(2**53 + 1, 99.0, 1.0), (None, 3.0, 2.0)]
    table = spark.createDataFrame(rows, "id long, a double, b double").coalesce(1)
    got = {r.id: r.out for r in predict(table, Ratio(), "out").collect()}
    assert len(got) == len(rows)
    for k, a, b in rows:
        want = (a / b, "a" if a > b else None, None) if b and a != 99 else (None, None, "b is zero" if not b else "the model gave 0 answers to 1 prompts")
        assert tuple(got[k]) == want
    assert predict(table.limit(0), Ratio()).count() == 0


def test_registered_models_are_given_frames(monkeypatch):
    class Stub:
        def predict(self, frame):
            return (frame["a"] + frame["b"]).to_numpy()

    module = types.ModuleType("mlflow.pyfunc")
    module.load_model = lambda uri: Stub()
    monkeypatch.setitem(sys.modules, "mlflow", types.ModuleType("mlflow"))
    monkeypatch.setitem(sys.modules, "mlflow.pyfunc", module)
    sys.modules["mlflow"].pyfunc = module
    run = RegisteredFrameModel("models:/x/1", ("a", "b"), "total double").load()
    assert run(pd.DataFrame({"a": [1, 2], "b": [3, 4]}))["total"].tolist() == [4, 6]


# --- plans -------------------------------------------------------------------------------------------------


def executed_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_ten_is_cut_before_the_shuffle(spark):
    plan = executed_plan(QUERIES["topic_top10"](spark, SF_DIR))
    assert plan.count("WindowGroupLimit") >= 2
    assert plan.split("== Initial Plan ==")[0].count("match(") == 1  # the matching itself runs once
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["transcript_merge", "token_count", "text_chunks", "lead_summary", "sentence_split", "agent_actions"])
def test_built_in_steps_need_no_python(spark, name):
    plan = executed_plan(QUERIES[name](spark, SF_DIR))
    assert "Python" not in plan and "InPandas" not in plan


def test_merge_without_long_calls_drops_the_join(spark):
    final = executed_plan(QUERIES["transcript_merge"](spark, SF_DIR)).split("== Initial Plan ==")[0]
    assert "Join" not in final and final.count("Exchange") == 1


def test_scan_reads_only_what_is_used(spark):
    plan = executed_plan(QUERIES["token_count"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_scoring_evaluates_calls_once(spark):
    final = executed_plan(QUERIES["summarise_long_rows"](spark, SF_DIR)).split("== Initial Plan ==")[0]
    # the calls are written once; one scan of them makes the prompts, one takes the answers, which carry no transcript
    assert final.count("FileScan") == 2 and "documents" not in final


def test_a_catalogue_too_big_to_broadcast_is_matched_in_tiles(spark):
    topics = entry_point._topics(spark, SF_DIR)
    far = Catalogue(topics.topics, max_broadcast_bytes=0, block_bytes=1000)
    sentences = entry_point.split_sentences(entry_point._calls(spark, SF_DIR))
    matched, direct = lexical_matches(sentences, far), lexical_matches(sentences, topics)
    pick = ("conv_id", "position", "topic_no", "dot", "sentence_sq", "topic_sq", "cos_sim")
    assert sorted(matched.select(*pick).collect()) == sorted(direct.select(*pick).collect())
    plan = executed_plan(matched)
    assert plan.count("CoGroup") >= 1 and "NestedLoop" not in plan and "CartesianProduct" not in plan

    numbered = number_rows(sentences, SENTENCE_NO)
    postings = term_vectors(far.topics, ["topic_no"], "description").withColumnsRenamed({"tf": "topic_tf", "squared_norm": "topic_sq"})
    tiles = lexical_tiles(numbered, postings, far.blocks, "sentence", (2, 5))
    assert far.blocks > 5 and tiles.rows.count() < 0.8 * tiles.total_rows * far.blocks
