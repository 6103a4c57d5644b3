"""Registered queries: each takes a session and a folder of the given tables and returns a DataFrame."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from callweave.constants import MAX_BROADCAST_BYTES, TOP_TOPICS  # noqa: E402
from callweave.functions import text as tx  # noqa: E402
from callweave.functions.prompts import actions_prompt, summary_prompt  # noqa: E402
from callweave.functions.splitting import boundary_chunks as split_at_boundaries  # noqa: E402
from callweave.functions.values import primary_topic, run_date, secondary_topic, topic_list  # noqa: E402
from callweave.functions.vectors import cosine  # noqa: E402
from callweave.operators.calls import combine_chunks, is_long_enough, split_chunks, split_sentences, with_token_count  # noqa: E402
from callweave.operators.merge import merge_turns, merge_utterances, utterance_arrays  # noqa: E402
from callweave.operators.ranking import top_topics  # noqa: E402
from callweave.operators.scoring import generate, predict  # noqa: E402
from callweave.operators.similarity import dense_matches, label_centroids, lexical_matches, term_vectors  # noqa: E402
from callweave.plans import summarise as sm  # noqa: E402
from callweave.plans import topics as tp  # noqa: E402
from callweave.scorers.builtin import HashingEncoder, ExtractiveModel, LexicalClassifier, RefusingModel, TermModel  # noqa: E402
from callweave.session import materialise, number_rows, scratch_path, ship_package  # noqa: E402
from callweave.sources.catalogue import Catalogue, catalogue_from_table, read_catalogue  # noqa: E402
from callweave.sources.files import file_inventory as list_files  # noqa: E402
from callweave.sources.files import read_files  # noqa: E402
from callweave.sources.sinks import read_runs, write_run  # noqa: E402
from callweave.sources.spread import fill_cluster  # noqa: E402
from callweave.sources.transcripts import SUMMARIES_SCHEMA, read_calls, read_summaries, read_turns  # noqa: E402
from callweave.streaming.drops import process_new_drops  # noqa: E402
from oracles import ORACLES, REFUSED  # noqa: E402

try:  # the operators of the training-data pipeline may be absent
    import corpus_pipeline
    from callweave.llm.oracles import ORACLES as LLM_ORACLES
    from callweave.llm.queries import QUERIES as LLM_QUERIES
except ImportError:
    corpus_pipeline, LLM_ORACLES, LLM_QUERIES = None, {}, ()

Query = Callable[[SparkSession, str], DataFrame]

# declared, so that planning reads no file footers
DOCUMENTS = "doc_id bigint, text string, lang string, source string"
PAGES = "page_id bigint, url string, html string"
BENCHMARK = "item_id bigint, text string"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"
WRITTEN = T.StructType([*SUMMARIES_SCHEMA, T.StructField("run_date", T.StringType())])
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


# --- the given tables in their roles -----------------------------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_turns(spark, f"{sf_dir}/conversations.parquet")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_turns(_turns(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_cluster(spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")


def _documents_as_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        F.col("doc_id").alias("conv_id"), F.col("text").alias("transcription"), F.lit(None).cast("string").alias("error")
    )


def _topics(spark: SparkSession, sf_dir: str) -> Catalogue:
    return catalogue_from_table(spark.read.schema(BENCHMARK).parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table the summarise job hands to the topic job."""
    path = scratch_path(spark, "summaries")
    sm.extractive_summaries(_calls(spark, sf_dir)).drop("transcription").write.parquet(path)
    return read_summaries(spark, path)


# --- merge, count, gate, chunk -----------------------------------------------------------------------------


def transcript_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).drop("agent_text")


def transcript_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "calls")
    utterance_arrays(_turns(spark, sf_dir)).write.parquet(path)
    return merge_utterances(read_calls(spark, path)).select(
        "conv_id", F.size("anonymized").cast("bigint").alias("utterances"), "transcription", "agent_text"
    )


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_count(_documents(spark, sf_dir), "text").select("doc_id", "word_count")


def short_call_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_token_count(_documents_as_calls(spark, sf_dir))
    return sm.gate(counted).select(
        F.col("conv_id").alias("doc_id"), "word_count", "is_scored", "actions_taken", "summary"
    )


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(_documents(spark, sf_dir), "doc_id", "text")


def boundary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    chunks = split_at_boundaries(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk"))


def chunk_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text_chunks(spark, sf_dir).select("doc_id", "chunk_no", tx.extract(F.col("chunk")).alias("summary"))
    return combine_chunks(parts, "doc_id")


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", summary_prompt(text).alias("summary_prompt"), actions_prompt(text).alias("actions_prompt")
    )


# --- summaries ---------------------------------------------------------------------------------------------


def lead_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.extractive_summaries(_calls(spark, sf_dir))


def agent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("conv_id", tx.extract(F.col("agent_text")).alias("actions_taken"))


def summarise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sm.summarise_calls(_calls(spark, sf_dir), ExtractiveModel(), ExtractiveModel())


def summarise_long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sm.summarise_calls(_documents_as_calls(spark, sf_dir), ExtractiveModel(), ExtractiveModel())


def summarise_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sm.summarise_in_place(_documents_as_calls(spark, sf_dir), ExtractiveModel(), ExtractiveModel())


def error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = RefusingModel(ExtractiveModel(), REFUSED)
    return sm.summarise_calls(_documents_as_calls(spark, sf_dir), model, model).drop("transcription")


def batch_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return _documents(spark, sf_dir).select("doc_id", generate(ExtractiveModel(), "text")["text"].alias("output"))


def frame_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(fill_cluster(table, "doc_id"), TermModel()).select("doc_id", "prediction.*")


# --- topics ------------------------------------------------------------------------------------------------


def topic_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "catalogue")
    topics = spark.read.schema(BENCHMARK).parquet(f"{sf_dir}/benchmark.parquet").withColumn("shard", F.expr("item_id div 1000"))
    entries = F.sort_array(F.collect_list(F.struct("item_id", "text")))
    named = F.transform(entries, lambda t: F.struct(t["item_id"].cast("string").alias("key"), t["text"].alias("value")))
    objects = topics.groupBy("shard").agg(F.to_json(F.map_from_entries(named)).alias("value"))
    objects.write.partitionBy("shard").text(path)
    return read_catalogue(spark, path, whole_file=False)


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(_documents(spark, sf_dir), "doc_id", "text")


def lexical_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_vectors(sentence_split(spark, sf_dir), ["doc_id", "position"], "sentence")


def lexical_cosine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return lexical_matches(split_sentences(_calls(spark, sf_dir)), _topics(spark, sf_dir)).drop("sentence")


def dense_cosine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    embeddings = spark.read.schema(EMBEDDINGS).parquet(f"{sf_dir}/embeddings.parquet")
    vectors = embeddings.select("vec_id", F.col("embedding").alias("vector"))
    return dense_matches(vectors, label_centroids(embeddings), 0.2)


def lexical_cosine_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``lexical_cosine_join``, as if the catalogue were too big to broadcast."""
    topics = Catalogue(_topics(spark, sf_dir).topics, max_broadcast_bytes=0, block_bytes=4096)
    return lexical_matches(split_sentences(_calls(spark, sf_dir)), topics).drop("sentence")


def dense_cosine_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with every vector, as if they were too many to broadcast."""
    embeddings = spark.read.schema(EMBEDDINGS).parquet(f"{sf_dir}/embeddings.parquet")
    vectors = embeddings.select("vec_id", F.col("embedding").alias("vector"))
    topics = vectors.withColumnRenamed("vec_id", "topic_no")
    return dense_matches(vectors, topics, 0.4, max_broadcast_bytes=0, block_bytes=1 << 16)


def centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.schema(EMBEDDINGS).parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    centroids = materialise(label_centroids(embeddings), "centroids")
    count, width = centroids.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    side = centroids.withColumnRenamed("topic_no", "label")
    side = F.broadcast(side) if count * (width or 0) * 8 <= MAX_BROADCAST_BYTES else side
    return embeddings.withColumn("label", F.col("label").cast("bigint")).join(side, "label").select(
        "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("cos_sim")
    )


def encoded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return tp.encoded_candidates(_summaries(spark, sf_dir), _topics(spark, sf_dir), HashingEncoder(256))


def encoder_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    texts = _documents(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), F.col("text").alias("summary"))
    encoder = RefusingModel(HashingEncoder(16), REFUSED)
    return tp.encoded_sentences(texts, encoder).select(
        F.col("conv_id").alias("doc_id"), "position", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("terms"), "error"
    )


def topic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    texts = _documents(spark, sf_dir).withColumnRenamed("doc_id", "conv_id")
    found = tp.topic_candidates(texts, _topics(spark, sf_dir), "text")
    return found.withColumnRenamed("conv_id", "doc_id").select(
        "doc_id", "position", "sentence", "topic_no", "topic", "cos_sim"
    )


def topic_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    topics = _topics(spark, sf_dir)
    ranked = tp.ranked_topics(lexical_matches(split_sentences(_calls(spark, sf_dir)), topics), topics)
    return ranked.select("conv_id", "rank", "position", "topic_no", "topic", "cos_sim")


def topic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    summaries, topics = _summaries(spark, sf_dir), _topics(spark, sf_dir)
    matches = lexical_matches(split_sentences(summaries, text="summary"), topics)
    ranked = tp.ranked_topics(matches, topics)
    labels = tp.rerank(summaries, ranked, LexicalClassifier())
    return labels.select("conv_id", F.posexplode("labels").alias("place", "entry")).select(
        "conv_id",
        (F.col("place") + 1).cast("bigint").alias("label_rank"),
        "entry.label",
        F.round("entry.score", 6).alias("score"),
    )


def topic_primary_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return tp.assign_topics(_summaries(spark, sf_dir), _topics(spark, sf_dir), LexicalClassifier())


def _summaries_with_shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls to an id, and every seventh call without one."""
    shared = F.when(F.col("conv_id") % 7 != 0, F.expr("conv_id div 3"))
    return _summaries(spark, sf_dir).withColumn("conv_id", shared)


def topic_row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labelled = tp.labelled_summaries(_summaries_with_shared_ids(spark, sf_dir), _topics(spark, sf_dir), LexicalClassifier())
    return labelled.select(
        "conv_id",
        "summary",
        F.array_join("top_topics", "|").alias("top_topics"),
        primary_topic(F.col("labels")).alias("primary_topic"),
        secondary_topic(F.col("labels")).alias("secondary_topic"),
        "error",
    )


def unidentified_row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    summaries = number_rows(_summaries_with_shared_ids(spark, sf_dir))
    matches = lexical_matches(split_sentences(summaries, "row_no", "summary"), _topics(spark, sf_dir), ("row_no", "position"))
    return tp.unidentified_calls(summaries, matches, "row_no").select("conv_id", "summary")


def unidentified_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    summaries = _summaries(spark, sf_dir)
    matches = lexical_matches(split_sentences(summaries, text="summary"), _topics(spark, sf_dir))
    return tp.unidentified_calls(summaries, matches).select("conv_id", "summary")


# --- sources, sinks, runs ----------------------------------------------------------------------------------


#: lists of two columns of a document in the forms that are met, L and S for the columns
LIST_FORMS = (
    "['L', 'S']",
    '["L","S"]',
    "('L', 'S')",
    "['L', 'S',]",
    "('L',)",
    "[None, 'S']",
    "[1, -2.5, 'L']",
    "[['L', ('x',)], 'S']",
    r"""['L\'s', "S \"q\""]""",
    "[]",
    "S",
    "['L', 'S'",
    "('L')",
    '["L", null]',
    "['L' 'S']",
    r"['\x41é\t', True]",
    "[null, None]",
    "()",
)


def parse_topic_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    form = F.element_at(F.array(*map(F.lit, LIST_FORMS)), (F.col("doc_id") % len(LIST_FORMS) + 1).cast("int"))
    written = F.replace(F.replace(form, F.lit("L"), F.col("lang")), F.lit("S"), F.col("source"))
    return table.withColumn("topics", topic_list(written)).select(
        "doc_id",
        F.array_join("topics", "|").alias("topics"),
        F.when(F.col("topics").isNotNull(), F.size("topics")).cast("bigint").alias("size"),
    )


def run_date_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(run_date(F.col("ts")).alias("run_date")).agg(F.count(F.lit(1)).alias("events"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = with_token_count(_calls(spark, sf_dir))
    found = lexical_cosine_join(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("found"))
    per_call = calls.select("conv_id", "word_count").join(found, "conv_id", "left").fillna(0, ["found"])
    return per_call.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(is_long_enough(F.col("word_count"))).alias("scored_calls"),
        F.count_if(F.col("found") == 0).alias("calls_without_candidate"),
        F.count_if(F.col("found") >= TOP_TOPICS).alias("calls_with_full_list"),
        F.sum("found").alias("candidates"),
    )


def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "summaries")
    summaries = lead_summary(spark, sf_dir)
    for day in ("2026_01_30", "2026_01_31", "2026_01_31", "2026_02_01"):  # the second write of a day replaces the first
        write_run(summaries, path, day)
    write_run(summaries.where(F.lit(False)), path, "2026_02_01")  # also if it has no rows
    return read_runs(spark, path, WRITTEN)


def failed_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rerun that breaks off half way leaves the run as it was."""
    path = scratch_path(spark, "summaries")
    summaries = lead_summary(spark, sf_dir)
    write_run(summaries, path, "2026_01_31")
    fails = F.when(F.col("conv_id") % 2 == 1, F.raise_error(F.lit("planned failure")).cast("string")).otherwise(F.col("summary"))
    try:
        write_run(summaries.withColumn("summary", fails), path, "2026_01_31")
    except Exception as problem:  # noqa: BLE001
        if "planned failure" not in str(problem):
            raise
        return read_runs(spark, path, WRITTEN)
    raise AssertionError("the rerun was to fail")


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tree")
    pages = spark.read.schema(PAGES).parquet(f"{sf_dir}/pages.parquet").where("page_id is not null")
    shard = F.expr("page_id div 100").alias("shard")
    line = F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("html", F.lit("")))
    tree = pages.select("page_id", shard, line.alias("value")).repartition("shard").sortWithinPartitions("shard", "page_id")
    tree.drop("page_id").write.partitionBy("shard").text(path)
    in_shard = lambda df: df.withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint"))
    listed = in_shard(list_files(spark, path, "*.txt")).groupBy("shard").agg(F.sum("length").alias("bytes"))
    content = in_shard(read_files(spark, path, "*.txt")).select("shard", F.md5("content").alias("content_md5"))
    return listed.join(content, "shard")


def incremental_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops, out, checkpoint = (scratch_path(spark, name) for name in ("drops", "out", "progress"))
    arrays = utterance_arrays(_turns(spark, sf_dir))
    ship_package(spark)
    summarise = lambda calls: sm.summarise_in_place(merge_utterances(calls), ExtractiveModel(), ExtractiveModel())
    for part in (0, 1):  # two drops, each picked up by the run that follows it
        arrays.where(F.pmod("conv_id", F.lit(2)) == part).write.mode("append").parquet(drops)
        process_new_drops(spark, drops, summarise, out, checkpoint, f"2026_02_0{part + 1}")
    return read_runs(spark, out, WRITTEN)


def stream_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the topic job reads of a stream whose first attempt at a batch ended early."""
    drops, out, checkpoint = (scratch_path(spark, name) for name in ("drops", "out", "progress"))
    utterance_arrays(_turns(spark, sf_dir)).write.parquet(drops)
    attempts = []

    def summarise(calls: DataFrame) -> DataFrame:
        result = sm.extractive_summaries(merge_utterances(calls))
        attempts.append(1)
        if len(attempts) == 1:
            return result.withColumn("summary", F.when(F.rand(1) < 2, F.raise_error(F.lit("planned failure")).cast("string")))
        return result

    try:
        process_new_drops(spark, drops, summarise, out, checkpoint, "2026_02_01")
    except Exception as problem:  # noqa: BLE001
        if "planned failure" not in str(problem):
            raise
    process_new_drops(spark, drops, summarise, out, checkpoint, "2026_02_01")
    return read_summaries(spark, out, "2026_02_01").select("conv_id", "summary")


QUERIES: tuple[Query, ...] = (
    transcript_merge,
    transcript_scan,
    token_count,
    short_call_gate,
    text_chunks,
    boundary_chunks,
    chunk_combine,
    prompt_build,
    lead_summary,
    agent_actions,
    summarise_rows,
    summarise_long_rows,
    summarise_in_place,
    error_isolation,
    batch_predict,
    frame_predict,
    topic_catalogue,
    sentence_split,
    lexical_vectors,
    lexical_cosine_join,
    dense_cosine_join,
    lexical_cosine_tiles,
    dense_cosine_tiles,
    centroid_cosine,
    encoded_candidates,
    encoder_isolation,
    topic_candidates,
    topic_top10,
    topic_rerank,
    topic_primary_secondary,
    topic_row_identity,
    unidentified_calls,
    unidentified_row_identity,
    parse_topic_list,
    run_date_key,
    run_stats,
    sink_roundtrip,
    failed_rerun,
    file_inventory,
    incremental_drop,
    stream_handover,
)


def queries() -> dict[str, Query]:
    found = {query.__name__: query for query in (*QUERIES, *LLM_QUERIES)}
    if corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = {**ORACLES, **LLM_ORACLES}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def entry(spark: SparkSession) -> DataFrame:
    return topic_primary_secondary(spark, "/root/testdata/sf0.001")
