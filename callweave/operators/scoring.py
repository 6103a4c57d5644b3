"""Model calls as columns.

Only the columns a model needs cross to Python, in Arrow batches; the rest of the row waits in the JVM. A null prompt
is never shown to the model, so rows that failed a gate can stay in the same frame. The columns are declared
nondeterministic, which keeps the optimizer from calling a model twice for one row.

Given a resource profile, a model runs in a stage of its own that asks for it, such as a GPU for each task, while the stages
around it ask for nothing (``with_model``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from callweave.scorers import Encoder, FrameModel, PairClassifier, TextModel, ZeroShotClassifier
from callweave.session import ship_package


PROMPTS_PER_CALL = 64  # prompts, or texts with their candidates, handed to a model at a time
SLICE_BYTES = 4 << 20  # of an Arrow batch, what is held as Python texts at a time

TEXT = "struct<text: string, error: string>"
VECTOR = "struct<vector: array<float>, error: string>"
LABELS = "struct<labels: array<struct<label: string, score: double>>, error: string>"
Batches = Callable[[Iterator[tuple[pd.Series, ...]]], Iterator[pd.DataFrame]]


def _ship() -> None:
    """The functions below run in Python workers, which must find this package."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship_package(spark)


def loaded(model, how: str = "load"):
    """The loaded model, kept while the Python worker lives if the model has value equality (as frozen dataclasses do)."""
    try:
        kept = type(model).__eq__ is not object.__eq__ and hash(model) is not None
    except TypeError:  # a dataclass that is not frozen compares by value and has no hash
        kept = False
    return _load_kept(model, how) if kept else getattr(model, how)()


@lru_cache(maxsize=2)
def _load_kept(model, how: str):
    return getattr(model, how)()


def with_model(
    df: DataFrame, name: str, work: Batches, kind: str, *inputs: Column | str, profile: ResourceProfile | None = None
) -> DataFrame:
    """``df`` with the column ``name`` of type ``kind``: what ``work`` makes of ``inputs``, batch by batch.

    Without a ``profile`` only the inputs cross to Python. With one, whole rows do, in Arrow batches whose other columns are handed
    through as they are, and the stage that does so asks for the profile's resources. ``df`` should then begin with a shuffle, or its
    scan is part of that stage.
    """
    ship_package(df.sparkSession)
    if profile is None:
        return df.withColumn(name, _as_column(work, kind, *inputs))
    fed = [f"{name}_{k}" for k in range(len(inputs))]
    columns = [F.col(given) if isinstance(given, str) else given for given in inputs]
    ready = df.withColumns(dict(zip(fed, columns)))
    added = T.StructType.fromDDL(f"{name} {kind}")
    schema, type_ = T.StructType([*df.schema.fields, *added.fields]), to_arrow_type(added.fields[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def series() -> Iterator[tuple[pd.Series, ...]]:
            for batch in batches:
                waiting.append(batch)
                yield tuple(batch.column(at).to_pandas() for at in map(batch.schema.get_field_index, fed))

        for frame in work(series()):
            batch = waiting.popleft()
            made = pa.array(frame.to_dict("records"), type_)
            kept = [batch.column(at) for at in range(batch.num_columns - len(fed))]
            yield pa.RecordBatch.from_arrays([*kept, made], names=[*batch.schema.names[: len(kept)], name])

    return ready.mapInArrow(run, schema, profile=profile)


def _as_column(work: Batches, kind: str, *inputs: Column | str) -> Column:
    if kind == TEXT and len(inputs) == 1:
        type_ = to_arrow_type(T.StructType.fromDDL(f"made {kind}")[0].dataType)

        @F.arrow_udf(kind)
        def run_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for frame in work((part.to_pandas(),) for batch in batches for part in _slices(batch)):
                yield pa.StructArray.from_arrays([pa.array(frame[f.name], f.type) for f in type_], fields=list(type_))

        return run_texts.asNondeterministic()(*inputs)

    if len(inputs) == 1:

        @F.pandas_udf(kind)
        def run_one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from work((batch,) for batch in batches)

        return run_one.asNondeterministic()(*inputs)

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        yield from work(batches)

    return run.asNondeterministic()(*inputs)


def texts_of(model: TextModel) -> Batches:
    """Answers to one column of prompts. A prompt that fails sets ``error`` for its own row only; a null one gives nulls."""

    def work(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        answer = loaded(model)
        for (prompts,) in batches:
            out = pd.DataFrame({"text": None, "error": None}, index=prompts.index, dtype=object)
            asked = prompts[prompts.notna()]
            if len(asked):
                texts, errors = _answers(answer, list(asked))
                out.loc[asked.index, "text"] = pd.Series(texts, index=asked.index, dtype=object)
                out.loc[asked.index, "error"] = pd.Series(errors, index=asked.index, dtype=object)
            yield out

    return work


def generate(model: TextModel, prompt: Column | str) -> Column:
    """``TEXT``: the model's answer to a prompt."""
    _ship()
    return _as_column(texts_of(model), TEXT, prompt)


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    """The rows of an Arrow batch, so many at a time as have about ``SLICE_BYTES``, but no fewer than a model is handed. Spark bounds a
    batch; its texts as Python objects, the lists made of them and the answers would take several times as much."""
    calls = SLICE_BYTES * len(batch) // (PROMPTS_PER_CALL * max(1, batch.nbytes))
    rows = PROMPTS_PER_CALL * max(1, calls)
    for first in range(0, len(batch), rows):
        yield batch.slice(first, rows)


def with_answers(df: DataFrame, model: TextModel, prompts: str, texts: str, error: str) -> DataFrame:
    """Replace the array column ``prompts`` by the columns ``texts``, one per prompt, and ``error``, that of the first
    prompt in the row that fails. Null arrays give nulls. Only the prompts cross to Python."""
    ship_package(df.sparkSession)
    text_lists = pa.list_(pa.string())

    @F.arrow_udf("struct<texts: array<string>, error: string>")
    def answer_rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        answer = loaded(model)
        for batch in batches:
            for part in _slices(batch):
                lists = part.to_pylist()
                owner = [row for row, one in enumerate(lists) if one is not None for _ in one]
                answers, errors = _answers(answer, [prompt for one in lists if one is not None for prompt in one])
                by_row: list = [None if one is None else [] for one in lists]
                first_error: list = [None] * len(lists)
                for row, text, problem in zip(owner, answers, errors, strict=True):
                    by_row[row].append(text)
                    first_error[row] = first_error[row] or problem
                made = [pa.array(by_row, text_lists), pa.array(first_error, pa.string())]
                yield pa.StructArray.from_arrays(made, names=["texts", "error"])

    kept = [F.col(f"`{name}`") for name in df.columns if name != prompts]
    answered = df.select(*kept, answer_rows.asNondeterministic()(F.col(prompts)).alias("answered"))
    return answered.select(*kept, F.col("answered.texts").alias(texts), F.col("answered.error").alias(error))


def _answers(
    answer: Callable[[Sequence[str]], Sequence[str]], prompts: list[str]
) -> tuple[list[str | None], list[str | None]]:
    texts, errors = [], []
    for first in range(0, len(prompts), PROMPTS_PER_CALL):
        some_texts, some_errors = _isolated(answer, prompts[first : first + PROMPTS_PER_CALL])
        texts += some_texts
        errors += some_errors
    return texts, errors


def _isolated(
    answer: Callable[[Sequence[str]], Sequence[str]], prompts: list[str]
) -> tuple[list[str | None], list[str | None]]:
    """Answers and errors. A failed batch is asked again in halves until the failing prompts stand alone."""
    try:
        return _checked(answer(prompts), len(prompts)), [None] * len(prompts)
    except Exception as problem:  # noqa: BLE001 - a model may raise anything, and it belongs to the row
        if len(prompts) == 1:
            return [None], [str(problem)]
    middle = len(prompts) // 2
    left, right = _isolated(answer, prompts[:middle]), _isolated(answer, prompts[middle:])
    return left[0] + right[0], left[1] + right[1]


def _checked(answers: Sequence[str] | str, asked: int) -> list[str]:
    """As many texts as prompts. A lone text answers a lone prompt."""
    if isinstance(answers, str):
        answers = [answers]
    answers = list(answers)
    if len(answers) != asked:
        raise ValueError(f"the model gave {len(answers)} answers to {asked} prompts")
    return answers


def vectors_of(encoder: Encoder) -> Batches:
    """Vectors of one column of texts. A text that fails sets ``error`` for its own row only; a null one gives nulls."""

    def work(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        vectors = loaded(encoder)
        for (texts,) in batches:
            out = pd.DataFrame({"vector": None, "error": None}, index=texts.index, dtype=object)
            given = texts[texts.notna()]
            if len(given):
                found, errors = _isolated(vectors, list(given))
                out["vector"] = pd.Series(found, index=given.index, dtype=object).reindex(texts.index)
                out["error"] = pd.Series(errors, index=given.index, dtype=object).reindex(texts.index)
            yield out

    return work


def encode(encoder: Encoder, text: Column | str) -> Column:
    """``VECTOR``: the encoder's vector of a text."""
    _ship()
    return _as_column(vectors_of(encoder), VECTOR, text)


def labels_of(classifier: ZeroShotClassifier | PairClassifier) -> Batches:
    """Labels, best first, of a column of texts and one of ``array<struct<topic, description>>``.

    Rows without candidates are not shown to the model and get null labels. A classifier that scores pairs is asked for the pairs
    of ``PROMPTS_PER_CALL`` rows at once, and a failed call is asked again in halves until the failing row stands alone.
    """

    def work(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        in_pairs = hasattr(classifier, "load_pairs")
        score = loaded(classifier, "load_pairs" if in_pairs else "load")
        for texts, lists in batches:
            if in_pairs:
                rows = _paired_labels(score, list(texts), list(lists))
            else:
                rows = [_labels(score, one, several) for one, several in zip(texts, lists)]
            yield pd.DataFrame(rows, columns=["labels", "error"], index=texts.index, dtype=object)

    return work


def classify(classifier: ZeroShotClassifier | PairClassifier, text: Column | str, candidates: Column | str) -> Column:
    """``LABELS``: the classifier's order of the candidates of a text."""
    _ship()
    return _as_column(labels_of(classifier), LABELS, text, candidates)


def _is_asked(text: str | None, candidates: Sequence[dict] | None) -> bool:
    return text is not None and candidates is not None and len(candidates) > 0


def _labels(score: Callable, text: str | None, candidates: Sequence[dict] | None) -> tuple[list | None, str | None]:
    if not _is_asked(text, candidates):
        return None, None
    try:
        ranked = score(text, [(c["topic"], c["description"]) for c in candidates])
        return [{"label": label, "score": float(value)} for label, value in ranked], None
    except Exception as problem:  # noqa: BLE001 - as above
        return None, str(problem)


def _paired_labels(score: Callable, texts: list, lists: list) -> list[tuple[list | None, str | None]]:
    rows: list[tuple[list | None, str | None]] = [(None, None)] * len(texts)
    asked = [row for row, (text, candidates) in enumerate(zip(texts, lists)) if _is_asked(text, candidates)]

    def scored(some: Sequence[int]) -> list[np.ndarray]:
        """Scores of the candidates of each row, from one call over all their pairs."""
        sizes = [len(lists[row]) for row in some]
        pairs = [(texts[row], c["topic"], c["description"]) for row in some for c in lists[row]]
        values = np.asarray(score(pairs), dtype=np.float64)
        if values.shape != (len(pairs),):
            raise ValueError(f"the classifier gave scores of shape {values.shape} to {len(pairs)} pairs")
        return np.split(values, np.cumsum(sizes)[:-1])

    for first in range(0, len(asked), PROMPTS_PER_CALL):
        some = asked[first : first + PROMPTS_PER_CALL]
        for row, values, problem in zip(some, *_isolated(scored, some), strict=True):
            rows[row] = (None, problem) if problem is not None else (_best_first(values, lists[row]), None)
    return rows


def _best_first(values: np.ndarray, candidates: Sequence[dict]) -> list[dict]:
    """Labels by falling score, equal ones in the order given; scores of a row are made to sum to 1."""
    total = values.sum()
    shares = values / total if total else np.full(len(values), 1 / len(values))
    return [{"label": candidates[k]["topic"], "score": float(shares[k])} for k in np.argsort(-values, kind="stable")]


def predict(df: DataFrame, model: FrameModel, name: str = "prediction", profile: ResourceProfile | None = None) -> DataFrame:
    """``df`` with the struct ``name``: the model's ``outputs``, and ``error``. Every row is scored, from the columns that the model's
    ``inputs`` name. A batch that fails is asked again in halves; a row that fails alone gets its error and nulls."""
    outputs = T.StructType.fromDDL(model.outputs)
    kind = f"struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in outputs)}, error: string>"
    return with_model(df, name, _rows_of(model, outputs.names), kind, *model.inputs, profile=profile)


def _rows_of(model: FrameModel, outputs: list[str]) -> Batches:
    inputs = list(model.inputs)

    def work(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        answer = loaded(model)
        for columns in batches:
            frame = pd.DataFrame(dict(zip(inputs, columns)))

            def rows(places: Sequence[int]) -> list[tuple]:
                found = answer(frame.iloc[list(places)].reset_index(drop=True))
                return list(found[outputs].astype(object).itertuples(index=False, name=None))

            scored: list[tuple] = []
            for first in range(0, len(frame), PROMPTS_PER_CALL):
                some = list(range(first, min(first + PROMPTS_PER_CALL, len(frame))))
                for row, problem in zip(*_isolated(rows, some), strict=True):
                    values = row if problem is None else (None,) * len(outputs)
                    scored.append((*(None if _is_missing(v) else v for v in values), problem))
            yield pd.DataFrame(scored, columns=[*outputs, "error"], index=frame.index, dtype=object)

    return work


def _is_missing(value) -> bool:
    return value is None or value is pd.NA or isinstance(value, float) and value != value
