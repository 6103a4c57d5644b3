"""Column functions on small texts."""

import ast
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.constants import ACTIONS_PROMPT_HEAD, PROMPT_TAIL, SUMMARY_PROMPT_HEAD
from callweave.functions import text as tx
from callweave.functions.prompts import actions_prompt, summary_prompt
from callweave.functions.splitting import boundary_chunks, split_text
from callweave.functions.values import topic_list
from callweave.functions.vectors import cosine
from callweave.operators.calls import combine_chunks, is_long_enough, split_chunks, split_sentences, with_token_count
from callweave.scorers.builtin import extract_text


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "conv_id bigint, transcription string")


def ask(spark, column, *values):
    return [r[0] for r in texts(spark, *values).orderBy("conv_id").select(column(F.col("transcription"))).collect()]


def test_tokens_are_words_and_marks(spark):
    assert ask(spark, tx.token_count, "", "one", "Hi, you!", "a_b c-d", "née Müller", "x" * 9) == [0, 1, 4, 4, 2, 1]


def test_word_count_follows_python_split(spark):
    samples = ["", "  ", "a b", " a\tb\nc ", "a b c", "a\x1cb\x85c", "don't stop"]
    assert ask(spark, tx.word_count, *samples) == [len(s.split()) for s in samples]
    for n in (1, 2, 5):
        assert ask(spark, lambda c, n=n: tx.has_words(c, n), *samples) == [len(s.split()) >= n for s in samples]


def test_gate_between_15_and_16_tokens(spark):
    calls = with_token_count(texts(spark, "w " * 15, "w " * 16))
    kept = calls.orderBy("conv_id").select(is_long_enough(F.col("word_count"))).collect()
    assert [r[0] for r in kept] == [False, True]


@pytest.mark.parametrize("length,count", [(0, 1), (1, 1), (4096, 1), (4097, 2), (8142, 2), (8143, 3), (50, 1), (4046, 1)])
def test_chunk_count(spark, length, count):
    assert split_chunks(texts(spark, "x" * length)).count() == count


def test_chunks_overlap_and_rebuild_the_text(spark):
    text = "".join(chr(0x61 + i % 26) + ("é" if i % 7 == 0 else "") + ("\U0001f600" if i % 501 == 0 else "") for i in range(9000))
    parts = [r.chunk for r in split_chunks(texts(spark, text)).orderBy("chunk_no").collect()]
    assert all(a[-50:] == b[:50] for a, b in zip(parts, parts[1:]))
    assert all(len(p) == 4096 for p in parts[:-1])
    assert parts[0] + "".join(p[50:] for p in parts[1:]) == text


def test_boundary_chunks_prefer_coarse_separators():
    split = lambda text, size=10, overlap=4: list(split_text(text, size, overlap))
    assert split("") == [] and split("short") == ["short"]
    assert split("aaaa\n\nbbbb cc\n\ndd") == ["aaaa", "bbbb cc", "dd"]  # "\n\n" + "bbbb cc" + "\n\ndd" is over 10
    assert split("one two three four") == ["one two", "two three", "four"]
    assert split("x" * 23) == ["x" * 10, "x" * 10, "x" * 10, "x" * 5]
    assert split("a b\n" + "y" * 12 + "\nz") == ["a b", "y" * 9, "y" * 7, "z"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="xx \n", max_size=120), st.integers(5, 30))
def test_boundary_chunks_are_bounded_and_complete(shape, size):
    # every letter is different, so each chunk has one place in the text
    text = "".join(chr(0x4E00 + i) if c == "x" else c for i, c in enumerate(shape))
    chunks = list(split_text(text, size, 4))
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    places = [text.index(c) for c in chunks]
    ends = [a + len(c) for a, c in zip(places, chunks)]
    # neither starts nor ends go backwards; a chunk may repeat the start of the one before it, as this packing does
    assert places == sorted(places) and ends == sorted(ends)
    assert all(a + len(c) - b <= 4 for a, c, b in zip(places, chunks, places[1:]))
    assert set("".join(chunks)) >= set("".join(text.split()))


def test_boundary_chunk_column(spark):
    text = "word " * 2000 + "\n\n" + "tail"
    got = ask(spark, boundary_chunks, text, "", None)
    assert got == [list(split_text(text, 4096, 50)), [], None]
    assert len(got[0]) == 4 and got[0][-1] == "tail"  # the long paragraph is packed by itself


def test_cosine_column(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.96, None]


def test_tokens_of_parts_add_up(spark):
    assert ask(spark, lambda c: tx.has_tokens(c, 3), "a b", "a b!", " é-é", "ab") == [False, True, True, False]
    assert ask(spark, lambda c: tx.token_straddles(c, 2), "abc", "ab c", "ab", "a-c", "xéü") == [True, False, False, False, True]


def test_chunk_results_join_in_order(spark):
    parts = spark.createDataFrame([(1, n, f"s{n}") for n in (10, 2, 0, 1)], "conv_id int, chunk_no int, summary string")
    assert combine_chunks(parts).first().summary == "s0\ns1\ns2\ns10"


def test_sentences_keep_five_words_and_count_only_kept_ones(spark):
    text = "one two three four. one two three four five.. . \n a b  c d e f.x"
    rows = split_sentences(texts(spark, text, "", "...")).orderBy("position").collect()
    assert [(r.position, r.sentence) for r in rows] == [(0, " one two three four five"), (1, " \n a b  c d e f")]


def test_squared_norm(spark):
    samples = ("", "a b c", "A a a b, b C")
    assert ask(spark, lambda c: tx.squared_norm(tx.term_counts(tx.terms(c))), *samples) == [0, 3, 9 + 4 + 1]
    counts = ask(spark, lambda c: tx.term_counts(tx.terms(c)), *samples)
    assert [[tuple(t) for t in row] for row in counts] == [[], [("a", 1), ("b", 1), ("c", 1)], [("a", 3), ("b", 2), ("c", 1)]]


def test_extract_equals_python_twin(spark):
    samples = [
        "",
        "no stop",
        "w " * 200 + ". short",
        ". ".join(["a b c"] * 80),
        "a . . . b. " * 60,
        "x" + " y" * 148 + ". z. tail",
        "x" + " y" * 147 + ". z. tail",
        " . lead.. \n two words . ",
        "\u2003wide\x85blank\x1cwords. Äpfel äpfel. b\u00a0c",
        "word " * 5000,
        " ".join(f"w{i}" for i in range(5000)),
    ]
    assert ask(spark, tx.extract, *samples) == [extract_text(s) for s in samples]
    assert all(len(extract_text(s).replace(".", " ").split()) < 150 for s in samples)
    assert all(extract_text(s) for s in samples if s)  # no text with a word gives nothing
    assert extract_text("one two. three four five six. " + "same " * 200) == "one two. three four five six."


def test_prompts_carry_any_text(spark):
    text = "100% {} {x} %s \"q\" 'r'\nline"
    assert ask(spark, summary_prompt, text) == [SUMMARY_PROMPT_HEAD + text + PROMPT_TAIL]
    assert ask(spark, actions_prompt, text) == [ACTIONS_PROMPT_HEAD + text + PROMPT_TAIL]


def test_topic_list(spark):
    assert ask(spark, topic_list, "['a','b']", '["a","b"]', "oops", "[]") == [["a", "b"], ["a", "b"], None, []]


def plain_list(text):
    """What Python reads, and JSON where it finds names that Python does not know."""
    try:
        value = ast.literal_eval(text)
    except ValueError:
        try:
            value = json.loads(text.replace("'", '"'))
        except json.JSONDecodeError:
            return None
    except SyntaxError:
        return None
    if not isinstance(value, (list, tuple)):
        return None
    as_written = {True: "true", False: "false"} if "true" in text or "false" in text else {}
    return [v if v is None or isinstance(v, str) else as_written.get(v, str(v)) if isinstance(v, bool) else str(v) for v in value]


def written_lists():
    rng = random.Random(11)
    names = ["a", "it's", 'say "so"', "Ünd", "", "tab\there", "back\\slash", "x, y", "[no]", "(", "None", "a\x07b", "\u20ac"]
    scalars = [*map(repr, names), '"q"', "'\\x41\\u00e9'", "1", "-2.5", "None", "True", "null", "true", "'a' 'b'", repr(["n", 1]), repr(("t",)), "[]"]
    yield from ["[", "]", "", " ", "[,]", "[1,,2]", "(1)", "((1),)", "('a')", "'a', 'b'", "x", "['a' 1]", "[1 2]", "['a]", "[[1]", "(]", "[)", "[1]]", "[] []", "{'a': 1}", "[a]", "['a'],"]
    for _ in range(400):
        items = [rng.choice(scalars) for _ in range(rng.randint(0, 4))]
        text = rng.choice([", ", ",", " ,\n "]).join(items)
        left, right = rng.choice(["[]", "[]", "()"])
        text = left + text + rng.choice(["", "", ",", " "]) + right
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", ",", "[", ")", "'", "7"]) + text[at + rng.randint(0, 1) :]
        yield text


def test_lists_are_read_as_python_reads_them(spark):
    # names of JSON among escapes or strings side by side are left to the lines below, and so are numbers that Python writes otherwise
    known = re.compile(r"null|true|(?<!\d)\.5|2\.[^5]|\(\['n', 1\]\)")
    texts = [t for t in written_lists() if not known.search(t)]
    got = ask(spark, topic_list, *texts)
    unlike = [(t, g, plain_list(t)) for t, g in zip(texts, got) if g != plain_list(t) and t not in ("'a', 'b'", "['a'],", "((1),)")]
    assert len(texts) > 200 and not unlike, unlike[:5]
    assert ask(spark, topic_list, None, "((1),)", "'a', 'b'", "['a'],", "(['n', 1])", "[.5, 2.]") == [None, ["(1)"], None, None, None, [".5", "2."]]
    assert ask(spark, topic_list, "[null, 'a', true]", "[None, null]", "[null,]", "(null,)") == [[None, "a", "true"], None, None, None]
