"""URL filters, chat formatting, vectors, the registered queries and the pipeline."""

import collections
import hashlib
import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from callweave.llm import additive, chat, line_dedup, mixing, pieces, quality, runs, url_rules, vectors
from callweave.llm.oracles import ORACLES
from check import normalise

SF_DIR = "/root/testdata/sf0.001"


# --- 2: urls ---------------------------------------------------------------------------------------------------

URLS = [
    ("http://com/x", "com/", "allow"), ("http://a.com/", "com/", "allow"), ("http://a.com", None, "allow"), ("http://xcom/", None, "allow"),
    ("https://WWW.Example.com/en/1", "www.example.com/en/", "allow"), ("https://m.example.com/en/", "example.com/en/", "block"),
    ("https://example.com/en", "com/", "allow"), ("http://q.net/fr/a?b#c", "net/fr/", "block"), ("http://q.net/FR/", None, "allow"),
    ("ftp://net/es/", "net/es/", "block"), ("http://a.com:80/", None, "allow"), ("http://x.org/?u=http://a.com/", None, "allow"),
    (None, None, "allow"), ("", None, "allow"), ("no scheme a.com/", None, "allow"), ("http:///en/", None, "allow"), ("://a.com/", "com/", "allow"),
    ("http://play.Casino.example.org/", None, "block"), ("http://a.org/casinos", None, "allow"), ("http://a.org/wp-admin/x", None, "block"),
    ("http://a.org/p?sid=0123456789abcdef0", None, "block"), ("http://a.org/calendar/2020/1", None, "block"), ("http://É.com/\nx", "com/", "allow"),
]


def test_url_rules(spark):
    rows = [(i, u, "mine", "mine") for i, (u, _, _) in enumerate(URLS)] * 2 + [(None, "http://a.com/", "x", "y")]
    got = url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert (r.rule, r.verdict) == URLS[r.page_id][1:], r
    hosts = {r.page_id: (r.host, r.path) for r in got}
    assert hosts[4] == ("www.example.com", "/en/1") and hosts[7] == ("q.net", "/fr/a") and hosts[12] == hosts[14] == ("", "")
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_index_finds_what_trying_every_rule_finds(spark, rng):
    parts = ["com", "net", "example", "en", "es", "www", "casino", "login", "a"]
    urls = [f"http://{'.'.join(rng.choices(parts, k=rng.randint(1, 4)))}/{'/'.join(rng.choices(parts, k=rng.randint(0, 3)))}" for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    loose = tuple(url_rules.Rule(r.name, r.regex, (), r.action, r.host_rule) for r in url_rules.HOST_RULES + url_rules.PATTERN_RULES)
    columns = ["page_id", "host", "path", "rule", "verdict", "reason"]
    assert sorted(url_rules.judge_urls(table).select(columns).collect(), key=repr) == sorted(url_rules.judge_urls(table, loose).select(columns).collect(), key=repr)


def test_rarest_token_indexes_a_rule(spark):
    urls = spark.createDataFrame([(["com", "example"],), (["com"],), (["com", "en"],)], "tokens array<string>")
    everywhere, index = url_rules.build_index(urls, (url_rules.host_rule("example.com/en/", "block"), url_rules.Rule("r", "x", (), "block")))
    assert list(index) == ["en"] and [r.name for r in everywhere] == ["r"]


def test_a_token_is_told_by_ascii_letters_only(spark):
    urls = spark.createDataFrame([(0, "http://a.org/\u212Acasino"), (1, "http://a.org/p?SID=0123456789abcdef0"), (2, "http://\u0130.com/")], "page_id long, url string")
    found = {r.page_id: (r.verdict, r.reason) for r in url_rules.judge_urls(urls).collect()}
    assert found == {0: ("block", "word:casino"), 1: ("block", "session id"), 2: ("allow", None)}


def test_a_table_of_rules_judges_as_trying_every_rule_does(spark, rng):
    words = [f"{a}{b}" for a in "abcdefghij" for b in range(500)]
    names = {f"{w}.{x}/{p}" for w in words for x in ("com", "net") for p in ("", "en/", "en/x", "a/", "b/")}
    hosts = [url_rules.host_rule(name, rng.choice([url_rules.ALLOW, url_rules.BLOCK])) for name in sorted(names)]
    rules = (*hosts, *url_rules.path_rule(*[f"w{k}" for k in range(200)]), *url_rules.HOST_RULES, *url_rules.PATTERN_RULES)
    assert len(rules) > 50_000
    table = spark.createDataFrame([(r.name, r.regex, list(r.tokens), r.action, r.host_rule) for r in rules], url_rules.RULES_TABLE)
    urls = [
        f"http://{rng.choice(['', 'www.', 'q.'])}{rng.choice(words)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['', 'en/', 'en/xy', 'a/b', 'w17/', 'w9?w8'])}"
        for _ in range(300)
    ]
    urls += urls[:20] + [None, "", "no scheme", "http://com/"]
    pages = spark.createDataFrame([(k, u, "mine", "x") for k, u in enumerate(urls)], "page_id long, url string, _best string, rule string")
    got = {r.page_id: r for r in url_rules.judge_urls_by_table(pages, table).collect()}
    assert len(got) == len(urls) and {r._best for r in got.values()} == {"mine"}
    by_host = {r.name: r for r in hosts} | {r.name: r for r in url_rules.HOST_RULES}
    few = {r.page_id: r for r in url_rules.judge_urls(pages, (*url_rules.path_rule(*[f"w{k}" for k in range(200)]), *url_rules.PATTERN_RULES)).collect()}
    for k, r in got.items():
        labels = r.host.split(".") if r.host else []
        fits = [f"{'.'.join(labels[i:])}/{r.path[1 : 1 + n]}" for i in range(len(labels)) for n in range(len(r.path)) if r.path[:1] == "/"]
        fits = [name for name in fits if name in by_host]
        best = min(fits, key=lambda name: (-len(name), name), default=None)
        assert r.rule == best and r.verdict == (by_host[best].action if best else few[k].verdict) and r.reason == (None if best else few[k].reason)
    with pytest.raises(Exception, match="without a token"):
        url_rules.judge_urls_by_table(pages, table.limit(1).withColumn("tokens", F.array().cast("array<string>"))).collect()


# --- 4: chat ---------------------------------------------------------------------------------------------------


def fold(log):
    """Final messages by conversation, the plain way."""
    order = lambda r: tuple((x is not None, x) for x in (r[0], r[1], r[2])) + (r[3] != "start",) + tuple((x is not None, x) for x in r[3:])
    out = collections.defaultdict(list)
    for conv, msg, _, op, role, text in sorted(log, key=order):
        held = out[conv]
        if op == "start" or not held or held[-1][0] != msg:
            if op not in ("start", "delta", "edit", "regenerate"):
                continue
            held.append([msg, role or "", ""])
        if op in ("edit", "regenerate"):
            held[-1][2] = ""
        if op in ("start", "delta", "edit"):
            held[-1][2] += text or ""
    return {conv: [(role, text) for _, role, text in held] for conv, held in out.items() if held}


def test_events_are_folded(spark, rng):
    texts = ["", None, "a\\b", "<|im_end|>", "<\\|", "two\nlines", "é😀", "\\"]
    log = []
    for conv in [None, 1, 2, 3]:
        for msg in range(6):
            log.append((conv, msg, 0, "start", rng.choice(["user", "assistant", "r\n\\x<|", None]), rng.choice(texts)))
            for seq in range(1, rng.randint(1, 6)):
                log.append((conv, msg, seq, rng.choice(["delta", "delta", "edit", "regenerate", "noise"]), None, rng.choice(texts)))
    log += [(9, 0, 5, "delta", "assistant", "late"), (9, 0, 6, "delta", None, "r"), (1, 0, 0, "start", "user", "tie"), (10, 0, 0, "noise", None, "x")]
    table = spark.createDataFrame(rng.sample(log, len(log)), chat.LOG).withColumn("part", F.lit("clash")).repartition(5)
    parts = chat.format_conversations(table)
    want = fold(log)
    found = collections.defaultdict(list)
    for r in sorted(parts.collect(), key=lambda r: (str(r.conv_id), r.part)):
        found[r.conv_id].append(chat.parse(r.formatted))
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 1
        if r.loss_start is not None:
            assert chat.unescape(r.formatted[r.loss_start : r.loss_end]) == found[r.conv_id][-1][1] and found[r.conv_id][-1][0] == "assistant"
    assert dict(found) == want
    digests = {r.conv_id: r for r in chat.read_back(parts).collect()}
    for conv, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        r = digests[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_conversations(spark.createDataFrame([], chat.LOG)).count() == 0


def test_streams_and_regenerations(spark):
    log = [(1, 0, 0, "start", "user", "Hi"), (1, 1, 0, "start", "assistant", ""), (1, 1, 1, "delta", None, "Bad "), (1, 1, 2, "delta", None, "answer"),
           (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "Good"), (1, 0, 9, "edit", None, "Hello"), (1, 2, 0, "start", "user", "Thanks")]
    parts = sorted(chat.format_conversations(spark.createDataFrame(log, chat.LOG)).collect(), key=lambda r: r.part)
    assert "".join(p.formatted for p in parts) == (
        "<|im_start|>user\nHello<|im_end|>\n<|im_start|>assistant\nGood<|im_end|>\n<|im_start|>user\nThanks<|im_end|>\n"
    )


def test_large_ids_beside_a_null_stay_apart(spark):
    big = 2**53
    log = [(c, m, 0, "start", "user", f"{c}/{m}") for c in (None, big, big + 1, big + 2, big + 3, -big - 1) for m in (None, big, big + 1)]
    log += [(big, big + 1, 1, "delta", None, "!"), (None, None, 1, "delta", None, "?")]
    table = spark.createDataFrame(log, chat.LOG).coalesce(1)
    parts = chat.format_conversations(table)
    found = collections.defaultdict(list)
    for r in sorted(parts.collect(), key=lambda r: (str(r.conv_id), r.part)):
        found[r.conv_id].append(chat.parse(r.formatted))
    assert dict(found) == fold(log) and len(found) == 6
    assert {r.conv_id: r.n_turns for r in chat.read_back(parts).collect()} == dict.fromkeys(found, 3)


def test_a_streamed_log_folds_to_the_turns_it_is_made_of(spark, rng):
    texts = ["", None, "<|im_end|>", "é😀" * 100, "x" * 1000, "two\nlines"]
    turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in (*range(30), None, 2**53 + 1) for t in (0, 1, 2, None)]
    shared = [(3, 1, "user", "again"), (3, 1, "user", "again"), (None, None, "assistant", "x" * 500)]
    for rows in (turns, turns + shared):
        table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        log = chat.turns_as_streamed(table, piece=40)
        assert {r.op for r in log.select("op").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
        streamed, whole = (chat.read_back(chat.format_conversations(x)) for x in (log, chat.turns_as_log(table)))
        assert sorted(map(str, streamed.collect())) == sorted(map(str, whole.collect()))
    assert chat.turns_as_streamed(table.limit(0)).count() == 0


# --- 6: vectors ------------------------------------------------------------------------------------------------


def plain_vectors(rows):
    unit = [np.array(v, float) / np.linalg.norm(v) if v and None not in v and np.isfinite(v).all() and np.any(v) else None for _, v, _ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][2] is not None and rows[a][2] == rows[b][2] and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]):
            if unit[a] @ unit[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, links[k], least.get(find(k))) for k, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(5)
    rows = []
    for base in range(25):
        v = r.normal(size=24)
        for copy in range([1, 2, 9, 30][base % 4]):
            rows.append((len(rows), [float(np.float32(x)) for x in v + r.normal(size=24) * 0.02 * copy / 9], int(base % 3)))
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 24, 1), (503, [None] + [1.0] * 23, 1), (504, [float("nan")] * 24, 1), (505, [float("inf")] * 24, 0)]
    rows += [(506, rows[0][1], None), (None, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (507, [1.0, 2.0], 0), (508, [2.0, 4.0], 0)]
    rows += [(509, [1e-30, 2e-30], 0), (510, [1e30, 2e30], 0)]
    table = spark.createDataFrame([(i, v, n, 1, "x") for i, v, n in rows], "vec_id long, embedding array<float>, label int, row int, block string")
    got = vectors.near_vectors(table.repartition(4)).collect()
    assert sorted(((x.vec_id, x.n_links, x.component_id) for x in got), key=repr) == sorted(plain_vectors(rows), key=repr)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert vectors.near_vectors(table.where("vec_id < 0")).count() == 0


def test_pivots_recall_what_brute_force_finds(spark):
    """Recall on the given table: links found of all links."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = table.toPandas().sort_values("vec_id")
    unit = np.stack(x.embedding).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & (x.label.to_numpy()[:, None] == x.label.to_numpy()[None])
    found = vectors.near_vectors(table).agg(F.sum("n_links")).first()[0]
    assert 0.9 * (links.sum() - len(x)) <= found <= links.sum() - len(x)


@pytest.mark.parametrize("cosine", [0.942, 0.978, 0.9999])
def test_pivots_recall_one_large_noisy_cluster(spark, cosine):
    """Recall where a third of all rows lie close together."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    r = np.random.default_rng(3)
    centre = r.normal(size=64)
    near = centre / np.linalg.norm(centre) + r.normal(size=(1000, 64)) * np.sqrt((1 / cosine - 1) / 64)
    rows = [(int(i), [float(v) for v in e], int(n)) for i, e, n in zip(table.vec_id, table.embedding, table.label)]
    rows += [(10**6 + k, [float(np.float32(v)) for v in e], 0) for k, e in enumerate(near)]
    unit = np.stack([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([n for *_, n in rows])
    links = ((unit @ unit.T >= 0.93) & (labels[:, None] == labels[None])).sum() - len(rows)
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).agg(F.sum("n_links")).first()[0]
    print(f"recall at {cosine}: {found / links:.3f} of {links // 2}")
    assert 0.9 * links <= found <= links


def with_common_part(r, n, mean_cosine, partners, cosines=(0.931, 0.94)):
    """Unit vectors whose mean cosine is given, and partners of some of them at cosines just above the threshold."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    common = unit(r.normal(size=(1, 64)))
    x = unit(np.sqrt(mean_cosine) * common + np.sqrt(1 - mean_cosine) * unit(r.normal(size=(n, 64))))
    away = r.normal(size=(partners, 64))
    away = unit(away - (away * x[:partners]).sum(axis=1, keepdims=True) * x[:partners])
    at = r.uniform(*cosines, size=(partners, 1))
    return np.concatenate([x, at * x[:partners] + np.sqrt(1 - at * at) * away]).astype(np.float32)


@pytest.mark.parametrize("mean_cosine", [0.0, 0.4, 0.6, 0.8])
def test_recall_does_not_depend_on_what_all_vectors_have_in_common(spark, mean_cosine):
    x = with_common_part(np.random.default_rng(8), 4000, mean_cosine, 1000)
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum() - len(x)
    found = vectors.near_vectors(table).agg(F.sum("n_links")).first()[0]
    print(f"recall at mean cosine {mean_cosine}: {found / links:.4f} of {links // 2}")
    assert 0.95 * links <= found <= links and links >= 2000


def test_pivots_grow_with_the_rows_and_their_number_is_bounded():
    x = with_common_part(np.random.default_rng(9), 6000, 0.4, 0).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = [vectors.index_of(x, wanted, 0.93) for wanted in (48, 300, 2048)]
    assert [len(i.pivots) for i in sizes] == [48, 300, 2048] and all(i.nearest <= vectors.MOST_NEAREST for i in sizes)
    assert all(vectors.recall_on(x, i, 0.93) >= vectors.RECALL for i in sizes)


def test_pairs_that_rounding_leaves_open_are_settled_by_the_vectors_as_given(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEVELS", 7)  # the driver's: the comparison below runs here
    r = np.random.default_rng(10)
    x = np.concatenate([with_common_part(r, 40, 0.2, 40, (0.9, 0.96)), r.normal(size=(5, 64)).astype(np.float32)])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / vectors.LEVELS
    rounded = np.rint(unit / scale[:, None]) * scale[:, None]
    slack = np.linalg.norm(unit - rounded, axis=1)
    counts, _, (i, j) = vectors._links(rounded, slack, np.zeros((len(x), 1), np.int16), 0, None, 0.93)
    links = np.triu(unit @ unit.T >= 0.93, 1)
    sure = links.copy()
    sure[i, j] = False
    assert len(i) and (counts == sure.sum(axis=0) + sure.sum(axis=1)).all()
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row long, embedding array<float>")
    unsure = spark.createDataFrame([(int(a), int(b)) for a, b in zip(i, j)], "row long, root long")
    settled = {(r.row, r.root) for r in vectors._settled(unsure, rows, 0.93).collect()}
    assert settled == {(int(a), int(b)) for a, b in zip(i, j) if links[a, b]} | {(int(b), int(a)) for a, b in zip(i, j) if links[a, b]}


def test_groups_of_a_long_list_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "PART", 200)

    def bounded(compare, most):
        def check(group):
            if len(group) > most:
                raise ValueError(f"a group of {len(group)} entries")
            return compare(group)

        return check

    plain = vectors._comparer
    monkeypatch.setattr(vectors, "_comparer", lambda *given: bounded(plain(*given), 600))
    r = np.random.default_rng(5)
    centre = r.normal(size=16)
    rows = [(k, [float(x) for x in (centre + r.normal(size=16) * 0.01 if k < 150 else r.normal(size=16))], 0) for k in range(300)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(x.n_links == 149 and x.component_id == 0 for x in got if x.vec_id < 150)


# --- queries and pipeline --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    got, want = entry_point.queries()[name](spark, SF_DIR).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normalise(got) == normalise(want)


def test_each_operator_has_a_query():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry_point.queries()


def test_pipeline(spark, docs_of):
    base = "\n".join(f"this is line {k} of a text that everybody copies around the world" for k in range(4))
    rows = [(1, base, "a"), (2, base + "\nown ending of the second text here", "a"), (3, "lovely short text about rivers and morning light", "b")]
    rows += [(4, rows[2][1], "c"), (4, rows[2][1], "c"), (5, None, "a"), (6, "", "b"), (None, "a text without an id but with enough words", "b")]
    docs = docs_of(rows)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:4]:
        docs = spark.createDataFrame(stages[name](spark, docs, SF_DIR).collect(), docs.schema)
        assert docs.columns == columns
        if name == "line dedup":
            assert {r.text for r in docs.where("doc_id = 2").collect()} == {"own ending of the second text here"}
            assert docs.count() == len(rows)
        if name == "MinHash near-dedup":
            assert sorted((r.doc_id for r in docs.collect()), key=repr) == sorted([1, 2, 3, 5, 6, None], key=repr)
    coded = stages["SentencePiece encoding and decoding"](spark, docs, SF_DIR)
    assert coded.where("round_trip = false").count() == 0 and coded.count() == docs.count()
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


# --- names that operators use inside ----------------------------------------------------------------------------


@pytest.mark.parametrize("operator", ["urls", "urls_by_table", "lines", "quality", "pieces", "runs", "additive"])
def test_columns_of_any_name_are_carried_along(spark, operator):
    inner = ["_best", "_subject", "_mark", "_all", "_left", "_spans", "_l", "_w", "_words", "_windows", "_placed", "_held", "_places", "_e", "_row", "found", "scored", "block"]
    rows = [(k, t, t, *[f"{k}{n}" for n in inner]) for k, t in enumerate(["a b c\nd e f\ng h i", "http://com/x", None, "", "a b c\nd e f\ng h i"])]
    table = spark.createDataFrame(rows, "doc_id long, text string, url string, " + ", ".join(f"{n} string" for n in inner))
    rules = spark.createDataFrame([(r.name, r.regex, list(r.tokens), r.action, r.host_rule) for r in url_rules.HOST_RULES], url_rules.RULES_TABLE)
    empty_model = additive.AdditiveModel(((),) * 19, ((0.0,),) * 19, (), ((),) * 19, (), 0.0)
    out = {
        "urls": lambda: url_rules.judge_urls(table),
        "urls_by_table": lambda: url_rules.judge_urls_by_table(table, rules),
        "lines": lambda: line_dedup.remove_repeated_lines(table),
        "quality": lambda: quality.judge_quality(table),
        "pieces": lambda: pieces.encode_texts(table, chunk=4),
        "runs": lambda: runs.collapse_runs(table),
        "additive": lambda: additive.score_quality(table, empty_model),
    }[operator]()
    kept = out.select("doc_id", *inner).distinct().collect()
    assert sorted(map(tuple, kept)) == [(r[0], *r[3:]) for r in rows]


def test_estimates_that_do_not_settle_raise(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(40 + 9 * k)) + " # !!" * k for k in range(30)]
    docs = spark.createDataFrame([(k, t, "s", "x") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    monkeypatch.setattr(quality, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="did not settle"):
        quality.judge_quality(docs)
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.mix_sources(docs.withColumn("source", F.col("doc_id") % 3))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_the_pipeline_take_empty_tables(spark, tmp_path, name, stage):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, spark.createDataFrame([], columns), str(tmp_path))
    assert out.count() == 0 and (name.startswith("Sentence") or out.columns == [c.split()[0] for c in columns.split(", ")])
