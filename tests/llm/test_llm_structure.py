"""Periodic runs and conversation repair against plain versions."""

import hashlib
import heapq
import zlib

import numpy as np
import pytest

from callweave.llm import queries, repair, runs

# --- periodic runs ---------------------------------------------------------------------------------------------


def plain_runs(words, least=runs.MIN_LENGTH):
    """Every period tried at every place."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            end = i + q
            smaller = any(all(words[x] == words[x + r] for x in range(start, end - r)) for r in range(1, q))
            if end - start >= max(least, 2 * q) and not smaller:
                found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {k for start, length, q in found for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_texts(rng, n):
    fib = ["a", "ab"]
    while len(fib[-1]) < 80:
        fib.append(fib[-1] + fib[-2])
    for _ in range(n):
        kind, size = rng.randrange(5), rng.randint(0, 60)
        letters = "abcd"[: rng.randint(1, 4)]
        piece = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        if kind == 0:
            yield [rng.choice(letters) for _ in range(size)]
        elif kind == 1:
            yield list(rng.choices(letters, k=3)) + piece * rng.randint(1, 5) + piece[: rng.randint(0, len(piece))]
        elif kind == 2:
            yield list(fib[-1][:size])
        elif kind == 3:
            yield ["a"] * size
        else:
            words = (piece * 2 + ["x"]) * rng.randint(1, 4)
            words[rng.randrange(len(words))] = rng.choice("ax")
            yield words


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_many_texts_in_one_dictionary(rng, least):
    for _ in range(60):
        texts = list(periodic_texts(rng, 6))
        bounds = np.cumsum([0, *map(len, texts)])
        codes = np.array([ord(w) for words in texts for w in words], np.int64)
        start, end, period = runs.text_runs(codes, bounds, least)
        got = list(zip(start.tolist(), (end - start).tolist(), period.tolist()))
        want = [(s + int(lo), n, q) for words, lo in zip(texts, bounds) for s, n, q in plain_runs(words, least)]
        assert got == want


def test_a_very_long_text_of_one_word_and_one_without_a_run():
    assert [x.tolist() for x in runs.text_runs(np.zeros(200_000, np.int64), np.array([0, 200_000]))] == [[0], [200_000], [1]]
    assert len(runs.text_runs(np.arange(200_000), np.array([0, 200_000]))[0]) == 0


def test_runs_as_columns(spark, rng):
    texts = [" ".join(words) for words in periodic_texts(rng, 40)]
    odd = [None, "", " \n\t", "é " * 12, "x\x0bx " * 9, "A a " * 8, "y y " * 12]
    rows = [(k, t, "extra", "clash", 1) for k, t in enumerate(texts + odd + texts[:3])]
    rows.append((None, "n " * 14, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, found string, place int")
    out = {r.doc_id: r for r in runs.collapse_runs(docs).collect()}
    assert len(out) == len(rows) and set(docs.columns) <= set(runs.collapse_runs(docs).columns)
    for doc_id, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        want = plain_runs(words)
        assert [tuple(r) for r in out[doc_id].runs] == want
        assert out[doc_id].collapsed == plain_collapsed(words, want)
        assert out[doc_id].found == (None if doc_id is None else "clash")
    assert runs.collapse_runs(docs.limit(0)).count() == 0


def test_query_of_periodic_runs(spark, rng, tmp_path):
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) for _ in range(120)] + [None, "", "one"]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc_id, text, *_ in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        found, r = plain_runs(words), out[doc_id]
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=None)
        want = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(found), want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
    assert planted > 5 and any(r.n_runs for r in out.values())


# --- conversation repair ---------------------------------------------------------------------------------------


def plain_script(initials, faults):
    """Cheapest and ASCII-least script by a uniform-cost search over whole scripts."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, script, row, last = heapq.heappop(heap)
        if row == len(faults) and last in ("", "a"):
            return cost, script
        if (row, last) in done:
            continue
        done.add((row, last))
        follows = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, script + "I", row, follows))
        if row == len(faults):
            continue
        heapq.heappush(heap, (cost + 4, script + "D", row + 1, last))
        if faults[row] in "bd":
            continue
        mend = 3 if faults[row] == "t" else 0
        if initials[row] == follows or initials[row] == "s" and last == "":
            heapq.heappush(heap, (cost + mend, script + "K", row + 1, initials[row]))
        heapq.heappush(heap, (cost + mend + 3, script + "R", row + 1, follows))
    raise AssertionError


def test_scripts_are_the_cheapest_and_ascii_least(rng):
    for _ in range(3000):
        n = rng.randint(0, 14)
        initials = "".join(rng.choice("suaua?") for _ in range(n))
        faults = "".join(rng.choice("....tbd") for _ in range(n))
        assert repair.cheapest(initials, faults) == plain_script(initials, faults)


def test_an_estimate_is_never_above_the_cost_and_long_stretches_end(rng):
    for _ in range(300):
        n = rng.randint(1, 9)
        initials = "".join(rng.choice("sua?") for _ in range(n))
        faults = "".join(rng.choice("..tbd") for _ in range(n))
        for goal in (None, 0, 1, 2, 3):
            for before in range(4):
                assert repair.estimate(initials, faults, goal)[0][before] <= repair.cheapest(initials, faults, before, goal)[0]
    initials = "".join(rng.choice("sua") for _ in range(1500))
    faults = "".join(rng.choice("....tbd") for _ in range(1500))
    assert repair.cheapest(initials, faults) == plain_script(initials, faults)


def plain_repair(rows):
    """Digest of one conversation from its ordered rows (turn, role, text)."""
    seen, faults = set(), ""
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "."
        seen.add((role, text))
    initials = "".join(role[:1] if role[:1] and role[:1] in "sua" else "?" for _, role, _ in rows)
    cost, audit = plain_script(initials, faults)
    lines, at, last = [], 0, ""
    for edit in audit:
        follows = "a" if last == "u" else "u"
        if edit == "I":
            last = follows
            lines.append({"u": "user", "a": "assistant"}[last] + ":")
            continue
        _, role, text = rows[at]
        if edit != "D":
            last = initials[at] if edit == "K" else follows
            lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[last]) + ":" + text)
        at += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def digests(edits):
    return {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(edits).collect()}


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_conversations_cut_anywhere(spark, rng, stretch):
    big = 2**53
    rows = []
    for conv in [*range(25), None, big, big + 1, big + 2, -7]:
        for _ in range(rng.choice([1, 2, 5, 9, 30])):
            turn = rng.choice([None, *range(12), big + 1])
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "usher", "", None])
            text = rng.choice(["Yes.", "No!", "Why", "so? ", "", " \n", None, "Ünd. \x0b", "x" * 3000 + "."])
            rows.append((conv, turn, role, text, "extra", 3))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, row_no int")
    edits = repair.repair_conversations(table, stretch)
    got = digests(edits)
    for conv in {r[0] for r in rows}:
        own = in_order([(t, role or "", text or "") for c, t, role, text, *_ in rows if c == conv])
        assert got[conv] == plain_repair(own)
    assert edits.where("edit <> 'I'").count() == len(rows)
    empty = repair.repair_conversations(table.limit(0), stretch)
    assert empty.count() == 0 and repair.repair_digests(empty).count() == 0


def test_a_hot_conversation_is_cut_over_many_tasks(spark, rng):
    rows = [(1, k // 2, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", f"{k}."])) for k in range(900)]
    rows += [(k, 0, "user", "Same.") for k in range(2, 300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits = repair.repair_conversations(table, 16).cache()
    assert edits.where("conv_id = 1").select("part").distinct().count() >= 900 // 16
    assert digests(edits)[1] == plain_repair(in_order([r[1:] for r in rows if r[0] == 1]))


def test_query_of_repair(spark, rng, tmp_path):
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Hi. there!", "Ok", None, "What?", " "]))
        for c in [*range(60), None]
        for t in [*range(rng.randint(1, 9)), None]
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    by_conv = {c: [] for c in got}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        elif fault == 2:
            text = "".join(x for x in text if x not in ".!?")
        elif fault == 4:
            role = "user"
        by_conv[c] += [(t, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    for c, own in by_conv.items():
        assert tuple(got[c][n] for n in names) == plain_repair(in_order(own))
