"""URL filters.

Host rules (host and path prefix, with an action) are regular expressions like all others here, and so are the pattern
rules that judge what no host rule fits. Every rule is indexed by one literal token, the one that fewest urls hold. A
url's tokens fetch its candidate rules, and only their expressions run. DataFrame functions only, and no shuffle but that
of the token counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.support import lower_ascii, save, shield

ALLOW, BLOCK = "allow", "block"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A url matches when ``regex`` is found in its host and rest. ``tokens`` are whole tokens that every match holds."""

    name: str
    regex: str
    tokens: tuple[str, ...]
    action: str
    host_rule: bool = False


def host_rule(name: str, action: str) -> Rule:
    """``host/path``: fits the host and all its subdomains if the path starts with the rule's."""
    host, slash, path = name.partition("/")
    exact = "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in host + "\n" + slash + path)
    # a prefix may end inside a token of the path, so only the host and what a slash closes are sure to be whole tokens
    sure = re.findall(TOKEN, host.lower()) + re.findall(TOKEN, path[: path.rfind("/") + 1].lower())
    return Rule(name, rf"^(?:[^\n]*\.)?{exact}", tuple(dict.fromkeys(sure)), action, True)


def path_rule(*words: str) -> tuple[Rule, ...]:
    """Block urls that have one of the words between separators of the path or query, or in the host."""
    return tuple(Rule(f"word:{w}", rf"(?i)(?<![a-z0-9]){w}(?![a-z0-9])", (w,), BLOCK) for w in words)


#: The rules of the task.
HOST_RULES = (
    host_rule("com/", ALLOW),
    host_rule("example.com/en/", BLOCK),
    host_rule("www.example.com/en/", ALLOW),
    host_rule("net/es/", BLOCK),
    host_rule("net/fr/", BLOCK),
)
#: What decides where no host rule fits: pages that hold no prose, and trades that fill spam.
PATTERN_RULES = path_rule("casino", "poker", "porn", "xxx", "viagra", "escort", "torrent", "login", "signin", "logout", "cart", "checkout") + (
    Rule("wp-admin", r"(?i)/wp-(?:admin|login)", ("wp",), BLOCK),
    *(Rule("session id", rf"(?i)[?&;]{name}=[0-9a-f]{{16,}}", (name,), BLOCK) for name in ("sid", "phpsessid", "jsessionid")),
    Rule("endless calendar", r"(?i)/calendar/\d{4}/\d{1,2}", ("calendar",), BLOCK),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for a null or without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for a null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, reason``, replacing columns of these names.

    The longest host rule that fits gives ``rule`` and ``verdict``, of equal ones the first by name. Else ``rule`` is null and the url is blocked if a
    pattern rule matches, whose name (the first in order of names) is the ``reason``, and allowed if none does. A null
    url, an empty one and one without ``://`` have empty host and path and are allowed unless a pattern matches their text.
    Rows are never merged or dropped, so repeated and empty tables need no care. ``rules`` is configuration, held in the
    plan; a rule without a sure token is a candidate everywhere. For thousands of rules see ``judge_urls_by_table``.
    """
    pages, back = shield(pages, ("_best",))
    host, path, subject = _parts(url)
    tokens = F.array_distinct(F.regexp_extract_all(lower_ascii(subject), F.lit(TOKEN), F.lit(0)))
    everywhere, index = build_index(pages.select(tokens.alias("tokens")), rules)
    entry = lambda r: F.struct(
        F.lit(not r.host_rule).alias("pattern"), F.lit(-len(r.name) if r.host_rule else 0).alias("rank"), F.lit(r.name).alias("name"),
        F.lit(r.regex).alias("regex"), F.lit(r.action).alias("action"),
    )
    fetched = [F.array(*[entry(r) for r in everywhere])] if everywhere else []
    if index:
        table = F.create_map(*[x for token, held in index.items() for x in (F.lit(token), F.array(*[entry(r) for r in held]))])
        known = F.array(*[F.lit(t) for t in index])
        fetched.append(F.flatten(F.transform(F.array_intersect(tokens, known), lambda t: F.element_at(table, t))))
    if not fetched:
        best = F.lit(None).cast("struct<pattern:boolean,rank:int,name:string,regex:string,action:string>")
    else:
        candidates = F.concat(*fetched)
        best = F.array_min(F.filter(candidates, lambda r: F.regexp_like(subject, r["regex"])))  # host rules first, longest first
    by_host = F.col("_best.pattern") == F.lit(False)
    return (
        pages.withColumns({"host": host, "path": path, "_best": best})
        .withColumns(
            {
                "rule": F.when(by_host, F.col("_best.name")),
                "verdict": F.coalesce(F.col("_best.action"), F.lit(ALLOW)),
                "reason": F.when(~by_host, F.col("_best.name")),
            }
        )
        .drop("_best")
        .withColumnsRenamed(back)
    )


def _parts(url: str) -> tuple[Column, Column, Column]:
    """Host, path, and the text that expressions look at: host and rest in two lines."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = url_host(F.col(url))
    rest = F.when(host != "", F.regexp_replace(text, r"(?s)^.*?://[^/?#]*", "")).otherwise(text)
    return host, url_path(F.col(url)), F.concat(host, F.lit("\n"), rest)


RULES_TABLE = "name string, regex string, tokens array<string>, action string, host_rule boolean"


def judge_urls_by_table(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``judge_urls`` for rules kept as a table of ``RULES_TABLE``, as many as there may be.

    The counts of the rules' tokens, the choice of each rule's rarest one and the fetching of candidates are joins by token. A token that
    very many urls hold brings rules only if no rarer token could, and adaptive execution splits its rows. Every rule must have a
    token; one without raises, since it would be tried on every url. Urls are judged once for each distinct subject.
    """
    host, path, subject = _parts(url)
    numbered = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict", "reason")
    numbered, back = shield(numbered, ("_subject", "_best"))
    numbered = save(numbered.withColumn("_subject", subject), "urls")
    subjects = numbered.select("_subject").distinct()
    tokens = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("_subject")), F.lit(TOKEN), F.lit(0)))
    said = subjects.select("_subject", F.explode(tokens).alias("token"))
    some = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(
        F.raise_error(F.concat(F.lit("a rule without a token: "), F.col("name"))).cast("array<string>")
    )
    named = rules.select("name", "regex", "action", "host_rule", F.explode(some).alias("token"))
    counts = said.join(named.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    index = named.join(counts, "token", "left").groupBy("name", "regex", "action", "host_rule").agg(rarest)
    rank = F.struct(
        (~F.col("host_rule")).alias("pattern"), F.when(F.col("host_rule"), -F.length("name")).otherwise(0).alias("rank"), "name", "action"
    )
    fits = said.join(index, "token").where(F.regexp_like("_subject", F.col("regex")))
    best = fits.groupBy("_subject").agg(F.min(rank).alias("_best"))
    judged = numbered.join(best, "_subject", "left")
    by_host = F.col("_best.pattern") == F.lit(False)
    return judged.withColumns(
        {
            "rule": F.when(by_host, F.col("_best.name")),
            "verdict": F.coalesce(F.col("_best.action"), F.lit(ALLOW)),
            "reason": F.when(~by_host, F.col("_best.name")),
        }
    ).drop("_best", "_subject").withColumnsRenamed(back)


def build_index(urls: DataFrame, rules: tuple[Rule, ...]) -> tuple[list[Rule], dict[str, list[Rule]]]:
    """Rules without a token, and the others by the token that fewest of all urls hold (ties: the first by name).

    The counts are taken over all urls and reduced before the shuffle; at most one number for each token of a rule
    comes to the driver.
    """
    named = sorted({t for r in rules for t in r.tokens})
    held = F.explode(F.array_intersect("tokens", F.array(*[F.lit(t) for t in named])))
    counts = {t: n for t, n in urls.select(held.alias("token")).groupBy("token").count().collect()} if named else {}
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return [r for r in rules if not r.tokens], index
