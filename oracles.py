"""The registered queries written a second time, as SQL on the same tables."""

from __future__ import annotations

class c:  # noqa: N801 - the values written out once more, so that a wrong one in the engine shows
    MIN_CALL_TOKENS, MIN_SENTENCE_WORDS = 15, 5
    CHUNK_CHARS, CHUNK_OVERLAP = 4096, 50
    SUMMARY_WORD_LIMIT, TOP_TOPICS = 150, 10
    COSINE_THRESHOLD = (2, 5)
    NO_ACTIONS, NO_SUMMARY = "no actions taken generated", "no summary generated"
    UNIDENTIFIED, NO_SECONDARY = "Unidentified", "None"
    SUMMARY_PROMPT_HEAD = (
        "\n[INST] <<SYS>> Summarize the key discussion points between the customer and agent in under 150 words.\n<<SYS>> "
    )
    ACTIONS_PROMPT_HEAD = (
        "\n[INST] <<SYS>> For each conversation, analyze the interaction between the customer and the agent. Identify and return "
        "a detailed list of the specific steps or actions taken by the agent to address and resolve the customer's query or "
        "issue in under 150 words.\n<<SYS>> "
    )
    PROMPT_TAIL = " [/INST]\n"


BLANK = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^{BLANK}\p{{L}}\p{{M}}\p{{N}}_]"
TERM = r"[\p{L}\p{M}\p{N}_]+"
WORD = rf"[^{BLANK}]+"
EDGE = rf"^[{BLANK}]+|[{BLANK}]+$"
RUN = rf"[{BLANK}]*(?:[^{BLANK}]+[{BLANK}]*){{1,149}}"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STRIDE = c.CHUNK_CHARS - c.CHUNK_OVERLAP

# calls and documents both as (id, text)
CALLS = """
texts AS (
  SELECT conv_id AS id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text,
    coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (role = 'assistant'),
             string_agg(coalesce(text, ''), '' ORDER BY turn)) AS agent_text
  FROM conversations GROUP BY conv_id
)"""
DOCS = "texts AS (SELECT doc_id AS id, text, text AS agent_text FROM documents)"


def _words(column: str) -> str:
    return f"len(regexp_extract_all({column}, '{WORD}'))"


def _sentences(source: str, min_words: int = c.MIN_SENTENCE_WORDS) -> str:
    """(id, position, sentence) of a CTE with (id, text)."""
    return f"""
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS position, sentence
    FROM (SELECT id, u.sentence, u.ord
          FROM {source}, unnest(string_split(text, '.')) WITH ORDINALITY AS u(sentence, ord))
    WHERE {_words('sentence')} >= {min_words}"""


def _extract(source: str) -> str:
    """(id, extract) of a CTE with (id, text)."""
    return f"""
    SELECT s.id, regexp_replace(coalesce(string_agg(k.run || '.', '' ORDER BY k.ord, k.nr), ''), '{EDGE}', '', 'g') AS extract
    FROM {source} s LEFT JOIN (
      SELECT id, ord, nr, run FROM (
        SELECT id, ord, nr, run, sum(words) OVER (PARTITION BY id ORDER BY weight DESC, ord, nr ROWS UNBOUNDED PRECEDING) AS total
        FROM (SELECT id, ord, r.run, r.nr, {_words('r.run')} AS words,
                len(list_distinct(regexp_extract_all(lower(r.run), '{TERM}'))) AS weight
              FROM (SELECT id, u.sentence, u.ord FROM {source}, unnest(string_split(text, '.')) WITH ORDINALITY AS u(sentence, ord)),
                unnest(regexp_extract_all(sentence, '{RUN}')) WITH ORDINALITY AS r(run, nr)))
      WHERE total < {c.SUMMARY_WORD_LIMIT}) k ON k.id = s.id
    GROUP BY s.id"""


def _chunks(source: str) -> str:
    """(id, chunk_no, chunk) of a CTE with (id, text)."""
    return f"""
    SELECT id, i AS chunk_no, substring(text, (i * {STRIDE} + 1)::BIGINT, {c.CHUNK_CHARS}) AS chunk
    FROM (SELECT id, text,
                 unnest(range(greatest(1, ceil((length(text) - {c.CHUNK_OVERLAP}) / {STRIDE}.0)::BIGINT))) AS i
          FROM {source})"""


# (id, text, word_count, summary, actions) for every text of the CTE "texts"
SUMMARISED = f"""
chunked AS ({_chunks('texts')}),
chunk_ids AS (SELECT id * 1000000 + chunk_no AS id, chunk AS text FROM chunked),
chunk_extracts AS ({_extract('chunk_ids')}),
chunk_summaries AS (
  SELECT id // 1000000 AS id, string_agg(extract, chr(10) ORDER BY id) AS summary FROM chunk_extracts GROUP BY id // 1000000
),
agent_texts AS (SELECT id, agent_text AS text FROM texts),
call_extracts AS ({_extract('agent_texts')}),
counted AS (SELECT id, text, len(regexp_extract_all(text, {_q(TOKEN)})) AS word_count FROM texts),
summarised AS (
  SELECT t.id, t.text, t.word_count::BIGINT AS word_count,
         CASE WHEN t.word_count > {c.MIN_CALL_TOKENS} THEN l.extract ELSE {_q(c.NO_ACTIONS)} END AS actions_taken,
         CASE WHEN t.word_count > {c.MIN_CALL_TOKENS} THEN s.summary ELSE {_q(c.NO_SUMMARY)} END AS summary
  FROM counted t JOIN call_extracts l USING (id) JOIN chunk_summaries s USING (id)
)"""

TOPICS = f"""
topic_terms AS (
  SELECT item_id AS topic_no, term, count(*) AS tf
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM benchmark) GROUP BY ALL
),
topic_norms AS (SELECT topic_no, sum(tf * tf)::BIGINT AS topic_sq FROM topic_terms GROUP BY topic_no)"""

# needs a CTE "sentences"
MATCHES = f"""{TOPICS},
sentence_terms AS (
  SELECT id, position, term, count(*) AS tf
  FROM (SELECT id, position, unnest(regexp_extract_all(lower(sentence), '{TERM}')) AS term FROM sentences) GROUP BY ALL
),
sentence_norms AS (SELECT id, position, sum(tf * tf)::BIGINT AS sentence_sq FROM sentence_terms GROUP BY ALL),
dots AS (
  SELECT s.id, s.position, t.topic_no, sum(s.tf * t.tf)::BIGINT AS dot
  FROM sentence_terms s JOIN topic_terms t USING (term) GROUP BY ALL
),
matches AS (
  SELECT id, position, topic_no, dot, sentence_sq, topic_sq,
         round(dot / sqrt((sentence_sq * topic_sq)::DOUBLE), 6) AS cos_sim
  FROM dots JOIN sentence_norms USING (id, position) JOIN topic_norms USING (topic_no)
  WHERE {c.COSINE_THRESHOLD[1] ** 2} * dot * dot > {c.COSINE_THRESHOLD[0] ** 2} * sentence_sq * topic_sq
),
ranked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos_sim DESC, position, topic_no) AS rank FROM matches)
  WHERE rank <= {c.TOP_TOPICS}
)"""

SUMMARY_MATCHES = f"""WITH {CALLS}, {SUMMARISED},
summaries AS (SELECT id, summary AS text FROM summarised),
sentences AS ({_sentences('summaries')}), {MATCHES}"""

RERANKED = f"""{SUMMARY_MATCHES},
candidates AS (SELECT id, topic_no, min(rank) AS first_rank FROM ranked GROUP BY ALL),
text_terms AS (
  SELECT id, term, count(*) AS tf
  FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM summaries) GROUP BY ALL
),
text_norms AS (SELECT id, sum(tf * tf)::BIGINT AS text_sq FROM text_terms GROUP BY id),
scores AS (
  SELECT k.id, k.topic_no, k.first_rank, sum(x.tf * t.tf) / sqrt((any_value(text_sq) * any_value(topic_sq))::DOUBLE) AS cosine
  FROM candidates k JOIN text_terms x USING (id) JOIN topic_terms t ON t.topic_no = k.topic_no AND t.term = x.term
  JOIN text_norms n ON n.id = k.id JOIN topic_norms o ON o.topic_no = k.topic_no
  GROUP BY k.id, k.topic_no, k.first_rank
),
labels AS (
  SELECT id, topic_no::VARCHAR AS label, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, first_rank) AS label_rank,
         round(cosine / sum(cosine) OVER (PARTITION BY id), 6) AS score
  FROM scores
)"""

_RESULT = """
  SELECT id AS conv_id, text AS transcription, word_count, actions_taken, summary, NULL::VARCHAR AS error FROM summarised"""

# a text holding this fails in the query error_isolation
REFUSED = "@"

ORACLES: dict[str, str] = {
    "transcript_merge": f"WITH {CALLS} SELECT id AS conv_id, text AS transcription, NULL::VARCHAR AS error FROM texts",
    "transcript_scan": f"""
        WITH {CALLS}, counted AS (SELECT conv_id AS id, count(*) AS utterances FROM conversations GROUP BY conv_id)
        SELECT id AS conv_id, utterances, text AS transcription, agent_text FROM texts JOIN counted USING (id)""",
    "token_count": f"""
        SELECT doc_id, len(regexp_extract_all(text, {_q(TOKEN)}))::BIGINT AS word_count FROM documents""",
    "short_call_gate": f"""
        SELECT doc_id, word_count, word_count > {c.MIN_CALL_TOKENS} AS is_scored,
               CASE WHEN word_count <= {c.MIN_CALL_TOKENS} THEN {_q(c.NO_ACTIONS)} END AS actions_taken,
               CASE WHEN word_count <= {c.MIN_CALL_TOKENS} THEN {_q(c.NO_SUMMARY)} END AS summary
        FROM (SELECT doc_id, len(regexp_extract_all(text, {_q(TOKEN)}))::BIGINT AS word_count FROM documents)""",
    "text_chunks": f"WITH {DOCS} SELECT id AS doc_id, chunk_no, chunk FROM ({_chunks('texts')})",
    "chunk_combine": f"WITH {DOCS}, {SUMMARISED} SELECT id AS doc_id, summary FROM chunk_summaries",
    "prompt_build": f"""
        SELECT doc_id, {_q(c.SUMMARY_PROMPT_HEAD)} || text || {_q(c.PROMPT_TAIL)} AS summary_prompt,
               {_q(c.ACTIONS_PROMPT_HEAD)} || text || {_q(c.PROMPT_TAIL)} AS actions_prompt
        FROM documents""",
    "sentence_split": f"WITH {DOCS} SELECT id AS doc_id, position, sentence FROM ({_sentences('texts')})",
    "lexical_vectors": f"""
        WITH {DOCS}, sentences AS ({_sentences('texts')}), {MATCHES}
        SELECT id AS doc_id, position, term, tf, sentence_sq AS squared_norm
        FROM sentence_terms JOIN sentence_norms USING (id, position)""",
    "lexical_cosine_join": f"""
        WITH {CALLS}, sentences AS ({_sentences('texts')}), {MATCHES}
        SELECT id AS conv_id, position, topic_no, dot, sentence_sq, topic_sq, cos_sim FROM matches""",
    "dense_cosine_join": """
        WITH parts AS (
          SELECT label, dim, avg(x::DOUBLE) AS x
          FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY ALL
        ),
        centroids AS (SELECT label::BIGINT AS topic_no, list(x ORDER BY dim) AS vector FROM parts GROUP BY label),
        pairs AS (
          SELECT vec_id, topic_no, list_cosine_similarity(embedding::DOUBLE[], vector) AS cosine
          FROM embeddings, centroids
        )
        SELECT vec_id, topic_no, round(cosine, 6) AS cos_sim FROM pairs WHERE cosine > 0.2""",
    "dense_cosine_tiles": """
        SELECT vec_id, topic_no, round(cosine, 6) AS cos_sim
        FROM (SELECT v.vec_id, t.vec_id AS topic_no, list_cosine_similarity(v.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS cosine
              FROM embeddings v, embeddings t)
        WHERE cosine > 0.4""",
    "centroid_cosine": """
        WITH parts AS (
          SELECT label, dim, avg(x::DOUBLE) AS x
          FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY ALL
        ),
        centroids AS (SELECT label, list(x ORDER BY dim) AS vector FROM parts GROUP BY label)
        SELECT vec_id, label::BIGINT AS label, round(list_cosine_similarity(embedding::DOUBLE[], vector), 6) AS cos_sim
        FROM embeddings JOIN centroids USING (label)""",
    "encoded_candidates": f"""
        WITH {CALLS}, {SUMMARISED},
        summaries AS (SELECT id, summary AS text FROM summarised),
        sentences AS ({_sentences('summaries')}), {MATCHES},
        slots AS (
          SELECT term, list_reduce(list_transform(string_split(term, ''), lambda ch: unicode(ch)::BIGINT),
                                   lambda a, b: (a * 31 + b) % 256, 0::BIGINT) AS slot
          FROM (SELECT term FROM sentence_terms UNION SELECT term FROM topic_terms)
        ),
        a AS (SELECT id, position, slot, sum(tf) AS x FROM sentence_terms JOIN slots USING (term) GROUP BY ALL),
        b AS (SELECT topic_no, slot, sum(tf) AS y FROM topic_terms JOIN slots USING (term) GROUP BY ALL),
        an AS (SELECT id, position, sqrt(sum(x * x)::DOUBLE) AS norm FROM a GROUP BY ALL),
        bn AS (SELECT topic_no, sqrt(sum(y * y)::DOUBLE) AS norm FROM b GROUP BY ALL),
        cosines AS (
          SELECT id, position, topic_no, sum(x * y)::DOUBLE / (any_value(an.norm) * any_value(bn.norm)) AS cosine
          FROM a JOIN b USING (slot) JOIN an USING (id, position) JOIN bn USING (topic_no)
          GROUP BY id, position, topic_no
        )
        SELECT id AS conv_id, position, sentence, topic_no, topic_no::VARCHAR AS topic, round(cosine, 6) AS cos_sim
        FROM cosines JOIN sentences USING (id, position)
        WHERE cosine > {c.COSINE_THRESHOLD[0]}.0::DOUBLE / {c.COSINE_THRESHOLD[1]}""",
    "topic_candidates": f"""
        WITH {DOCS}, sentences AS ({_sentences('texts')}), {MATCHES}
        SELECT id AS doc_id, position, sentence, topic_no, topic_no::VARCHAR AS topic, cos_sim
        FROM matches JOIN sentences USING (id, position)""",
    "topic_top10": f"""
        WITH {CALLS}, sentences AS ({_sentences('texts')}), {MATCHES}
        SELECT id AS conv_id, rank, position, topic_no, topic_no::VARCHAR AS topic, cos_sim FROM ranked""",
    "topic_rerank": f"{RERANKED} SELECT id AS conv_id, label_rank, label, score FROM labels",
    "topic_primary_secondary": f"""{RERANKED}
        SELECT s.id AS conv_id, s.summary,
               coalesce(max(label) FILTER (label_rank = 1), {_q(c.UNIDENTIFIED)}) AS primary_topic,
               coalesce(max(label) FILTER (label_rank = 2), {_q(c.NO_SECONDARY)}) AS secondary_topic,
               NULL::VARCHAR AS error
        FROM summarised s LEFT JOIN labels USING (id) GROUP BY s.id, s.summary""",
    "topic_row_identity": f"""{RERANKED},
        lists AS (SELECT id, string_agg(topic_no::VARCHAR, '|' ORDER BY rank) AS top_topics FROM ranked GROUP BY id)
        SELECT CASE WHEN s.id % 7 <> 0 THEN s.id // 3 END AS conv_id, s.summary, any_value(top_topics) AS top_topics,
               coalesce(max(label) FILTER (label_rank = 1), {_q(c.UNIDENTIFIED)}) AS primary_topic,
               coalesce(max(label) FILTER (label_rank = 2), {_q(c.NO_SECONDARY)}) AS secondary_topic,
               NULL::VARCHAR AS error
        FROM summarised s LEFT JOIN labels USING (id) LEFT JOIN lists USING (id) GROUP BY s.id, s.summary""",
    "unidentified_row_identity": f"""{SUMMARY_MATCHES}
        SELECT CASE WHEN id % 7 <> 0 THEN id // 3 END AS conv_id, text AS summary FROM summaries WHERE id NOT IN (SELECT id FROM matches)""",
    "unidentified_calls": f"""{SUMMARY_MATCHES}
        SELECT id AS conv_id, text AS summary FROM summaries WHERE id NOT IN (SELECT id FROM matches)""",
    "lead_summary": f"WITH {CALLS}, {SUMMARISED} {_RESULT}",
    "summarise_rows": f"WITH {CALLS}, {SUMMARISED} {_RESULT}",
    "summarise_long_rows": f"WITH {DOCS}, {SUMMARISED} {_RESULT}",
    "summarise_in_place": f"WITH {DOCS}, {SUMMARISED} {_RESULT}",
    "agent_actions": f"""
        WITH {CALLS}, agent_texts AS (SELECT id, agent_text AS text FROM texts)
        SELECT id AS conv_id, extract AS actions_taken FROM ({_extract('agent_texts')})""",
    "batch_predict": f"WITH {DOCS} SELECT id AS doc_id, extract AS output FROM ({_extract('texts')})",
    "frame_predict": f"""
        WITH found AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '{TERM}') AS terms FROM documents)
        SELECT doc_id, len(terms) AS terms, lang || ':' || coalesce(terms[1], '') AS opening, NULL::VARCHAR AS error FROM found""",
    "error_isolation": f"""
        WITH {DOCS}, {SUMMARISED}, outcome AS (
          SELECT *, word_count > {c.MIN_CALL_TOKENS} AND contains(text, '{REFUSED}') AS failed FROM summarised
        )
        SELECT id AS conv_id, word_count, CASE WHEN failed THEN 'Error: prompt refused' ELSE actions_taken END AS actions_taken,
               CASE WHEN failed THEN 'Error: prompt refused' ELSE summary END AS summary,
               CASE WHEN failed THEN 'prompt refused' END AS error
        FROM outcome""",
    "topic_catalogue": """
        SELECT row_number() OVER (ORDER BY (item_id // 1000)::VARCHAR, item_id) - 1 AS topic_no, item_id::VARCHAR AS topic, text AS description
        FROM benchmark""",
    "encoder_isolation": f"""
        WITH {DOCS}, sentences AS ({_sentences('texts')})
        SELECT id AS doc_id, position, CASE WHEN NOT contains(sentence, '{REFUSED}') THEN len(regexp_extract_all(lower(sentence), '{TERM}')) END AS terms,
               CASE WHEN contains(sentence, '{REFUSED}') THEN 'prompt refused' END AS error
        FROM sentences""",
    "file_inventory": """
        WITH lines AS (SELECT page_id, page_id // 100 AS shard, coalesce(url, '') || ' ' || coalesce(html, '') || chr(10) AS line FROM pages)
        SELECT shard, sum(octet_length(encode(line)))::BIGINT AS bytes, md5(string_agg(line, '' ORDER BY page_id)) AS content_md5
        FROM lines GROUP BY shard""",
    "parse_topic_list": r"""
        SELECT doc_id,
               CASE doc_id % 18 WHEN 0 THEN lang || '|' || source WHEN 1 THEN lang || '|' || source WHEN 2 THEN lang || '|' || source
                 WHEN 3 THEN lang || '|' || source WHEN 4 THEN lang WHEN 5 THEN source WHEN 6 THEN '1|-2.5|' || lang
                 WHEN 7 THEN '[''' || lang || ''', (''x'',)]|' || source WHEN 8 THEN lang || '''s|' || source || ' "q"' WHEN 9 THEN ''
                 WHEN 13 THEN lang WHEN 14 THEN lang || source WHEN 15 THEN 'A' || chr(233) || chr(9) || '|True' WHEN 17 THEN '' END AS topics,
               CASE doc_id % 18 WHEN 4 THEN 1 WHEN 6 THEN 3 WHEN 9 THEN 0 WHEN 10 THEN NULL WHEN 11 THEN NULL WHEN 12 THEN NULL WHEN 14 THEN 1
                 WHEN 16 THEN NULL WHEN 17 THEN 0 ELSE 2 END::BIGINT AS size
        FROM documents""",
    "run_date_key": """
        SELECT strftime(ts, '%Y_%m_%d') AS run_date, count(*) AS events FROM events GROUP BY ALL""",
    "run_stats": f"""
        WITH {CALLS}, sentences AS ({_sentences('texts')}), {MATCHES},
        per_call AS (SELECT t.id, t.text, count(m.id) AS candidates FROM texts t LEFT JOIN matches m USING (id) GROUP BY ALL)
        SELECT count(*) AS calls,
               count(*) FILTER (len(regexp_extract_all(text, {_q(TOKEN)})) > {c.MIN_CALL_TOKENS}) AS scored_calls,
               count(*) FILTER (candidates = 0) AS calls_without_candidate,
               count(*) FILTER (candidates >= {c.TOP_TOPICS}) AS calls_with_full_list,
               sum(candidates)::BIGINT AS candidates
        FROM per_call""",
    "sink_roundtrip": f"""
        WITH {CALLS}, {SUMMARISED}, runs AS ({_RESULT})
        SELECT * FROM runs, (VALUES ('2026_01_30'), ('2026_01_31')) AS d(run_date)""",
    "failed_rerun": f"""
        WITH {CALLS}, {SUMMARISED}, result AS ({_RESULT}) SELECT *, '2026_01_31' AS run_date FROM result""",
    "stream_handover": f"WITH {CALLS}, {SUMMARISED} SELECT id AS conv_id, summary FROM summarised",
    "incremental_drop": f"""
        WITH {CALLS}, {SUMMARISED}, result AS ({_RESULT})
        SELECT *, CASE conv_id % 2 WHEN 0 THEN '2026_02_01' ELSE '2026_02_02' END AS run_date FROM result""",
}

ORACLES["lexical_cosine_tiles"] = ORACLES["lexical_cosine_join"]

# Pieces of a text by its coarsest separator, pieces too long by the next finer one; `path` orders them. A group is the pieces between
# two that are too long, packed step by step: `ends` holds the lengths up to each piece, and a step is one chunk.
ORACLES["boundary_chunks"] = rf"""
WITH RECURSIVE cut(doc_id, path, piece, finest, is_done) AS (
  SELECT doc_id, CAST([] AS BIGINT[]), text, 1, false FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, list_append(path, ord), part, depth + 1, len(part) < {c.CHUNK_CHARS} OR depth = 4
  FROM (
    SELECT doc_id, path, depth, unnest(parts) AS part, unnest(range(len(parts))) AS ord
    FROM (
      SELECT doc_id, path, depth, CASE WHEN depth = 4 THEN string_split(piece, '')
          ELSE list_filter(list_transform(string_split(piece, sep), lambda x, i: CASE WHEN i = 1 THEN x ELSE sep || x END), lambda x: x <> '') END AS parts
      FROM (
        SELECT *, [chr(10) || chr(10), chr(10), ' ', ''][depth] AS sep
        FROM (
          SELECT doc_id, path, piece, CASE WHEN finest <= 1 AND contains(piece, chr(10) || chr(10)) THEN 1 WHEN finest <= 2 AND contains(piece, chr(10)) THEN 2
              WHEN finest <= 3 AND contains(piece, ' ') THEN 3 ELSE 4 END AS depth
          FROM cut WHERE NOT is_done))))),
placed AS (
  SELECT *, path[:-2] AS parent, sum(CASE WHEN is_done THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, path[:-2] ORDER BY path) AS nr
  FROM cut WHERE len(path) > 0),
summed AS (
  SELECT *, sum(len(piece)) OVER (PARTITION BY doc_id, parent, nr ORDER BY path)::BIGINT AS total FROM placed WHERE is_done),
packed AS (
  SELECT doc_id, min(path) AS place, list(piece ORDER BY path) AS pieces, list(len(piece) ORDER BY path) AS sizes, list(total ORDER BY path) AS ends
  FROM summed GROUP BY doc_id, parent, nr),
steps(doc_id, place, first, last) AS (
  SELECT doc_id, place, 1::BIGINT, len(list_filter(ends, lambda x: x <= greatest({c.CHUNK_CHARS}, sizes[1]))) FROM packed
  UNION ALL
  SELECT doc_id, place, next, greatest(next, len(list_filter(ends, lambda x: x - before <= {c.CHUNK_CHARS})))
  FROM (
    SELECT *, CASE WHEN next = 1 THEN 0 ELSE ends[next - 1] END AS before
    FROM (
      SELECT s.doc_id, s.place, p.ends,
        greatest(first, 1 + CASE WHEN ends[last] <= least({c.CHUNK_OVERLAP}, {c.CHUNK_CHARS} - sizes[last + 1]) THEN 0
          ELSE len(list_filter(ends[:last], lambda x: ends[last] - x > least({c.CHUNK_OVERLAP}, {c.CHUNK_CHARS} - sizes[last + 1]))) + 1 END) AS next
      FROM steps s JOIN packed p ON p.doc_id = s.doc_id AND p.place = s.place WHERE last < len(ends)))),
chunks AS (
  SELECT doc_id, place, first, regexp_replace(array_to_string(pieces[first:last], ''), '{EDGE}', '', 'g') AS chunk
  FROM steps JOIN packed USING (doc_id, place))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place, first) - 1)::INTEGER AS chunk_no, chunk FROM chunks WHERE chunk <> ''
"""
