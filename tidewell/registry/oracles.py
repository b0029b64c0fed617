"""DuckDB SQL giving the rows each registered query must give.

Written independently of the Spark side: chunks come from a recursive walk
over word ends, vectors from counted hash buckets, distances from the buckets
two vectors share.
"""

from __future__ import annotations

from tidewell.registry import samples


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)


def _clean(text: str) -> str:
    return (
        f"lower(trim(regexp_replace(regexp_replace(coalesce({text}, ''), "
        r"'<[^>]+>', '', 'g'), '\s+', ' ', 'g')))"
    )


_CHUNKED = f"""
cleaned AS MATERIALIZED (
  SELECT doc_id, {_clean("text")} AS t FROM documents
), words AS (
  SELECT doc_id, unnest(string_split(t, ' ')) AS w,
         generate_subscripts(string_split(t, ' '), 1) AS i
  FROM cleaned WHERE t <> ''
), word_ends AS (
  SELECT doc_id, i,
         CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS e
  FROM words
), cuts AS MATERIALIZED (
  SELECT doc_id, list(e ORDER BY i) AS cs, max(e) AS n FROM word_ends GROUP BY doc_id
), walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS s,
         list_max(list_filter(cs, lambda c: c <= 500)) AS e, n, cs
  FROM cuts
  UNION ALL
  SELECT doc_id, chunk_no, s, list_max(list_filter(cs, lambda c: c <= s + 500)), n, cs
  FROM (
    SELECT doc_id, chunk_no + 1 AS chunk_no, n, cs,
           list_min(list_filter(cs, lambda c: c >= earliest)) AS s
    FROM (
      SELECT doc_id, chunk_no, n, cs,
             greatest(e - 50, s + 1, list_min(list_filter(cs, lambda c: c > e)) - 500) AS earliest
      FROM walk WHERE e < n
    )
  )
), chunked AS MATERIALIZED (
  SELECT doc_id, chunk_no, trim(substr(t, s + 1, e - s)) AS chunk_text
  FROM walk JOIN cleaned USING (doc_id)
)"""

_SILVER = f"""{_CHUNKED}, silver AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) AS source_file, chunk_text,
         row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR), chunk_no) - 1 AS chunk_id
  FROM chunked
)"""


def _encoded(name: str, source: str) -> str:
    """A CTE of non-zero vector components for ``(id, t)`` rows."""
    return f"""
{name} AS MATERIALIZED (
  SELECT id, b, CAST(CAST(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS v
  FROM (
    SELECT id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS UBIGINT) % 384 AS BIGINT) AS b,
           CAST(count(*) AS DOUBLE) AS tf
    FROM (SELECT id, unnest(string_split(t, ' ')) AS w FROM ({source}))
    WHERE w <> '' GROUP BY id, b
  )
)"""


def _ranked(name: str, queries: str, q_ids: str, corpus: str, c_ids: str, k: int) -> str:
    """CTEs ranking corpus ids for every query id, from component tables."""
    return f"""
{name}_dist AS (
  SELECT q.id AS q_id, c.id AS c_id,
         round(coalesce(qn.s, 0) + coalesce(cn.s, 0) + coalesce(p.s, 0), 9) AS squared_l2
  FROM ({q_ids}) q CROSS JOIN ({c_ids}) c
  LEFT JOIN (SELECT id, sum(v * v) AS s FROM {queries} GROUP BY id) qn ON qn.id = q.id
  LEFT JOIN (SELECT id, sum(v * v) AS s FROM {corpus} GROUP BY id) cn ON cn.id = c.id
  LEFT JOIN (
    SELECT a.id AS q_id, b.id AS c_id, sum((a.v - b.v) * (a.v - b.v) - a.v * a.v - b.v * b.v) AS s
    FROM {queries} a JOIN {corpus} b ON a.b = b.b GROUP BY ALL
  ) p ON p.q_id = q.id AND p.c_id = c.id
), {name} AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY squared_l2, c_id) AS rank
    FROM {name}_dist
  ) WHERE rank <= {k}
)"""




def _retrieved(question: str) -> str:
    """CTEs up to ranked hits and assembled contexts, for encoded question texts."""
    query_rows = f"SELECT item_id AS id, {question} AS t FROM benchmark"
    ranked = _ranked(
        "ranked", "query_vectors", "SELECT item_id AS id FROM benchmark",
        "chunk_vectors", "SELECT chunk_id AS id FROM silver", 3,
    )
    return f"""WITH RECURSIVE {_SILVER},
{_encoded("chunk_vectors", "SELECT chunk_id AS id, chunk_text AS t FROM silver")},
{_encoded("query_vectors", query_rows)},
{ranked},
hits AS MATERIALIZED (
  SELECT q_id AS query_id, rank, chunk_id, source_file, chunk_text, squared_l2,
         round(sqrt(squared_l2), 9) AS l2
  FROM ranked JOIN silver ON c_id = chunk_id
), questions AS (SELECT item_id AS query_id, text AS question FROM benchmark),
contexts AS (
  SELECT query_id, question,
    coalesce(string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank), '') AS context,
    coalesce(string_agg('[' || source_file || '] ' || chunk_text,
                        chr(10) || chr(10) ORDER BY rank), '') AS cited,
    chr(10) || chr(10) || '**Sources:**'
      || coalesce(string_agg(chr(10) || '- *' || source_file || '*', '' ORDER BY rank), '')
      AS sources,
    coalesce(max(chunk_text) FILTER (rank = 1), 'I don\'\'t know') AS answer
  FROM questions LEFT JOIN hits USING (query_id) GROUP BY query_id, question
)"""


_RETRIEVED = _retrieved(_clean("text"))

_PROMPT = (
    "'Answer the question based on the context below. If the answer is not in the context, "
    "say \"I don''t know\".' || chr(10) || chr(10) || 'Context:' || chr(10) || context "
    "|| chr(10) || chr(10) || 'Question:' || chr(10) || question "
    "|| chr(10) || chr(10) || 'Answer:'"
)

_EXAMPLES = """
examples AS (
  SELECT CAST(label AS BIGINT) AS label, arg_min(embedding, vec_id) AS e
  FROM embeddings GROUP BY label
), dist AS (
  SELECT label, vec_id, round(sum(gap * gap), 9) AS squared_l2
  FROM (
    SELECT x.label, v.vec_id,
           unnest(x.e)::DOUBLE - unnest(v.embedding)::DOUBLE AS gap
    FROM examples x CROSS JOIN embeddings v
  ) GROUP BY label, vec_id
)"""

_FIRST_LOAD_UNTIL = "TIMESTAMP '1998-06-30 00:00:00'"

ORACLES: dict[str, str] = {
    "ingest_jdbc_full": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
        FROM orders""",
    "ingest_increment_split": f"""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
               CAST(o_orderdate AS VARCHAR) AS o_orderdate,
               CAST(CASE WHEN o_orderdate <= {_FIRST_LOAD_UNTIL} THEN 1 ELSE 2 END AS BIGINT)
                 AS load_no
        FROM orders WHERE o_orderdate IS NOT NULL""",
    "ingest_incremental": f"""
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
               CAST(o_orderdate AS VARCHAR) AS o_orderdate,
               CAST(CASE WHEN o_orderdate <= {_FIRST_LOAD_UNTIL} THEN 1 ELSE 2 END AS BIGINT)
                 AS load_no
        FROM orders WHERE o_orderdate IS NOT NULL""",
    "ingest_early_dates": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
               CAST(o_orderdate - INTERVAL 150 YEAR AS VARCHAR) AS o_orderdate
        FROM orders WHERE o_orderdate IS NOT NULL AND coalesce(o_orderstatus, '') <> 'F'""",
    "ingest_no_new_rows": """
        SELECT count(ts) AS first_load, CAST(0 AS BIGINT) AS second_load,
               CAST(max(ts) AS VARCHAR) AS second_watermark, count(ts) AS rows_in_target
        FROM events""",
    "ingest_inclusive": """
        WITH m AS (SELECT max(o_orderdate) AS hi FROM orders WHERE o_orderstatus = 'O')
        SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
               CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS BIGINT) AS load_no
        FROM orders, m WHERE o_orderstatus = 'O' OR o_orderdate >= hi""",
    "high_watermark": """
        SELECT 'orders' AS table_name, CAST(max(o_orderdate) AS VARCHAR) AS watermark FROM orders
        UNION ALL SELECT 'events', CAST(max(ts) AS VARCHAR) FROM events
        UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS VARCHAR) FROM lineitem
        UNION ALL SELECT 'missing', '1900-01-01 00:00:00'""",
    "new_record_count": """
        SELECT count(*) AS new_records FROM lineitem
        WHERE l_shipdate > (SELECT max(o_orderdate) FROM orders)""",
    "append_merge_schema": """
        SELECT c_custkey, c_name, c_acctbal FROM customer
        UNION ALL BY NAME SELECT c_custkey, c_name, c_mktsegment FROM customer""",
    "bronze_latest": """
        SELECT o_orderkey,
               CAST(CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 7 DAY
                         ELSE o_orderdate END AS VARCHAR) AS o_orderdate,
               CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice
        FROM orders""",
    "latest_after_two_loads": """
        SELECT o_orderkey,
               CAST(CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 7 DAY
                         ELSE o_orderdate END AS VARCHAR) AS o_orderdate,
               CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice
        FROM orders""",
    "ingest_named": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
        FROM orders WHERE o_orderdate IS NOT NULL""",
    "ingest_logged": """
        WITH loads AS (
          SELECT CASE WHEN ts < '2024-01-08' THEN 1 WHEN ts < '2024-01-15' THEN 2 ELSE 3 END AS load_no,
                 count(*) AS new_records, CAST(max(ts) AS VARCHAR) AS watermark
          FROM events WHERE ts IS NOT NULL GROUP BY load_no
        )
        SELECT CAST(load_no AS BIGINT) AS load_no, new_records,
               coalesce(lag(watermark) OVER (ORDER BY load_no), '1900-01-01 00:00:00') AS started_from,
               watermark, CAST(sum(new_records) OVER () AS BIGINT) AS rows_in_target
        FROM loads""",
    "replace_versions": """
        SELECT c_custkey, upper(c_name) AS c_name, c_mktsegment FROM customer""",
    "policy_view": f"""
        SELECT t.conv_id, t.turn, CAST(s.id AS BIGINT) AS id, s.topic, s.content
        FROM conversations t
        JOIN (VALUES {_values(samples.SPEAKERS)}) s(id, topic, content) ON s.topic = t.role""",
    "docs_inline": f"""
        SELECT source_file, {_clean("raw_content")} AS cleaned_content FROM (
          SELECT CAST(doc_id AS VARCHAR) AS source_file, text AS raw_content FROM documents
          UNION ALL SELECT * FROM (VALUES {_values(samples.DOCUMENTS)}) d(source_file, raw_content)
        )""",
    "bronze_documents": """
        SELECT CAST(doc_id AS VARCHAR) AS source_file, text AS raw_content, TRUE AS has_time
        FROM documents""",
    "clean_documents": f"SELECT doc_id, {_clean('text')} AS cleaned_content FROM documents",
    "clean_pages": f"SELECT page_id, {_clean('html')} AS cleaned_content FROM pages",
    "chunk_documents": f"WITH RECURSIVE {_CHUNKED} SELECT doc_id, chunk_no, chunk_text FROM chunked",
    "preview_chunks": f"""WITH RECURSIVE {_CHUNKED}
        SELECT doc_id, chunk_no,
               'Found in ' || doc_id || ': ' || substr(chunk_text, 1, 100) || '...' AS preview
        FROM chunked""",
    "chunk_ids_unique": f"""WITH RECURSIVE {_CHUNKED}
        SELECT count(*) AS num_chunks, count(*) AS num_ids FROM chunked""",
    "chunk_ids_dense": f"""WITH RECURSIVE {_CHUNKED}
        SELECT doc_id, chunk_no, row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS chunk_id
        FROM chunked""",
    "medallion_chunks": f"""WITH RECURSIVE {_SILVER}
        SELECT source_file, chunk_text, chunk_id FROM silver""",
    "embed_chunks": f"""WITH RECURSIVE {_CHUNKED},
        numbered AS (
          SELECT *, row_number() OVER (ORDER BY doc_id, chunk_no) AS id FROM chunked
        ),
        {_encoded("vectors", "SELECT id, chunk_text AS t FROM numbered")}
        SELECT doc_id, chunk_no, b AS position, round(v, 7) AS weight
        FROM vectors JOIN numbered USING (id)""",
    "embed_distinct_chunks": f"""WITH RECURSIVE {_CHUNKED},
        numbered AS (
          SELECT *, row_number() OVER (ORDER BY doc_id, chunk_no) AS id FROM chunked
        ),
        {_encoded("vectors", "SELECT id, chunk_text AS t FROM numbered")}
        SELECT doc_id, chunk_no, b AS position, round(v, 7) AS weight
        FROM vectors JOIN numbered USING (id)""",
    "layers_refresh": f"""WITH RECURSIVE {_CHUNKED},
        numbered AS (
          SELECT *, row_number() OVER (ORDER BY doc_id, chunk_no) AS id FROM chunked
        ),
        {_encoded("vectors", "SELECT id, chunk_text AS t FROM numbered")}
        SELECT CAST(doc_id AS VARCHAR) AS source_file, chunk_no, chunk_text,
               count(*) AS n_components
        FROM vectors JOIN numbered USING (id) GROUP BY ALL""",
    "index_stats": """
        SELECT 'index_creation' AS run_name, count(*) AS num_vectors,
               max(len(embedding)) AS embedding_dim
        FROM embeddings""",
    "id_mapping": """
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_pos, vec_id AS chunk_id
        FROM embeddings""",
    "knn_l2_top3": f"""WITH {_EXAMPLES}
        SELECT label, rank, vec_id, squared_l2, round(sqrt(squared_l2), 9) AS l2 FROM (
          SELECT *, row_number() OVER (PARTITION BY label ORDER BY squared_l2, vec_id) AS rank
          FROM dist
        ) WHERE rank <= 3""",
    "knn_pivot_index": f"""WITH {_EXAMPLES}
        SELECT label, rank, vec_id, squared_l2, round(sqrt(squared_l2), 9) AS l2 FROM (
          SELECT *, row_number() OVER (PARTITION BY label ORDER BY squared_l2, vec_id) AS rank
          FROM dist
        ) WHERE rank <= 3""",
    "knn_k_exceeds_n": f"""WITH {_EXAMPLES}
        SELECT vec_id, label, squared_l2,
               row_number() OVER (PARTITION BY vec_id ORDER BY squared_l2, label) AS rank
        FROM dist""",
    "nearest_one": f"""WITH {_EXAMPLES}
        SELECT vec_id, label, squared_l2 FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY squared_l2, label) AS rank
          FROM dist
        ) WHERE rank = 1""",
    "retrieve_context": f"{_RETRIEVED} SELECT * FROM hits",
    "retrieve_uncleaned": f"{_retrieved('text')} SELECT * FROM hits",
    "retrieve_saved_index": f"""WITH {_EXAMPLES},
        positions AS (
          SELECT vec_id, CAST(label AS BIGINT) AS hit_label,
                 row_number() OVER (ORDER BY vec_id) - 1 AS vec_pos
          FROM embeddings
        )
        SELECT label, rank, vec_pos, vec_id, hit_label, squared_l2 FROM (
          SELECT *, row_number() OVER (PARTITION BY label ORDER BY squared_l2, vec_id) AS rank
          FROM dist
        ) JOIN positions USING (vec_id) WHERE rank <= 3""",
    "lookup_chunks_by_id": f"""WITH RECURSIVE {_SILVER}
        SELECT chunk_id, source_file, chunk_text FROM silver
        WHERE chunk_id IN (SELECT doc_id FROM labels)""",
    "assemble_context": f"{_RETRIEVED} SELECT query_id, context FROM contexts",
    "assemble_cited_context": f"{_RETRIEVED} SELECT query_id, cited AS context FROM contexts",
    "format_sources": f"{_RETRIEVED} SELECT query_id, answer || sources AS response FROM contexts",
    "build_prompts": f"{_RETRIEVED} SELECT query_id, {_PROMPT} AS prompt FROM contexts",
    "answer_questions": f"""{_RETRIEVED}
        SELECT query_id, question, {_PROMPT} AS prompt, answer FROM contexts""",
    "answer_generated": f"""{_RETRIEVED}
        SELECT query_id,
               CASE WHEN length(p) <= 1700 THEN substr(
                 len(string_split(p, ' ')) || ' words asked about '
                 || substr(p, strpos(p, 'Context:' || chr(10)) + 9), 1, 160) END AS answer,
               CASE WHEN length(p) > 1700 THEN 'ValueError: prompt too long' END AS failure
        FROM (SELECT query_id, {_PROMPT} AS p FROM contexts)""",
    "answer_with_sources": f"""{_RETRIEVED}
        SELECT query_id, question, cited AS context, answer, answer || sources AS response
        FROM contexts""",
    "append_chat_turns": """
        WITH last AS (
          SELECT conv_id, max(turn) AS t, arg_max(text, turn) AS question, count(*) AS n
          FROM conversations GROUP BY conv_id
        )
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT conv_id, t + 1, 'user', question FROM last
        UNION ALL SELECT conv_id, t + 2, 'assistant', 'Turns so far: ' || n FROM last""",
    "new_chat_turns": """
        WITH last AS (
          SELECT conv_id, max(turn) AS t, arg_max(text, turn) AS question, count(*) AS n
          FROM conversations GROUP BY conv_id
        )
        SELECT conv_id, t + 1 AS turn, 'user' AS role, question AS text FROM last
        UNION ALL SELECT conv_id, t + 2, 'assistant', 'Turns so far: ' || n FROM last""",
    "new_chat_turns_kept": """
        WITH last AS (
          SELECT conv_id, max(turn) AS t, arg_max(text, turn) AS question, count(*) AS n
          FROM conversations GROUP BY conv_id
        )
        SELECT conv_id, t + 1 AS turn, 'user' AS role, question AS text FROM last
        UNION ALL SELECT conv_id, t + 2, 'assistant', 'Turns so far: ' || n FROM last""",
    "policy_nearest": f"""WITH entries AS (
          SELECT * FROM (VALUES {_values(samples.ENTRIES)}) v(id, topic, content)
        ), turns AS (SELECT conv_id || '-' || turn AS id, {_clean("text")} AS t FROM conversations),
        entry_texts AS (SELECT CAST(id AS BIGINT) AS id, {_clean("content")} AS t FROM entries),
        {_encoded("entry_vectors", "SELECT id, t FROM entry_texts")},
        {_encoded("turn_vectors", "SELECT id, t FROM turns")},
        {_ranked("ranked", "turn_vectors", "SELECT id FROM turns",
                 "entry_vectors", "SELECT id FROM entry_texts", 1)}
        SELECT q_id AS query_id, c_id AS id, topic, content, squared_l2
        FROM ranked JOIN entries ON entries.id = c_id""",
}
