"""Views that give the test tables the shape of the engine's own tables.

Each view is one SQL text that Spark and DuckDB both accept; the few words that differ are filled in for each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AS_OF_SQL = "TIMESTAMP '2024-02-01 00:00:00'"

#: name -> SQL; {explode}: rows from an array.
VIEWS = {
    "v_access": """
        SELECT event_id, 'src' || CAST(user_id % 20 AS STRING) || '::' || CAST(user_id AS STRING) AS doc_id,
               CASE WHEN event_type IN ('view', 'click') THEN 'search_hit' ELSE event_type END AS access_type,
               'q' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS STRING) AS query,
               value / 2500 AS score, CAST(ts AS TIMESTAMP) AS ts
        FROM events""",
    "v_docs": """
        SELECT 'src' || CAST(d.doc_id % 20 AS STRING) || '::' || CAST(d.doc_id AS STRING) AS doc_id, d.doc_id AS doc_num, d.text AS content, d.lang,
               d.source || '/' || d.lang || '/' || CAST(d.doc_id AS STRING) AS file_path,
               {as_of} - INTERVAL '1' DAY * CAST(d.doc_id % 120 AS INT) AS created,
               {as_of} - INTERVAL '1' DAY * CAST(d.doc_id % 120 AS INT) AS indexed_at,
               COALESCE(a.n, 0) AS access_count, a.last_accessed, CAST((d.doc_id * 37) % 100 AS DOUBLE) / 100 AS excitability
        FROM documents d LEFT JOIN (SELECT doc_id, COUNT(*) AS n, MAX(ts) AS last_accessed FROM v_access GROUP BY doc_id) a
             ON a.doc_id = 'src' || CAST(d.doc_id % 20 AS STRING) || '::' || CAST(d.doc_id AS STRING)""",
    "v_coret": """
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, a.query, a.ts AS ts
        FROM (SELECT * FROM (SELECT doc_id, query, ts, event_id, access_type, date_trunc('hour', ts) AS hour,
                     ROW_NUMBER() OVER (PARTITION BY access_type, date_trunc('hour', ts) ORDER BY event_id) AS r FROM v_access) x WHERE r <= 5) a
        JOIN (SELECT * FROM (SELECT doc_id, query, ts, event_id, access_type, date_trunc('hour', ts) AS hour,
                     ROW_NUMBER() OVER (PARTITION BY access_type, date_trunc('hour', ts) ORDER BY event_id) AS r FROM v_access) y WHERE r <= 5) b
          ON a.access_type = b.access_type AND a.hour = b.hour AND a.doc_id < b.doc_id""",
    "v_edges": """
        SELECT md5(doc_id_a || '::' || doc_id_b) AS id, doc_id_a AS source_id, doc_id_b AS target_id,
               CASE CAST((n + LENGTH(doc_id_a || doc_id_b)) % 4 AS INT) WHEN 0 THEN 'references' WHEN 1 THEN 'similar_to' WHEN 2 THEN 'mentions' ELSE 'co_retrieved' END AS type,
               LEAST(CAST(n AS DOUBLE) / 10, 1.0) AS weight, CAST(0.7 AS DOUBLE) AS confidence,
               CASE CAST((n * 7 + LENGTH(doc_id_a)) % 5 AS INT) WHEN 0 THEN {as_of} - INTERVAL '1' DAY WHEN 1 THEN {as_of} + INTERVAL '10' DAY END AS valid_to
        FROM (SELECT doc_id_a, doc_id_b, COUNT(*) AS n FROM v_coret GROUP BY doc_id_a, doc_id_b) g""",
    "v_nodes": """
        SELECT id, 'document' AS type, 'Note ' || id || ' in group ' || CAST(LENGTH(id) AS STRING) AS title, CAST(NULL AS STRING) AS content
        FROM (SELECT source_id AS id FROM v_edges UNION SELECT target_id AS id FROM v_edges) u""",
    "v_doc_tags": """
        SELECT doc_id, lang AS tag FROM v_docs UNION
        SELECT doc_id, split_part(file_path, '/', 1) AS tag FROM v_docs""",
    "v_xrefs": """
        SELECT 'src' || CAST(page_id % 20 AS STRING) || '::' || CAST(page_id AS STRING) AS doc_id, 'link' AS ref_type, {explode}(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref_target
        FROM pages""",
    "v_memories": """
        SELECT 'mem_' || CAST(conv_id * 1000 + turn AS STRING) AS id,
               CASE role WHEN 'user' THEN 'preferences' WHEN 'assistant' THEN 'events' ELSE 'patterns' END AS category, role AS topic,
               substr(text, 1, 60) AS title, substr(text, 1, 100) AS abstract_text, text AS content, 'medium' AS confidence, CAST(turn % 10 AS DOUBLE) / 10 AS importance,
               {as_of} - INTERVAL '1' DAY * CAST(conv_id % 100 AS INT) AS created,
               CASE WHEN conv_id % 3 = 0 THEN {as_of} + INTERVAL '1' HOUR * CAST(turn * 5 - 10 AS INT) END AS expires_at
        FROM conversations""",
    "v_doc_memories": """
        SELECT CAST(doc_id AS STRING) AS id, substr(text, 1, 60) AS title, text AS content FROM documents""",
    "v_mem_access": """
        SELECT 'mem_' || CAST((user_id % 100) * 1000 + user_id % 5 AS STRING) AS memory_id, event_type AS access_type,
               CAST(ts AS TIMESTAMP) - INTERVAL '1' DAY * CAST((user_id * 3) % 40 AS INT) AS ts
        FROM events""",
    "v_events": """
        SELECT event_id, CASE event_type WHEN 'view' THEN 'search' WHEN 'error' THEN 'search_complete' ELSE event_type END AS event_type,
               CAST(user_id AS STRING) AS target_id, 'q' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS STRING) AS query,
               '{{"results_count": ' || regexp_extract(props, '([0-9]+)', 1) || '}}' AS metadata,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS results_count, CAST(ts AS TIMESTAMP) AS ts
        FROM events""",
    "v_vectors": """
        SELECT 'src' || CAST(vec_id % 20 AS STRING) || '::' || CAST(vec_id AS STRING) AS doc_id, vec_id, embedding, label FROM embeddings""",
}


def _needed(sql: str, names: list[str]) -> list[str]:
    """Views that ``sql`` uses, those they use first."""
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql) and name not in names:
            _needed(VIEWS[name], names)
            if name not in names:
                names.append(name)
    return names


def _filled(name: str, explode: str) -> str:
    return VIEWS[name].format(as_of=AS_OF_SQL, explode=explode)


def duck(body: str) -> str:
    """``body`` for DuckDB, after the views that it names."""
    names = _needed(body, [])
    ctes = ",\n".join(f"{n} AS ({_filled(n, 'UNNEST')})" for n in names)
    body = body.replace("{as_of}", AS_OF_SQL).strip()
    if not names:
        return body
    if body[:5].upper() == "WITH ":
        kind, rest = ("WITH RECURSIVE ", body[15:]) if body[:14].upper() == "WITH RECURSIVE" else ("WITH ", body[5:])
        return f"{kind}{ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"


class Views:
    """The tables of a directory and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self._view(name) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def _view(self, name: str) -> DataFrame:
        sql, frames = VIEWS[name], {}
        for n in [*TABLES, *VIEWS]:
            sql, found = re.subn(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
            if found:
                frames[n] = self(n)
        return self.spark.sql(sql.replace("{as_of}", AS_OF_SQL).replace("{explode}", "explode"), **frames)
