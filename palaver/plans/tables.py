"""The given tables and the views that bind them to the data model.

The SQL below runs unchanged in Spark and in DuckDB, so an operator and its
oracle read the same input.  ``Tables`` exposes each table and view as an
attribute.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.postings import LexicalIndex
from palaver.plans.scale import spread
from palaver.session import configure

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "v_messages": """
SELECT conv_id * 10000 + turn AS id, conv_id, turn, role AS sender, text,
       CASE WHEN turn = 0 THEN NULL ELSE conv_id * 10000 + turn - 1 END AS reply_to,
       CASE WHEN turn = 0 THEN 'service' ELSE 'message' END AS mtype,
       TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS ts,
       (conv_id * 10000 + turn) % 5 = 0 AS has_photo,
       (conv_id * 10000 + turn) % 7 = 0 AS has_file,
       length(text) % 17 AS reaction_count
FROM conversations""",
    # the analysis frame: content messages with a topic; turn 3 carries no text
    "v_frame": """
SELECT id, conv_id, turn, sender, ts, mtype, has_photo, has_file, reaction_count, reaction_count % 3 AS link_count,
       CASE WHEN turn = 3 THEN '' ELSE text END AS text,
       CASE WHEN turn = 3 THEN 0 ELSE length(text) END AS text_length,
       CASE WHEN sender = 'system' THEN NULL ELSE concat('topic ', CAST(conv_id % 12 AS VARCHAR(10))) END AS topic
FROM v_messages WHERE mtype = 'message' OR sender = 'system'""",
    "v_turns": """
SELECT conv_id * 10000 + turn AS id, conv_id AS chat_id, conv_id % 50 AS user_id,
       CAST(turn AS INT) AS turn_idx, role, text AS content,
       TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS ts,
       conv_id % 11 = 0 AS refused, conv_id % 4 = 0 AS rerank,
       CASE WHEN role = 'assistant' THEN conv_id * 10000 + turn END AS tg_message_id,
       CASE WHEN role = 'assistant' THEN 200 + (conv_id * 37 + turn * 911) % 5000 END AS latency_ms,
       CASE WHEN role = 'assistant' THEN
            CASE WHEN (conv_id + turn) % 3 = 0 THEN 'groq/b' ELSE 'gemini/a' END END AS model_used
FROM conversations""",
    # one vote per event, dealt to the conversations in turn and, inside one,
    # to its assistant turns in turn
    "v_feedback": """
SELECT e.event_id AS id, a.conv_id AS chat_id, a.conv_id * 10000 + a.turn AS message_id, e.user_id,
       CASE e.event_type WHEN 'click' THEN 'useful' WHEN 'purchase' THEN 'useful'
            WHEN 'view' THEN 'not_useful' ELSE 'report' END AS rating,
       CASE WHEN e.event_type = 'error' THEN e.props END AS reason, e.ts AS created_at
FROM (SELECT *, event_id % (SELECT max(conv_id) + 1 FROM conversations) AS target,
             CAST(floor(event_id / (SELECT max(conv_id) + 1 FROM conversations)) AS BIGINT) AS lap
      FROM events) e
JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn,
             count(*) OVER (PARTITION BY conv_id) AS n
      FROM conversations WHERE role = 'assistant') a
  ON e.target = a.conv_id AND e.lap % a.n = a.rn""",
    "v_users": """
SELECT e.user_id, max(c.c_name) AS first_name, max(c.c_mktsegment) AS language_code,
       e.user_id % 29 = 0 AS is_bot, min(e.ts) AS joined_at, max(e.ts) AS last_active_at,
       count(*) AS query_count
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
GROUP BY e.user_id""",
    "v_oplog": """
SELECT event_id AS id, ts,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
       concat('app.', event_type) AS logger, props AS message
FROM events""",
    "v_corpus": """
SELECT concat(CASE doc_id % 3 WHEN 0 THEN 'chat_' WHEN 1 THEN 'pdf_' ELSE 'ext_' END,
              CAST(doc_id AS VARCHAR(20))) AS id, doc_id, text, lang AS language, source AS site,
       CASE doc_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'pdf' ELSE 'external' END AS source_type, n_chars
FROM documents""",
    "v_queries": """
SELECT item_id AS qid, text AS query,
       CASE item_id % 4 WHEN 0 THEN 'factual' WHEN 1 THEN 'real_qa' WHEN 2 THEN 'multi_source'
            ELSE 'adversarial' END AS category,
       CASE WHEN item_id % 3 = 0 THEN 'validation' ELSE 'golden' END AS qset,
       CASE WHEN item_id % 4 = 3 THEN TRUE ELSE FALSE END AS must_refuse
FROM benchmark""",
    "v_doc_vectors": """
SELECT d.doc_id, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""",
    "v_item_vectors": """
SELECT b.qid, e.vec_id, e.embedding, e.label
FROM (SELECT item_id AS qid, (item_id * 7) % (SELECT count(*) FROM embeddings) AS vid
      FROM benchmark) b
JOIN embeddings e ON e.vec_id = b.vid""",
    # the expectation of a query: the label of its own vector, and for queries
    # over several sources the next label as well
    "v_expected": """
SELECT i.qid, 0 AS exp_idx, i.label AS expected FROM v_item_vectors i
UNION ALL
SELECT i.qid, 1 AS exp_idx, (i.label + 1) % 10 AS expected
FROM v_item_vectors i JOIN v_queries q ON q.qid = i.qid WHERE q.category = 'multi_source'""",
    # every message also shares the address of a stored page
    "v_link_messages": """
SELECT m.id, m.conv_id, m.turn, m.sender, m.reply_to, m.mtype, m.ts, m.has_photo, m.has_file,
       concat(m.text, ' (see ', p.url, '), again ', p.url, '.') AS text
FROM (SELECT *, (conv_id * 8 + turn) % (SELECT count(*) FROM pages) AS pid FROM v_messages) m
JOIN pages p ON p.page_id = m.pid""",
    # one composed answer per document: cites itself, its neighbour and an
    # unknown id; its retrieved sources are the first two
    "v_answers": """
SELECT doc_id AS answer_id, id AS own,
       concat(CASE (doc_id + 1) % 3 WHEN 0 THEN 'chat_' WHEN 1 THEN 'pdf_' ELSE 'ext_' END,
              CAST(doc_id + 1 AS VARCHAR(20))) AS near,
       concat('As [', CASE (doc_id + 1) % 3 WHEN 0 THEN 'chat_' WHEN 1 THEN 'pdf_' ELSE 'ext_' END,
              CAST(doc_id + 1 AS VARCHAR(20)), '] shows, ', text, ' [', id, ', pdf_unknown] and [',
              id, '].') AS answer
FROM v_corpus""",
    "v_answer_sources": """
SELECT answer_id, own AS id FROM v_answers
UNION ALL SELECT answer_id, near AS id FROM v_answers""",
}


def views_used(sql: str) -> list[str]:
    """Names of the views a statement needs, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    """Prefix a statement with the views it uses, as common table expressions."""
    names = views_used(sql)
    sql = sql.strip()
    recursive = sql.upper().startswith("WITH RECURSIVE ")
    body = sql
    own = ""
    if recursive:
        body = sql[len("WITH RECURSIVE "):]
        own = ", "
    elif sql.upper().startswith("WITH "):
        body = sql[len("WITH "):]
        own = ", "
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    if not ctes:
        return sql
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes}{own or chr(10)}{body}"


ARROW_BYTES = 16 << 20  # of rows handed to a Python task at a time: its memory follows from this, not from the rows' width
INDEXES: dict[tuple[str, str], LexicalIndex] = {}


class Tables:
    """Lazy access to one folder of tables and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        self.folder = folder.rstrip("/")

    def sql(self, statement: str) -> DataFrame:
        for name in BASE:
            text = statement + " ".join(VIEWS[v] for v in views_used(statement))
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(with_views(statement))

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # text work is heavy per byte: small text tables go to all cores
        return spread(df) if name in ("documents", "pages") else df

    @property
    def lexical_index(self) -> LexicalIndex:
        """The stored index of the documents, built at the first use in an application."""
        plain = self.spark.read.parquet(f"{self.folder}/documents.parquet")
        state = plain.agg(F.max("_metadata.file_modification_time").cast("string"), F.count("*")).first()
        name = hashlib.sha256("\n".join([*sorted(plain.inputFiles()), *map(str, state)]).encode()).hexdigest()
        key = (self.spark.sparkContext.applicationId, name)
        if key not in INDEXES:
            INDEXES[key] = LexicalIndex.build(self.documents.select(F.col("doc_id").alias("id"), "text"))
        return INDEXES[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.table(name)
        if f"v_{name}" in VIEWS:
            return self.sql(f"SELECT * FROM v_{name}")
        raise AttributeError(name)
