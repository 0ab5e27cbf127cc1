"""The logical tables of a reading library, bound to the tables at hand.

Each binding is SQL that Spark and the reference database both run; {minutes:x} stands
for a time that many minutes after the start, {all} for the flag that makes a
replacement global where that isn't the rule.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LOGICAL: dict[str, str] = {
    "library_documents": """
        SELECT CAST(doc_id AS VARCHAR(20)) AS id, doc_id AS number, substr(split_part(text, chr(10), 1), 1, 80) AS title, source AS category, lang,
               substr(trim(regexp_replace(text, '[ \t\n\r]+', ' '{all})), 1, 220) AS summary, text AS body, {minutes:doc_id % 500} AS updated_at
        FROM {documents}
    """,
    "library_articles": """
        SELECT CAST(page_id AS VARCHAR(20)) AS id, page_id AS number, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               'web' AS category, html AS body, trim(regexp_replace(html, '<[^>]+>', ' '{all})) AS text, {minutes:page_id % 500} AS updated_at
        FROM {pages}
    """,
    "library_papers": """
        SELECT CAST(item_id AS VARCHAR(20)) AS id, item_id AS number, substr(text, 1, 80) AS title, 'paper' AS category, text AS body,
               {minutes:item_id % 500} AS updated_at
        FROM {benchmark}
    """,
    "content": """
        SELECT 'document' AS target_type, id AS target_id, title, category, summary, updated_at FROM {library_documents}
        UNION ALL
        SELECT 'article', id, title, category, substr(title, 1, 220), updated_at FROM {library_articles}
        UNION ALL
        SELECT 'paper', id, title, category, substr(trim(regexp_replace(body, '[ \t\n\r]+', ' '{all})), 1, 220), updated_at FROM {library_papers}
    """,
    "content_tags": """
        SELECT 'document' AS target_type, CAST(doc_id AS VARCHAR(20)) AS target_id, lang AS tag_name FROM {documents}
        UNION ALL
        SELECT 'document', CAST(doc_id AS VARCHAR(20)), concat('quality:', CAST(quality AS VARCHAR(5))) FROM {labels}
        UNION ALL
        SELECT 'document', CAST(doc_id AS VARCHAR(20)), concat('toxic:', CAST(toxic AS VARCHAR(5))) FROM {labels}
    """,
    "favorites": "SELECT 'document' AS target_type, CAST(doc_id AS VARCHAR(20)) AS target_id FROM {labels} WHERE quality = 1",
    "folders": """
        SELECT concat('r', CAST(r_regionkey AS VARCHAR(9))) AS id, CAST(NULL AS VARCHAR(40)) AS parent_id, r_name AS name, r_regionkey AS sort_order FROM {region}
        UNION ALL
        SELECT concat('n', CAST(n_nationkey AS VARCHAR(9))), concat('r', CAST(n_regionkey AS VARCHAR(9))), n_name, n_nationkey FROM {nation}
        UNION ALL
        SELECT DISTINCT concat('s', CAST(c_nationkey AS VARCHAR(9)), '-', c_mktsegment), concat('n', CAST(c_nationkey AS VARCHAR(9))), c_mktsegment, 0 FROM {customer}
    """,
    "content_folders": """
        SELECT 'document' AS target_type, CAST(doc_id AS VARCHAR(20)) AS target_id, concat('n', CAST(doc_id % 25 AS VARCHAR(9))) AS folder_id FROM {documents} WHERE doc_id % 11 <> 0
        UNION ALL
        SELECT 'article', CAST(page_id AS VARCHAR(20)), concat('n', CAST(page_id % 25 AS VARCHAR(9))) FROM {pages}
    """,
    "reading_states": """
        SELECT user_id AS owner_id, 'document' AS target_type, CAST(event_id % 50 AS VARCHAR(20)) AS target_id, max(ts) AS updated_at,
               CAST(least(100, max(floor(value))) AS BIGINT) AS progress
        FROM {events} GROUP BY user_id, event_id % 50
    """,
    "ticks": "SELECT user_id AS owner_id, ts, event_id AS seq, CAST(event_id % 50 AS VARCHAR(20)) AS target_id, value FROM {events}",
    "reviews": """
        SELECT CAST(user_id AS VARCHAR(20)) AS card_id, event_id AS seq, ts,
               CASE event_type WHEN 'error' THEN 'again' WHEN 'view' THEN 'hard' WHEN 'click' THEN 'good' WHEN 'purchase' THEN 'easy' ELSE 'unknown' END AS rating
        FROM {events}
    """,
    "jobs": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS id, o_orderpriority AS job_type, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status,
               o_orderdate AS created_at, CAST(o_custkey AS VARCHAR(20)) AS target_id, o_orderkey AS number
        FROM {orders}
    """,
    "attempts": "SELECT CAST(l_orderkey AS VARCHAR(20)) AS job_id, l_linenumber AS seq, l_shipdate AS ts, l_returnflag AS outcome FROM {lineitem}",
    "repositories": """
        SELECT concat(p_name, '/', CAST(p_partkey AS VARCHAR(20))) AS full_name, p_brand AS primary_language, CAST(p_size AS BIGINT) AS stars,
               p_type AS description, {minutes:p_partkey % 500000} AS pushed_at
        FROM {part}
    """,
    "messages": "SELECT CAST(conv_id AS VARCHAR(20)) AS conversation_id, turn, role, text FROM {conversations}",
    "notes": """
        SELECT CAST(conv_id AS VARCHAR(20)) AS target_id, turn, text AS note_text, {minutes:conv_id * 10 + turn} AS updated_at
        FROM {conversations} WHERE role = 'user'
    """,
}


def _minutes(text: str, form: str) -> str:
    return re.sub(r"\{minutes:([^}]*)\}", lambda m: form.format(m[1]), text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Library:
    """The tables of one folder by name, physical and logical."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self._schemas: dict[str, StructType] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:  # read anew each time, but for the schema, which costs a job
            if name not in self._schemas:
                self._schemas[name] = table(self.spark, self.sf_dir, name).schema
            return self.spark.read.schema(self._schemas[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in LOGICAL:
            raise AttributeError(name)
        if name not in self._made:
            text = _minutes(LOGICAL[name], "(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST({} AS INT), 0))").replace("{all}", "")
            text = text.replace("\t", "\\t").replace("\f", "\\f").replace("\r", "\\r").replace("[ \\t\n", "[ \\t\\n")
            self._made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})
        return self._made[name]


def ctes(*names: str) -> str:
    """The bindings of these logical tables, and of those that they need, as a WITH."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in re.findall(r"\{(\w+)\}", LOGICAL[name]):
            if n in LOGICAL:
                visit(n)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        text = _minutes(LOGICAL[n], "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({} AS INTEGER)))").replace("{all}", ", 'g'")
        parts.append(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', text)})")
    return ", ".join(parts)
