"""Search, retrieval and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fold
from lectern.operators import retrieval, search
from lectern.plans.registry import query
from lectern.sources.library import Library

WORD, WORDS, TERMS = "token", "that the", ["tion", "anth"]
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sources(lib: Library) -> list:
    return [(lib.library_documents, "document", ["title", "body"]), (lib.library_articles, "article", ["title", "text"]), (lib.library_papers, "paper", ["title", "body"])]


HITS = f"""
    hits AS (
      SELECT 'document' AS target_type, id AS target_id, CASE WHEN contains({FOLD.format("title")}, '{WORDS}') THEN 'title' ELSE 'body' END AS field
      FROM library_documents WHERE contains({FOLD.format("title")}, '{WORDS}') OR contains({FOLD.format("body")}, '{WORDS}')
      UNION ALL
      SELECT 'article', id, CASE WHEN contains({FOLD.format("title")}, '{WORDS}') THEN 'title' ELSE 'text' END
      FROM library_articles WHERE contains({FOLD.format("title")}, '{WORDS}') OR contains({FOLD.format("text")}, '{WORDS}')
      UNION ALL
      SELECT 'paper', id, CASE WHEN contains({FOLD.format("title")}, '{WORDS}') THEN 'title' ELSE 'body' END
      FROM library_papers WHERE contains({FOLD.format("title")}, '{WORDS}') OR contains({FOLD.format("body")}, '{WORDS}')
    )"""


ANNOTATED = f"""
    annotations AS (SELECT 'article' AS target_type, conversation_id AS target_id, turn, substr(text, 1, 60) AS quote_text, text AS note_text,
                           TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INTEGER)) AS updated_at FROM messages WHERE role <> 'user'),
    found AS (
      SELECT target_type, target_id, 0 AS source, field FROM hits
      UNION ALL
      SELECT 'document', target_id, 1, 'note_text' FROM notes WHERE contains({FOLD.format("note_text")}, '{WORDS}')
      UNION ALL
      SELECT target_type, target_id, 2, CASE WHEN contains({FOLD.format("quote_text")}, '{WORDS}') THEN 'quote_text' ELSE 'note_text' END
      FROM annotations WHERE contains({FOLD.format("note_text")}, '{WORDS}')
    ),
    one AS (SELECT target_type, target_id, min(source) AS source FROM found GROUP BY ALL),
    newest AS (SELECT target_type, target_id, 2 AS source, arg_max(CASE WHEN contains({FOLD.format("quote_text")}, '{WORDS}') THEN 'quote_text' ELSE 'note_text' END, (updated_at, CASE WHEN contains({FOLD.format("quote_text")}, '{WORDS}') THEN quote_text ELSE note_text END)) AS field
               FROM annotations WHERE contains({FOLD.format("note_text")}, '{WORDS}') GROUP BY target_type, target_id),
    told AS (SELECT o.target_type, o.target_id, CASE o.source WHEN 0 THEN h.field WHEN 1 THEN 'note_text' ELSE n.field END AS field
             FROM one o LEFT JOIN hits h USING (target_type, target_id) LEFT JOIN newest n USING (target_type, target_id))"""


def annotations(lib: Library) -> DataFrame:
    """What was answered, as remarks on articles."""
    said = lib.messages.where("role <> 'user'")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(turn AS INT), 0)")
    return said.select(F.lit("article").alias("target_type"), F.col("conversation_id").alias("target_id"), F.substring("text", 1, 60).alias("quote_text"), F.col("text").alias("note_text"), at.alias("updated_at"))


@query(
    "search_library",
    f""", {HITS}, {ANNOTATED}, placed AS (
      SELECT row_number() OVER (ORDER BY updated_at DESC, target_type, target_id) AS place, target_type, target_id, title, category, field, count(*) OVER () AS total
      FROM told JOIN content USING (target_type, target_id)
    )
    SELECT place, target_type, target_id, title, category, field, total, total > 70 AS has_more,
           coalesce((SELECT string_agg(DISTINCT tag_name, ',' ORDER BY tag_name) FROM content_tags t WHERE t.target_type = p.target_type AND t.target_id = p.target_id), '') AS tags,
           EXISTS (SELECT 1 FROM favorites f WHERE f.target_type = p.target_type AND f.target_id = p.target_id) AS favorite
    FROM placed p WHERE place > 20 AND place <= 70""",
    ("content", "content_tags", "favorites", "notes", "messages"),
)
def search_library(lib: Library) -> DataFrame:
    told = [(lib.notes.withColumn("target_type", F.lit("document")), ["note_text"]), (annotations(lib), ["quote_text", "note_text"])]
    return search.search_library(sources(lib), lib.content, lib.favorites, lib.content_tags, WORDS, limit=50, offset=20, notes=told).drop("excerpt")


@query("match_field", f""", {HITS} SELECT target_type, field, count(*) AS items FROM hits GROUP BY ALL""", ("content",))
def match_field(lib: Library) -> DataFrame:
    hits = None
    for items, kind, fields in sources(lib):
        found = search.hits_in(items, kind, fields, WORDS)
        hits = found if hits is None else hits.unionByName(found)
    return hits.groupBy("target_type", "field").agg(F.count("*").alias("items"))


@query(
    "match_excerpt",
    f""", l AS (SELECT id, trim(regexp_replace(body, '[ \t\n\r]+', ' ', 'g')) AS line FROM library_documents), h AS (SELECT *, strpos({FOLD.format("line")}, '{WORD}') AS spot FROM l)
    SELECT id, concat(CASE WHEN spot > 56 THEN '…' ELSE '' END, substr(line, greatest(spot - 55, 1), 220), CASE WHEN greatest(spot - 55, 1) + 219 < length(line) THEN '…' ELSE '' END) AS excerpt
    FROM h WHERE spot > 0""",
    ("library_documents",),
)
def match_excerpt(lib: Library) -> DataFrame:
    return search.hits_in(lib.library_documents, "document", ["body"], WORD).select(F.col("target_id").alias("id"), "excerpt").where("excerpt IS NOT NULL")


TOKENS = f"""
    t AS (SELECT id, unnest(list_filter(regexp_split_to_array({FOLD.format("body")}, '[^a-z0-9]+'), lambda x: x <> '')) AS token,
                 len(list_filter(regexp_split_to_array({FOLD.format("body")}, '[^a-z0-9]+'), lambda x: x <> '')) AS size FROM library_documents)"""


@query(
    "prefix_search",
    f""", w AS (SELECT id, updated_at, list_filter(regexp_split_to_array({FOLD.format("concat_ws(' ', title, body)")}, '[^a-z0-9]+'), lambda x: x <> '') AS words FROM library_documents),
    c AS (SELECT id, updated_at, len(words) AS size, len(list_filter(words, lambda x: starts_with(x, '{TERMS[0]}'))) AS tf0, len(list_filter(words, lambda x: starts_with(x, '{TERMS[1]}'))) AS tf1 FROM w),
    t AS (SELECT count(*) AS items, avg(size) AS mean, count(*) FILTER (WHERE tf0 > 0) AS df0, count(*) FILTER (WHERE tf1 > 0) AS df1 FROM c),
    s AS (SELECT id, updated_at, round(ln((items - df0 + 0.5) / (df0 + 0.5) + 1) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * size / mean)) + ln((items - df1 + 0.5) / (df1 + 0.5) + 1) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score
          FROM c, t WHERE tf0 > 0 AND tf1 > 0)
    SELECT id, score FROM s ORDER BY score DESC, updated_at DESC, id LIMIT 20""",
    ("library_documents",),
)
def prefix_search(lib: Library) -> DataFrame:
    return search.prefix_search(lib.library_documents, ["title", "body"], TERMS)


@query(
    "scored_search",
    f""", s AS (
      SELECT id, title, updated_at, CASE WHEN {FOLD.format("title")} = 'then' THEN 100 WHEN starts_with({FOLD.format("title")}, 'then') THEN 80
             WHEN contains({FOLD.format("title")}, 'then') THEN 60 WHEN contains({FOLD.format("body")}, 'then') THEN 20 END AS score FROM library_documents
    ) SELECT id, title, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, updated_at DESC, id LIMIT 80""",
    ("library_documents",),
)
def scored_search(lib: Library) -> DataFrame:
    return search.scored_search(lib.library_documents, "then")


@query(
    "search_conversations",
    f"""SELECT conversation_id, count(*) AS messages, substr(arg_min(text, turn) FILTER (WHERE role = 'user'), 1, 80) AS title, substr(arg_max(text, turn), 1, 80) AS last
    FROM messages WHERE conversation_id IN (SELECT conversation_id FROM messages WHERE contains({FOLD.format("text")}, 'ention')) GROUP BY conversation_id""",
    ("messages",),
)
def search_conversations(lib: Library) -> DataFrame:
    return search.search_conversations(lib.messages, "ention")


@query(
    "token_counts",
    f""", {TOKENS} SELECT token, count(*) AS n, count(DISTINCT id) AS items FROM t GROUP BY token HAVING count(*) >= 20""",
    ("library_documents",),
)
def token_counts(lib: Library) -> DataFrame:
    return search.tokens(lib.library_documents, "body").groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("items")).where("n >= 20")


CHUNKS = """
    c AS (SELECT id, unnest(range(0, greatest(length(body), 1), 1080)) AS start, body FROM library_documents WHERE body <> ''),
    chunks AS (SELECT concat(id, '-C', CAST(start // 1080 + 1 AS VARCHAR)) AS chunk_id, id, start, substr(body, start + 1, 1200) AS text FROM c WHERE length(substr(body, start + 1, 1200)) >= 40 OR start = 0)"""


@query("chunk_fixed", f", {CHUNKS} SELECT chunk_id, id, start, sha256(text) AS digest FROM chunks", ("library_documents",))
def chunk_fixed(lib: Library) -> DataFrame:
    return retrieval.chunk_fixed(lib.library_documents).select("chunk_id", "id", "start", F.sha2("text", 256).alias("digest"))


TITLED = f"titled AS (SELECT c.*, lower(coalesce(d.title, '')) AS head, concat(lower(coalesce(d.title, '')), chr(10), lower(text)) AS whole FROM chunks c JOIN library_documents d USING (id))"


def titled(lib: Library) -> DataFrame:
    return retrieval.chunk_fixed(lib.library_documents).join(lib.library_documents.select("id", "title"), "id")


def points(*terms: str) -> str:
    return " + ".join(f"CASE WHEN contains(whole, '{t}') THEN {min(len(t), 6)} + CASE WHEN contains(head, '{t}') THEN 5 ELSE 0 END ELSE 0 END" for t in terms)


@query("score_chunks", f""", {CHUNKS}, {TITLED} SELECT chunk_id, CAST({points("ention", "ing", "theatre", "the")} AS BIGINT) AS score FROM titled""", ("library_documents",))
def score_chunks(lib: Library) -> DataFrame:
    return retrieval.score_chunks(titled(lib), ["ention", "ing", "theatre", "the"]).select("chunk_id", "score")


@query(
    "select_chunks",
    f""", {CHUNKS}, {TITLED}, s AS (SELECT *, CAST({points("ention", "ing")} AS BIGINT) AS score FROM titled),
    f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, start) <= 2 AS first FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY score DESC, start, id) AS place FROM f WHERE NOT first)
    SELECT chunk_id, first, score FROM f WHERE first UNION ALL SELECT chunk_id, first, score FROM o WHERE place <= 18 - (SELECT count(*) FROM f WHERE first)""",
    ("library_documents",),
)
def select_chunks(lib: Library) -> DataFrame:
    scored = retrieval.score_chunks(titled(lib), ["ention", "ing"])
    return retrieval.select_chunks(scored, per_source=2).select("chunk_id", "first", "score")


@query(
    "query_terms",
    """, q AS (SELECT id, lower(concat(body, ' v1.5+ 3.14 检索增强生成 模型')) AS t FROM library_papers),
    latin AS (SELECT id, t, regexp_extract_all(t, '[a-z][a-z0-9_.+-]+|[0-9]+(\\.[0-9]+)?') AS terms FROM q),
    every AS (SELECT id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM latin
              UNION ALL SELECT id, h.term, 1000000 + h.pos FROM q, (VALUES ('检索增强', 1), ('索增强生', 2), ('增强生成', 3), ('检索增', 4), ('索增强', 5), ('增强生', 6), ('强生成', 7), ('检索', 8), ('索增', 9), ('增强', 10), ('强生', 11), ('生成', 12), ('模型', 13)) h(term, pos)),
    firsts AS (SELECT id, term, min(pos) AS pos FROM every GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM firsts)
    SELECT id, string_agg(term, ' ' ORDER BY pos) AS terms FROM n WHERE k <= 80 GROUP BY id""",
    ("library_papers",),
)
def query_terms(lib: Library) -> DataFrame:
    return lib.library_papers.select("id", F.array_join(retrieval.query_terms(F.concat("body", F.lit(" v1.5+ 3.14 检索增强生成 模型"))), " ").alias("terms"))


CITED = """
    q AS (SELECT id AS answer_id, substr(body, 1, 30) AS quote FROM library_papers),
    cited AS (SELECT answer_id, concat(answer_id, '-C1') AS chunk_id, quote FROM q)"""


@query(
    "citation_join",
    f""", {CITED}, text_of AS (SELECT concat(id, '-C1') AS chunk_id, substr(body, 1, 1200) AS text FROM library_papers WHERE number % 3 <> 0)
    SELECT answer_id, chunk_id, quote FROM cited JOIN text_of USING (chunk_id)
    WHERE length(trim(regexp_replace(quote, '[ \t\n\r]+', ' ', 'g'))) >= 6
      AND contains(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), trim(regexp_replace(quote, '[ \t\n\r]+', ' ', 'g')))""",
    ("library_papers",),
)
def citation_join(lib: Library) -> DataFrame:
    cited = lib.library_papers.select(F.col("id").alias("answer_id"), F.concat("id", F.lit("-C1")).alias("chunk_id"), F.substring("body", 1, 30).alias("quote"))
    return retrieval.citation_join(cited, retrieval.chunk_fixed(lib.library_papers.where("number % 3 <> 0")))


@query(
    "insufficient_evidence",
    """SELECT id AS answer_id, CAST(number % 3 <> 0 AS BIGINT) AS citations, number % 3 = 0 AS insufficient FROM library_papers""",
    ("library_papers",),
)
def insufficient_evidence(lib: Library) -> DataFrame:
    cited = lib.library_papers.select(F.col("id").alias("answer_id"), F.concat("id", F.lit("-C1")).alias("chunk_id"), F.substring("body", 1, 30).alias("quote"))
    valid = retrieval.citation_join(cited, retrieval.chunk_fixed(lib.library_papers.where("number % 3 <> 0")))
    return retrieval.insufficient_evidence(cited, valid)


@query(
    "quoted_passages",
    """, q AS (SELECT id AS item_id, list_filter(regexp_split_to_array(body, '[ \t\n\r]+'), lambda x: x <> '') AS quote FROM library_papers),
    d AS (SELECT id, list_filter(regexp_split_to_array(body, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM library_documents),
    m AS (SELECT item_id, id, concat(' ', array_to_string(w, ' '), ' ') AS line, concat(' ', array_to_string(quote, ' '), ' ') AS said FROM q JOIN d ON contains(concat(' ', array_to_string(w, ' '), ' '), concat(' ', array_to_string(quote, ' '), ' ')))
    SELECT item_id, id, CAST(length(substr(line, 1, strpos(line, said))) - length(replace(substr(line, 1, strpos(line, said)), ' ', '')) AS BIGINT) AS at FROM m""",
    ("library_papers", "library_documents"),
)
def quoted_passages(lib: Library) -> DataFrame:
    return retrieval.quoted_passages(lib.library_papers.select(F.col("id").alias("item_id"), F.col("body").alias("text")), lib.library_documents)


@query("literal_contains", f"SELECT count(*) AS items, count(DISTINCT category) AS categories FROM library_documents WHERE contains({FOLD.format('body')}, '100% ') OR contains({FOLD.format('body')}, 'token = ')", ("library_documents",))
def literal_contains(lib: Library) -> DataFrame:
    text = fold(F.col("body"))
    return lib.library_documents.where(text.contains("100% ") | text.contains("token = ")).agg(F.count("*").alias("items"), F.count_distinct("category").alias("categories"))
