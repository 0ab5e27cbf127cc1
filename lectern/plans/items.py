"""What is attached to items: tags, folders, states; and upkeep of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import hierarchy, identity, maintenance, organize
from lectern.plans.registry import query
from lectern.sources.library import Library

KEYS = ["target_type", "target_id"]


@query("scan_content", "SELECT target_type, target_id, title, category, summary FROM content", ("content",))
def scan_content(lib: Library) -> DataFrame:
    return lib.content.drop("updated_at")


@query("category_counts", "SELECT target_type, category, count(*) AS items FROM content GROUP BY ROLLUP (target_type, category) HAVING target_type IS NOT NULL", ("content",))
def category_counts(lib: Library) -> DataFrame:
    return organize.category_counts(lib.content)


@query("list_by_category", "SELECT target_type, target_id, CAST(updated_at AS VARCHAR) AS updated_at FROM content WHERE category = 'src3' ORDER BY content.updated_at DESC, target_type, target_id LIMIT 25", ("content",))
def list_by_category(lib: Library) -> DataFrame:
    return organize.newest(lib.content, 25, "src3").select(*KEYS, "updated_at")


@query("semi_tag", "SELECT target_type, target_id, title FROM content WHERE (target_type, target_id) IN (SELECT (target_type, target_id) FROM content_tags WHERE tag_name = 'quality:0')", ("content", "content_tags"))
def semi_tag(lib: Library) -> DataFrame:
    return organize.with_tag(lib.content, lib.content_tags, "quality:0").select(*KEYS, "title")


@query(
    "semi_folder",
    """, RECURSIVE below AS (SELECT id FROM folders WHERE id = 'r1' UNION ALL SELECT f.id FROM folders f JOIN below b ON f.parent_id = b.id)
    SELECT target_type, target_id FROM content WHERE (target_type, target_id) IN (SELECT (target_type, target_id) FROM content_folders WHERE folder_id IN (SELECT id FROM below))""".replace(", RECURSIVE below", ", below"),
    ("content", "content_folders", "folders"),
)
def semi_folder(lib: Library) -> DataFrame:
    below = hierarchy.folder_closure(lib.folders).where("ancestor = 'r1'").select(F.col("descendant").alias("folder_id"))
    return organize.in_folder(lib.content, lib.content_folders, below).select(*KEYS)


@query("flag_favorite", "SELECT target_type, target_id, (target_type, target_id) IN (SELECT (target_type, target_id) FROM favorites) AS favorite FROM content", ("content", "favorites"))
def flag_favorite(lib: Library) -> DataFrame:
    return organize.flag_favorite(lib.content, lib.favorites).select(*KEYS, "favorite")


@query("polymorphic_lookup", "SELECT owner_id, target_type, target_id, title, progress FROM reading_states JOIN content USING (target_type, target_id) WHERE title IS NOT NULL", ("reading_states", "content"))
def polymorphic_lookup(lib: Library) -> DataFrame:
    return organize.polymorphic_lookup(lib.reading_states, lib.content).select("owner_id", *KEYS, "title", "progress")


@query("anti_unfiled", "SELECT target_type, target_id FROM content WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM content_folders)", ("content", "content_folders"))
def anti_unfiled(lib: Library) -> DataFrame:
    return organize.unfiled(lib.content, lib.content_folders).select(*KEYS)


@query("auto_file_unfiled", "SELECT target_type, target_id, concat('inbox/', category) AS folder_id FROM content WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM content_folders)", ("content", "content_folders"))
def auto_file_unfiled(lib: Library) -> DataFrame:
    return organize.auto_file(lib.content, lib.content_folders)


@query("tag_counts", "SELECT tag_name, count(*) AS items FROM content_tags GROUP BY tag_name", ("content_tags",))
def tag_counts(lib: Library) -> DataFrame:
    return organize.tag_counts(lib.content_tags)


@query("page_tags", "SELECT target_type, target_id, string_agg(DISTINCT tag_name, ',' ORDER BY tag_name) AS tags FROM content JOIN content_tags USING (target_type, target_id) GROUP BY ALL", ("content", "content_tags"))
def page_tags(lib: Library) -> DataFrame:
    return organize.page_tags(lib.content, lib.content_tags)


@query(
    "content_organization",
    """SELECT target_type, target_id, coalesce((SELECT string_agg(DISTINCT tag_name, ',' ORDER BY tag_name) FROM content_tags t WHERE t.target_type = c.target_type AND t.target_id = c.target_id), '') AS tags,
    coalesce((SELECT string_agg(DISTINCT folder_id, ',' ORDER BY folder_id) FROM content_folders t WHERE t.target_type = c.target_type AND t.target_id = c.target_id), '') AS folders FROM content c""",
    ("content", "content_tags", "content_folders"),
)
def content_organization(lib: Library) -> DataFrame:
    return organize.content_organization(lib.content, lib.content_tags, lib.content_folders)


@query("tenant_visible", "SELECT coalesce(CAST(owner_id AS VARCHAR), 'public') AS owner, count(*) AS rows FROM (SELECT CASE WHEN owner_id % 3 = 0 THEN NULL ELSE owner_id END AS owner_id FROM reading_states) WHERE owner_id IS NULL OR owner_id = 7 GROUP BY owner_id", ("reading_states",))
def tenant_visible(lib: Library) -> DataFrame:
    rows = lib.reading_states.withColumn("owner_id", F.when(F.col("owner_id") % 3 != 0, F.col("owner_id")))
    return organize.tenant_visible(rows, 7).groupBy(F.coalesce(F.col("owner_id").cast("string"), F.lit("public")).alias("owner")).agg(F.count("*").alias("rows"))


@query(
    "page_clamped",
    """, n AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, target_type, target_id) AS place, CAST(ceil(count(*) OVER () / 24.0) AS INTEGER) AS pages FROM content)
    SELECT place, target_type, target_id, pages AS page, pages FROM n WHERE place > (pages - 1) * 24""",
    ("content",),
)
def page_clamped(lib: Library) -> DataFrame:
    return organize.page_clamped(lib.content, [("updated_at", False), ("target_type", True), ("target_id", True)], 24, 10_000_000).select("place", *KEYS, "page", "pages")


@query("page_after_key", "SELECT target_type, target_id, category FROM content WHERE (category, target_type, target_id) > ('src3', 'document', '5') ORDER BY category, target_type, target_id LIMIT 40", ("content",))
def page_after_key(lib: Library) -> DataFrame:
    return organize.after_key(lib.content, ["category", *KEYS], ("src3", "document", "5"), 40).select(*KEYS, "category")


@query("topk_per_group", "SELECT category, target_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY updated_at DESC, target_id) AS rank FROM content) WHERE rank <= 3", ("content",))
def topk_per_group(lib: Library) -> DataFrame:
    return organize.top_per_group(lib.content, ["category"], [F.col("updated_at").desc(), "target_id"], 3).select("category", "target_id", "rank")


@query(
    "history_tail",
    """, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS back FROM messages)
    SELECT conversation_id, turn, role, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS INTEGER) AS place FROM b WHERE back <= 2""",
    ("messages",),
)
def history_tail(lib: Library) -> DataFrame:
    return organize.history_tail(lib.messages, 2).select("conversation_id", "turn", "role", "place")


@query("sort_stable", "SELECT id, lower(name) AS folded, name FROM folders ORDER BY folders.sort_order DESC, folded, id LIMIT 60", ("folders",))
def sort_stable(lib: Library) -> DataFrame:
    return lib.folders.orderBy(F.col("sort_order").desc(), F.lower("name"), "id").limit(60).select("id", F.lower("name").alias("folded"), "name")


@query("list_repositories", "SELECT full_name, stars FROM repositories WHERE contains(lower(concat_ws(' ', full_name, description, primary_language)), 'small') AND contains(lower(concat_ws(' ', full_name, description, primary_language)), 'brand#2')", ("repositories",))
def list_repositories(lib: Library) -> DataFrame:
    return organize.list_repositories(lib.repositories, "small Brand#2").select("full_name", "stars")


@query("repository_statistics", "SELECT primary_language, count(*) AS repositories, CAST(sum(stars) AS BIGINT) AS stars, arg_max(full_name, (stars, full_name)) AS most_starred FROM repositories GROUP BY primary_language", ("repositories",))
def repository_statistics(lib: Library) -> DataFrame:
    return organize.repository_statistics(lib.repositories)


TREE = "tree AS (SELECT id, 1 AS depth, name AS path FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.id, t.depth + 1, concat(t.path, '/', f.name) FROM folders f JOIN tree t ON f.parent_id = t.id)"
CLOSURE = "closure AS (SELECT id AS ancestor, id AS descendant, 0 AS distance FROM folders UNION ALL SELECT c.ancestor, f.id, c.distance + 1 FROM closure c JOIN folders f ON f.parent_id = c.descendant)"


@query("folder_paths", f", {TREE} SELECT id, depth, path FROM tree", ("folders",))
def folder_paths(lib: Library) -> DataFrame:
    return hierarchy.folder_paths(lib.folders)


@query("folder_closure", f", {CLOSURE} SELECT ancestor, descendant, distance FROM closure", ("folders",))
def folder_closure(lib: Library) -> DataFrame:
    return hierarchy.folder_closure(lib.folders)


@query(
    "folder_rollup",
    f""", {CLOSURE}, d AS (SELECT folder_id, count(*) AS n FROM content_folders GROUP BY 1)
    SELECT f.id, coalesce((SELECT n FROM d WHERE folder_id = f.id), 0) AS direct, CAST(coalesce((SELECT sum(n) FROM d JOIN closure ON descendant = folder_id WHERE ancestor = f.id), 0) AS BIGINT) AS below,
           (SELECT count(*) FROM folders c WHERE c.parent_id = f.id) AS children FROM folders f""",
    ("folders", "content_folders"),
)
def folder_rollup(lib: Library) -> DataFrame:
    return hierarchy.folder_rollup(lib.folders, lib.content_folders)


@query(
    "folder_two_levels",
    f""", {TREE}, {CLOSURE}, d AS (SELECT folder_id, count(*) AS n FROM content_folders GROUP BY 1)
    SELECT path, depth, CAST(coalesce((SELECT sum(n) FROM d JOIN closure ON descendant = folder_id WHERE ancestor = t.id), 0) AS BIGINT) AS items FROM tree t WHERE depth <= 2
    UNION ALL SELECT '(none)', 0, count(*) FROM content WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM content_folders)""",
    ("folders", "content_folders", "content"),
)
def folder_two_levels(lib: Library) -> DataFrame:
    return hierarchy.folder_two_levels(lib.folders, lib.content_folders, lib.content)


@query("sibling_name_conflicts", "SELECT coalesce(parent_id, '') AS parent_id, lower(name) AS name, count(*) AS n FROM (SELECT parent_id, substr(name, 1, 8) AS name FROM folders) GROUP BY ALL HAVING count(*) > 1", ("folders",))
def sibling_name_conflicts(lib: Library) -> DataFrame:
    return hierarchy.sibling_name_conflicts(lib.folders.withColumn("name", F.substring("name", 1, 8)))


@query("empty_folders", "SELECT id FROM folders WHERE id NOT IN (SELECT parent_id FROM folders WHERE parent_id IS NOT NULL) AND id NOT IN (SELECT folder_id FROM content_folders)", ("folders", "content_folders"))
def empty_folders(lib: Library) -> DataFrame:
    return hierarchy.empty_folders(lib.folders, lib.content_folders)


@query(
    "ensure_paths",
    f""", {TREE}, w AS (SELECT DISTINCT split_part(source, 'c', 2) AS a, lang AS b FROM documents), p AS (SELECT concat('AFRICA/', a) AS path, 2 AS depth FROM w UNION SELECT concat('AFRICA/', a, '/', b), 3 FROM w)
    SELECT path, depth FROM p WHERE path NOT IN (SELECT path FROM tree)""",
    ("folders",),
)
def ensure_paths(lib: Library) -> DataFrame:
    wanted = lib.documents.select(F.concat(F.lit("AFRICA / "), F.split_part("source", F.lit("c"), F.lit(2)), F.lit("/"), F.col("lang")).alias("path"))
    return hierarchy.ensure_paths(lib.folders, wanted)


@query("upsert_keep_first", "SELECT target_id, tag_name FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY tag_name) AS n FROM content_tags) WHERE n = 1", ("content_tags",))
def upsert_keep_first(lib: Library) -> DataFrame:
    rows = lib.content_tags.select("target_id", "tag_name")
    return maintenance.upsert_keep_first(rows.where("tag_name = 'none'"), rows, ["target_id"], ["tag_name"])


@query("upsert_last_wins", "SELECT owner_id, target_id, CAST(max(ts) AS VARCHAR) AS ts, arg_max(value, (ts, seq)) AS value FROM ticks GROUP BY ALL", ("ticks",))
def upsert_last_wins(lib: Library) -> DataFrame:
    return maintenance.upsert_last_wins(lib.ticks, ["owner_id", "target_id"], ["ts", "seq"]).select("owner_id", "target_id", "ts", "value")


@query(
    "upsert_articles",
    """, o AS (SELECT id, title, sha256(body) AS body, concat('t', id) AS translation FROM library_articles WHERE number % 3 <> 0),
    n AS (SELECT id, CASE WHEN number % 5 = 0 THEN '' ELSE concat(title, '!') END AS title, CASE WHEN number % 2 = 0 THEN sha256(body) ELSE 'new' END AS body FROM library_articles WHERE number % 4 <> 1)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.title WHEN n.id IS NULL THEN o.title WHEN trim(n.title) <> '' THEN n.title ELSE o.title END AS title,
           CASE WHEN n.id IS NULL THEN o.body ELSE n.body END AS body,
           CASE WHEN n.id IS NULL OR o.body = n.body THEN o.translation END AS translation
    FROM o FULL JOIN n ON o.id = n.id""",
    ("library_articles",),
)
def upsert_articles(lib: Library) -> DataFrame:
    rows = lib.library_articles
    old = rows.where("number % 3 <> 0").select("id", "title", F.sha2("body", 256).alias("body"), F.struct(F.sha2("body", 256).alias("of"), F.concat(F.lit("t"), "id").alias("text")).alias("translation"))
    new = rows.where("number % 4 <> 1").select("id", F.when(F.col("number") % 5 == 0, "").otherwise(F.concat("title", F.lit("!"))).alias("title"), F.when(F.col("number") % 2 == 0, F.sha2("body", 256)).otherwise("new").alias("body"))
    new = new.withColumn("translation", F.struct(F.col("body").alias("of"), F.lit(None).cast("string").alias("text")))
    kept = lambda was, now: F.when(was["of"] == now["of"], was).otherwise(now)  # noqa: E731  a new body drops its translation
    merged = maintenance.upsert_by_policy(old, new, ["id"], {"title": maintenance.nonblank, "body": maintenance.replace, "translation": kept})
    return merged.select("id", "title", "body", F.col("translation.text").alias("translation"))


@query(
    "batch_assign_folder",
    """, b AS (SELECT target_type, target_id, arg_max(folder_id, (o, folder_id)) AS folder_id FROM (SELECT target_type, target_id, 'n1' AS folder_id, 1 AS o FROM favorites UNION ALL SELECT target_type, target_id, 'n2', 2 FROM favorites) GROUP BY ALL),
    ok AS (SELECT * FROM b WHERE (SELECT count(*) FROM b WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM content)) = 0)
    SELECT * FROM ok UNION ALL SELECT target_type, target_id, folder_id FROM content_folders WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM ok)""",
    ("favorites", "content_folders", "content"),
)
def batch_assign_folder(lib: Library) -> DataFrame:
    wanted = lib.favorites.withColumns({"folder_id": F.lit("n1"), "o": F.lit(1)}).unionByName(lib.favorites.withColumns({"folder_id": F.lit("n2"), "o": F.lit(2)}))
    return maintenance.batch_assign(lib.content_folders, wanted, lib.content, KEYS, ["o", "folder_id"])


@query(
    "erase_targets",
    """, e AS (SELECT target_type, target_id FROM content WHERE category IN ('src1', 'web'))
    SELECT 'tags' AS part, count(*) AS rows FROM content_tags WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM e)
    UNION ALL SELECT 'folders', count(*) FROM content_folders WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM e)
    UNION ALL SELECT 'states', count(*) FROM reading_states WHERE (target_type, target_id) NOT IN (SELECT (target_type, target_id) FROM e)""",
    ("content", "content_tags", "content_folders", "reading_states"),
)
def erase_targets(lib: Library) -> DataFrame:
    left = maintenance.erase_targets({"tags": lib.content_tags, "folders": lib.content_folders, "states": lib.reading_states}, lib.content.where("category IN ('src1', 'web')"), KEYS)
    counts = [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows") for name, rows in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("reclaimable_files", "SELECT DISTINCT sha256(body) AS path FROM library_documents WHERE number % 2 = 1 AND sha256(body) NOT IN (SELECT sha256(body) FROM library_documents WHERE number % 2 = 0)", ("library_documents",))
def reclaimable_files(lib: Library) -> DataFrame:
    files = lib.library_documents.select("number", F.sha2("body", 256).alias("path"))
    return maintenance.reclaimable_files(files.where("number % 2 = 1").select("path").distinct(), files.where("number % 2 = 0"))


@query("expire_snapshots", "SELECT kind, path FROM (SELECT job_type AS kind, id AS path, created_at, row_number() OVER (PARTITION BY job_type ORDER BY created_at DESC, id) AS n FROM jobs) WHERE n > 1 AND created_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 30 DAY", ("jobs",))
def expire_snapshots(lib: Library) -> DataFrame:
    rows = lib.jobs.select(F.col("job_type").alias("kind"), F.col("id").alias("path"), F.col("created_at").alias("made_at"))
    return maintenance.expired(rows, "1998-01-01 00:00:00", 30).select("kind", "path")


@query(
    "asset_reference_check",
    """, r AS (SELECT id AS path, sha256(body) AS sha256, length(body) AS size, number FROM library_documents),
    m AS (SELECT path, CASE WHEN number % 13 = 0 THEN 'x' ELSE sha256 END AS sha256, CASE WHEN number % 17 = 0 THEN -1 ELSE size END AS size FROM r WHERE number % 7 <> 0)
    SELECT path, CASE WHEN m.sha256 IS NULL THEN 'missing' WHEN m.sha256 <> r.sha256 THEN 'hash' WHEN m.size <> r.size THEN 'size' END AS problem FROM r LEFT JOIN m USING (path)
    WHERE m.sha256 IS NULL OR m.sha256 <> r.sha256 OR m.size <> r.size""",
    ("library_documents",),
)
def asset_reference_check(lib: Library) -> DataFrame:
    rows = lib.library_documents.select(F.col("id").alias("path"), F.sha2("body", 256).alias("sha256"), F.length("body").alias("size"), "number")
    manifest = rows.where("number % 7 <> 0").select("path", F.when(F.col("number") % 13 == 0, "x").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("number") % 17 == 0, -1).otherwise(F.col("size")).alias("size"))
    return maintenance.asset_reference_check(rows, manifest)


@query(
    "duplicate_documents",
    r""", n AS (SELECT id, sha256(body) AS digest, regexp_replace(lower(title), '[\s\p{P}\p{S}]+', '', 'g') AS key, number, updated_at FROM library_documents),
    t AS (SELECT a.id, 'content' AS reason, arg_min(b.id, (b.updated_at, b.id)) AS match_id FROM n a JOIN n b USING (digest) WHERE a.number % 2 = 1 AND b.number % 2 = 0 GROUP BY a.id),
    k AS (SELECT a.id, 'title' AS reason, arg_min(b.id, (b.updated_at, b.id)) AS match_id FROM n a JOIN n b USING (key) WHERE a.number % 2 = 1 AND b.number % 2 = 0 AND key <> '' GROUP BY a.id)
    SELECT * FROM t UNION ALL SELECT * FROM k WHERE id NOT IN (SELECT id FROM t)""",
    ("library_documents",),
)
def duplicate_documents(lib: Library) -> DataFrame:
    return identity.duplicates(lib.library_documents.where("number % 2 = 1"), lib.library_documents.where("number % 2 = 0"))


@query("identity_duplicate_groups", ", g AS (SELECT id, sha256(body) AS digest FROM library_documents) SELECT * FROM (SELECT digest, id, count(*) OVER w AS n, min(id) OVER w AS first_id FROM g WINDOW w AS (PARTITION BY digest)) WHERE n > 1", ("library_documents",))
def identity_duplicate_groups(lib: Library) -> DataFrame:
    return identity.identity_groups(lib.library_documents.withColumn("digest", F.sha2("body", 256)), "digest")


@query(
    "public_url_filter",
    r"""SELECT id, regexp_matches(url, '^https?://[^/?#:@]+(:[0-9]+)?([/?#]|$)') AS public FROM library_articles""",
    ("library_articles",),
)
def public_url_filter(lib: Library) -> DataFrame:
    return lib.library_articles.select("id", identity.public_url(F.col("url")).alias("public"))
