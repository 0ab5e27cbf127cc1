"""Exact duplicates by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of characters. Distinct
blocks are sorted and numbered; the number is the block's name. Then the names of
adjacent blocks are paired and the distinct pairs are sorted and numbered, again
and again, until each text has one name. Texts are equal exactly if they were cut
into as many blocks and end with the same name.

Texts cross the network once, as blocks that have been reduced to one of a kind by
each task; everything later moves integers. Blocks are sorted by a 64-bit key first
and by content only where a key covers more than one content: min and max of the
content under a key tell. Those few keys are resolved by content, so that a
collision costs time but never merges two texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import fresh, settle

#: Characters of a block, and rows of a bucket in which names are numbered.
BLOCK_CHARS, BUCKET_ROWS = 4096, 100_000
#: The characters that don't count.
BLANKS = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def numbered(distinct: DataFrame, keys: list[str], bucket_rows: int) -> DataFrame:
    """Adds `name`: the rank of each row in the order of (bucket of the keys, keys).
    Ranks are taken within buckets, whose number follows that of the rows; the buckets'
    sizes, a row each, give what to add."""
    distinct = settle(distinct, "distinct")
    buckets = max(64, -(-distinct.count() // bucket_rows))
    rows = distinct.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    ahead = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("ahead"))
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)))
    return local.join(F.broadcast(ahead), "bucket").withColumn("name", F.col("rank") + F.col("ahead")).drop("bucket", "rank", "ahead")


def named_blocks(blocks: DataFrame, bucket_rows: int) -> DataFrame:
    """blocks(key, block, ...) with `name` in place of both."""
    spread = blocks.groupBy("key").agg(F.min("block").alias("least"), F.max("block").alias("most"))
    kinds = settle(spread.select("key", (F.col("least") != F.col("most")).alias("mixed")), "kinds")
    names = settle(numbered(kinds.where("not mixed").select("key"), ["key"], bucket_rows), "names")
    plain = blocks.drop("block").join(names, "key").drop("key")
    if not kinds.where("mixed").limit(1).count():
        return plain
    shared = kinds.where("mixed").select("key")
    contents = blocks.join(shared, "key", "left_semi")
    more = settle(numbered(contents.select("key", "block").distinct(), ["key", "block"], bucket_rows), "mixed")
    return plain.unionByName(contents.join(more.withColumn("name", -F.col("name")), ["key", "block"]).drop("key", "block"))


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, bucket_rows: int = BUCKET_ROWS, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, chars (code points of the original text),
    text_sha256 (of the normalised text), level and name. Two rows have equal level
    and name exactly if their normalised texts are equal. level is the number of
    blocks; key is the function that blocks are first sorted by."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("chars"), normalised(F.col(text)).alias("body"))
    rows = rows.withColumn("level", F.greatest(F.lit(1), F.ceil(F.length("body") / block_chars)).cast("long")).withColumn("text_sha256", F.sha2("body", 256))
    # a pattern walks a long text once, where substrings would each begin at its start
    cut = F.when(F.col("level") == 1, F.array("body")).otherwise(F.regexp_extract_all("body", F.lit("(?s).{1,%d}" % block_chars), F.lit(0)))
    blocks = rows.select("doc_id", "chars", "text_sha256", "level", F.posexplode(cut).alias("pos", "block"))
    named = settle(named_blocks(blocks.withColumn("key", key(F.col("block"))), bucket_rows), "blocks")
    done, open_ = named.where("level = 1").drop("pos"), named.where("level > 1").withColumn("copies", F.lit(1).cast("long"))
    own = ["doc_id", "chars", "text_sha256", "level"]
    out = [done.withColumn("copies", F.lit(1).cast("long"))]
    longest = open_.agg(F.max("level")).first()[0] or 0
    width = 1
    while width < longest:
        # rows that agree in all that is known of them are equal, so they can be counted as one
        paired = open_.groupBy(*own, F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"), F.sum(F.when(F.col("pos") % 2 == 0, F.col("copies"))).alias("copies")
        )
        paired = settle(paired, "pairs")
        names = settle(numbered(paired.select("left", "right").distinct(), ["left", "right"], bucket_rows), "names")
        named = settle(paired.join(names, ["left", "right"]).drop("left", "right"), "named")
        width *= 2
        out.append(named.where(F.col("level") <= width).drop("pos"))
        open_ = named.where(F.col("level") > width)
    whole = out[0].select(*own, "name", "copies")
    for x in out[1:]:
        whole = whole.unionByName(x.select(*own, "name", "copies"))
    return whole


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, chars.

    Of equal texts the row with the most code points stays, then that with the
    smallest id; a null id comes after all others. Null text is empty. Of rows that
    repeat an id and a length within a group, one stays. Other columns are left out;
    an empty table gives no rows."""
    rows = identities(docs, doc_id, text, **how).groupBy("level", "name", "text_sha256", "doc_id", "chars").agg(F.sum("copies").alias("copies"))
    rows = settle(rows, "rows")
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("doc_id"))
    groups = settle(rows.groupBy("level", "name").agg(F.min(best).alias("best"), F.sum("copies").alias("group_size")), "groups")
    joined = rows.join(groups, ["level", "name"])
    first = (F.col("best.chars") == -F.col("chars")) & F.col("best.doc_id").eqNullSafe(F.col("doc_id"))
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", first.alias("first"), "text_sha256", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "chars").select(
        "doc_id", "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "chars"
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, whole."""
    found = settle(exact_duplicates(docs, doc_id, text, **how), "copies")
    stay = found.where("kept").select(F.struct("doc_id", "text_sha256", "chars").alias("stays"))
    mark = fresh(docs, "mark")
    own = F.struct(F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256"), F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("chars"))
    rows = docs.withColumn(mark, own)
    kept = rows.join(stay, rows[mark].eqNullSafe(stay["stays"]), "left_semi")
    if found.groupBy("doc_id", "text_sha256", "chars").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([mark])
    return kept.drop(mark)
