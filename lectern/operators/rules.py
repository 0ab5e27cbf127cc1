"""Rules that classify, rank and pick: keywords, candidates, curricula, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranks import ranked

from lectern.functions.text import collapse_blanks, fold


def classify_keywords(items: DataFrame, keywords: dict[str, list[str]], most: int = 120_000, key: str = "id") -> DataFrame:
    """items(id, title, body) -> category, confidence: occurrences of each category's
    keywords in title (twice) and body; the most wins, earlier categories on a tie. Without
    any, other at 0.2. The keywords are given, in the order of the categories."""
    text = fold(F.concat_ws(" ", "title", "title", F.substring("body", 1, most)))
    found = []
    for n, (name, words) in enumerate(keywords.items()):
        hits = F.lit(0)
        for w in words:
            hits = hits + F.regexp_count(text, F.lit("\\Q" + w.lower() + "\\E"))
        found.append(F.struct(hits.cast("long").alias("hits"), F.lit(-n).alias("order"), F.lit(name).alias("name")))
    rows = items.select(key, F.sort_array(F.array(*found), asc=False).alias("s"))
    first, second = F.col("s")[0], F.col("s")[1]
    sure = F.least(F.lit(0.95), F.lit(0.45) + 0.05 * first["hits"] + 0.05 * (first["hits"] - second["hits"]))
    return rows.select(key, F.when(first["hits"] > 0, first["name"]).otherwise("other").alias("category"), F.round(F.when(first["hits"] > 0, sure).otherwise(0.2), 2).alias("confidence"))


def domain_tags(items: DataFrame, keywords: list[str], most: int = 6, key: str = "id") -> DataFrame:
    """Distinct keywords that an item holds: their number, and the first as tags."""
    text = fold(F.concat_ws(" ", "title", "body"))
    present = F.filter(F.array(*map(F.lit, keywords)), lambda w: text.contains(w))
    return items.select(key, F.size(present).cast("long").alias("hits"), F.array_join(F.slice(present, 1, most), ",").alias("tags"))


def score_candidates(items: DataFrame, weights: list[tuple[str, int]], key: str = "id") -> DataFrame:
    """items with `score`: the weights of all patterns that title or body match."""
    text = fold(F.concat_ws(" ", "title", "body"))
    score = F.lit(0)
    for pattern, weight in weights:
        score = score + F.when(text.rlike(pattern), weight).otherwise(0)
    return items.withColumn("score", score.cast("long"))


def pick_candidate(scored: DataFrame, topic: str, order: list) -> DataFrame:
    """The best complete candidate of each topic."""
    best = Window.partitionBy(topic).orderBy(*order)
    return scored.where("score > 0").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def weekly_candidates(picked: DataFrame, week: Column, topic: str, least: int = 2) -> DataFrame:
    """Weeks for which `least` topics and more have a candidate."""
    return picked.groupBy(week.alias("week")).agg(F.count_distinct(topic).alias("topics"), F.count("*").alias("candidates")).where(F.col("topics") >= least)


def reminder_due(candidates: DataFrame, status: DataFrame) -> DataFrame:
    """Weeks whose candidates are all translated and whose status isn't done or snoozed."""
    ready = candidates.groupBy("week").agg(F.every("translated").alias("ready"), F.count("*").alias("candidates")).where("ready")
    return ready.join(status.where("status IN ('done', 'snoozed')"), "week", "left_anti").select("week", "candidates")


def card_curriculum(cards: DataFrame, domain: str, order: list[str], per_level: int = 20, levels: int = 5, series: int = 3) -> DataFrame:
    """Place, level and series of each card in its domain."""
    rows = ranked(cards, [domain], [F.col(c) for c in order], "sequence").withColumn("sequence", F.col("sequence").cast("int"))
    return rows.withColumn("level", F.least(F.lit(levels), (F.floor((F.col("sequence") - 1) / per_level) + 1).cast("int"))).withColumn("series", F.pmod(F.col("sequence") - 1, F.lit(series)).cast("int"))


def weighted_choice(keys: DataFrame, weights: list[tuple[str, int]], key: str) -> DataFrame:
    """A choice for each key, by weight: the key's hash picks a point of the cumulative
    weights, so that it is the same each time. Weights are 0 and more, their sum is over
    0."""
    total = sum(w for _, w in weights)
    if total <= 0 or min(w for _, w in weights) < 0:
        raise ValueError("weights must be 0 or more, and not all 0")
    point = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(total))
    choice, upto = None, 0
    for name, w in weights:
        upto += w
        if w:
            choice = (F.when if choice is None else choice.when)(point < upto, name)
    return keys.withColumn("choice", choice)


def important_files(files: DataFrame, pattern: str, most_bytes: int = 200_000, k: int = 5) -> DataFrame:
    """files(repository, path, bytes): of each repository the k shallowest that match."""
    depth = F.size(F.split("path", "/"))
    order = Window.partitionBy("repository").orderBy(depth, "path")
    rows = files.where(F.col("path").rlike(pattern) & (F.col("bytes") <= most_bytes))
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def valid_title(title: Column, most: int = 180) -> Column:
    """The title without control characters and double blanks; null if it is empty or too
    long."""
    clean = collapse_blanks(F.regexp_replace(title, r"[\x00-\x08\x0E-\x1F\x7F]", ""))
    return F.when(F.length(clean).between(1, most), clean)


def card_title(body: Column, most: int = 42) -> Column:
    """The first line that isn't blank, cut."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.try_element_at(lines, F.lit(1)), 1, most)


def next_run(moment: Column, hour: int, weekday: int | None = None) -> Column:
    """The next daily run at `hour`, or weekly on a weekday (0 is Monday), strictly after a
    moment."""
    today = F.date_trunc("day", moment) + F.make_dt_interval(hours=F.lit(hour))
    if weekday is None:
        return F.when(today > moment, today).otherwise(today + F.make_dt_interval(days=F.lit(1)))
    ahead = F.pmod(F.lit(weekday) - F.weekday(moment), F.lit(7))
    run = today + F.make_dt_interval(days=ahead)
    return F.when(run > moment, run).otherwise(run + F.make_dt_interval(days=F.lit(7)))


def attach_location(jobs: DataFrame, placed: DataFrame, paths: DataFrame) -> DataFrame:
    """jobs with the path of their target's folder; empty if it has none."""
    labels = placed.join(paths.select(F.col("id").alias("folder_id"), "path"), "folder_id").select("target_type", "target_id", "path")
    return jobs.join(labels, ["target_type", "target_id"], "left").withColumn("path", F.coalesce("path", F.lit("")))


def restore_guarded(now: DataFrame, older: DataFrame, key: str, body: str, columns: list[str]) -> DataFrame:
    """Columns of an older version, if every body is as it was then; else `now` as it is."""
    old = older.select(F.col(key), F.sha2(F.col(body), 256).alias("_digest"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = now.join(old, key, "left")
    changed = joined.agg(F.count_if(F.col("_digest").isNotNull() & (F.col("_digest") != F.sha2(F.col(body), 256))).alias("_changed"))
    rows = joined.join(F.broadcast(changed))
    use = (F.col("_changed") == 0) & F.col("_digest").isNotNull()
    return rows.select(*(F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in now.columns))
