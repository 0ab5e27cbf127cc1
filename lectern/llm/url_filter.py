"""URL filter: fixed host and path rules, and association rules where none fits.

Urls that a fixed rule judges are the labelled ones. FP-growth mines the tokens that
their urls combine, with the verdict as one more item; rules that end in a verdict are
kept if their support and confidence suffice and no shorter rule of the same verdict is
as sure. Every rule is posted in an inverted index under its rarest token, so a token
that all urls have leads to hardly any rule. Urls are matched by their distinct sets of
tokens, which a hot host shares. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle

#: Rules of the query: verdict, then host/path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SUPPORT, CONFIDENCE, DEFAULT = 0.002, 0.6, "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = "verdict="


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    found = []
    for verdict, rule in rules:
        of_host, _, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*found)))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The url's tokens, sorted and distinct: scheme, the host's labels and its ends of
    two labels, path segments (digits as #), file type, names of query fields, and
    whether there is a fragment."""
    labels = F.split(host, "\\.")
    domain = F.element_at(labels, -1)
    pair = F.when(F.size(labels) > 1, F.concat(F.lit("domain="), F.substring_index(host, ".", -2)))
    whole = F.when(host != "", F.concat(F.lit("host="), host))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(F.lower(x), "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "://[^?#]*\\?([^#]*)", 1)
    fields = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("field="), F.substring_index(x, "=", 1)))
    scheme = F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    return F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.concat(
                    F.array(scheme, F.when(domain != "", F.concat(F.lit("top="), domain)), pair, whole, F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment"))),
                    F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("label="), x)),
                    segments,
                    fields,
                )
            )
        )
    )


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """labelled(tokens, verdict) -> (antecedent, verdict, confidence, support)."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    end = F.element_at("consequent", 1)
    rules = model.associationRules.where(end.startswith(VERDICT) & ~F.exists("antecedent", lambda x: x.startswith(VERDICT)))
    return rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(end, len(VERDICT) + 1, 1000).alias("verdict"), "confidence", "support")


def pruned(rules: DataFrame) -> DataFrame:
    """Without the rules that a shorter one, by one token, makes needless: the same
    verdict with no less confidence (its support is no less either)."""
    kept = rules.select("antecedent", "verdict", "confidence")
    shorter = rules.where(F.size("antecedent") > 1).select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("left_out"))
    shorter = shorter.select("antecedent", "verdict", "confidence", F.array_remove("antecedent", F.col("left_out")).alias("part"))
    better = kept.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("sure"))
    needless = shorter.join(better, ["part", "verdict"]).where("sure >= confidence").select("antecedent", "verdict").distinct()
    return rules.join(needless, ["antecedent", "verdict"], "left_anti")


def inverted_index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """rules with `token`: the one of the antecedent that fewest labelled urls have."""
    seen = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("urls"))
    posted = rules.withColumn("token", F.explode("antecedent")).join(seen, "token")
    return posted.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("urls", "token")).alias("rarest")).select("antecedent", "verdict", "confidence", "support", F.col("rarest.token").alias("token"))


def mined_verdicts(token_sets: DataFrame, index: DataFrame) -> DataFrame:
    """token_sets(tokens), distinct -> (tokens, verdict) where a rule matches: the surest
    rule's, then the one of most support, then the longest; block before allow."""
    near = token_sets.withColumn("token", F.explode("tokens")).join(index, "token")
    hit = near.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hit.groupBy("tokens").agg(F.max(F.struct("confidence", "support", F.size("antecedent").alias("size"), "verdict")).alias("best")).select("tokens", F.col("best.verdict").alias("mined"))


def judged_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (null if none fits), verdict.

    Null urls and urls without :// have empty host and path, which no rule fits; what no
    mined rule matches either has the default verdict. Repeated rows give repeated
    results; other columns are left out; an empty table gives no rows."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fixed", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    rows = rows.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.col("fixed.verdict").alias("fixed"), "tokens")
    labelled = settle(rows.where("rule IS NOT NULL").select("tokens", F.col("fixed").alias("verdict")), "labelled")
    mined = settle(mined_rules(labelled, support, confidence), "rules")
    index = settle(inverted_index(pruned(mined), labelled), "index")
    sets = rows.where("rule IS NULL").select("tokens").distinct()
    verdicts = settle(mined_verdicts(sets, index), "verdicts")
    return rows.join(verdicts, "tokens", "left").select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit(default)).alias("verdict"))
