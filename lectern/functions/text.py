"""Text functions, column to column."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Blanks of all scripts.
BLANKS = r"[\s\x0B\u00a0\ufeff\u2000-\u200a\u3000]+"
HAN = r"[\u3400-\u4dbf\u4e00-\u9fff]"


def fold(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def literal_contains(text: Column, query: str) -> Column:
    """Substring match without wildcards, A-Z and a-z alike; null text doesn't match. A pattern
    whose signs are all escaped: it takes a seventh of the time of folding the text first."""
    escaped = re.sub(r"([^A-Za-z0-9\x80-\U0010ffff])", r"\\\1", query)
    return F.coalesce(text.rlike(f"(?i){escaped}"), F.lit(False))


def first_nonblank(*values: Column) -> Column:
    """The first value that holds more than blanks."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def clean_text(text: Column) -> Column:
    """Without NUL and CR, blanks at line ends and more than one empty line in a row."""
    bare = F.translate(text, "\x00\r", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def summary(text: Column, size: int = 220, empty: str = "") -> Column:
    """The first `size` characters on one line, with an ellipsis if there are more."""
    line = collapse_blanks(F.coalesce(text, F.lit("")))
    return F.when(line == "", F.lit(empty)).when(F.length(line) > size, F.concat(F.substring(line, 1, size), F.lit("…"))).otherwise(line)


def excerpt(text: Column, query: str, size: int = 220, before: int = 55) -> Column:
    """A window around the first hit of query, with marks where text is left out; null
    if there is no hit."""
    line = collapse_blanks(text)
    at = F.locate(query.translate(str.maketrans(UPPER, LOWER)), fold(line))
    start = F.greatest(at - before, F.lit(1))
    width = max(size, len(query) + before)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(line, start, F.lit(width)), F.when(start + width - 1 < F.length(line), "…").otherwise(""))
    return F.when(at > 0, cut)


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    """A whole number within bounds; what isn't a number becomes the default."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.floor(F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")).cast("long"), F.lit(default))))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once a row however often `then` names it; a column
    that stands in several branches is computed at each of them."""
    return F.transform(F.array(value), then)[0]


def detect_language(text: Column) -> Column:
    """zh, en, mixed or unknown, by Han characters and Latin words. Eighty Han characters that
    make up 8 % of what is visible say zh, unless Latin words are many more."""

    def told(t: Column) -> Column:
        han = F.length(t) - F.length(F.regexp_replace(t, r"[\u3400-\u9fff]++", ""))
        words, visible = F.regexp_count(t, F.lit("[A-Za-z][A-Za-z'’-]+")), F.greatest(F.length(F.regexp_replace(t, BLANKS, "")), F.lit(1))
        share = lambda n: F.when(n > 0, n / visible).otherwise(0.0)
        return once(F.struct(han.alias("han"), words.alias("words")), lambda c: once(share(c["han"]), lambda s: language(t, c["han"], c["words"], s)))

    def language(t: Column, han: Column, words: Column, share: Column) -> Column:
        latin = (words >= 120) & (share < 0.22) & (F.regexp_count(t, F.lit("[A-Za-z]")) > han * 1.35)
        found = F.when((han >= 80) & (share >= 0.08), F.when(latin, "mixed").otherwise("zh")).when((words >= 40) & (share < 0.03), "en").when((han >= 20) & (words >= 40), "mixed")
        return found.otherwise(F.when(han > words, "zh").when(words > 0, "en").otherwise("unknown"))

    return once(F.coalesce(text, F.lit("")), told)


def word_count(text: Column) -> Column:
    """Words between blanks, or Han characters if they are more."""
    t = collapse_blanks(F.coalesce(text, F.lit("")))
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    return F.greatest(words, F.regexp_count(t, F.lit(HAN))).cast("long")


def plain_text(html: Column) -> Column:
    """Text of html: scripts and styles out, block ends as line ends, entities decoded."""
    t = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, "(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), " ?\n[ \n]*", "\n"), F.lit(" \n"))


def title_key(title: Column) -> Column:
    """Lower case without blanks, punctuation and symbols."""
    return F.regexp_replace(F.lower(title), r"[\s\p{P}\p{S}]+", "")


def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """Unicode's compatibility form; plain ASCII never leaves the JVM's side of the choice."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(F.pandas_udf(_compatible, "string")(text))


def normalize_title(title: Column) -> Column:
    """title_key() of the compatibility form: wide, ringed and plain letters are one."""
    return title_key(compatible(title))


def text_corruption(text: Column) -> Column:
    """Does a text layer look broken? Counted among its visible characters, of which there must
    be 80: replacement characters, control characters, private-use characters, and a
    mixture of these with rare scripts. Plain ASCII, which is none of them, is taken out first,
    so that a text is walked three times."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\[[A-Z_]*PDF_PAGE:[0-9]+\]\]", ""), BLANKS, "")

    def counted(t: Column) -> Column:
        return once(F.struct(F.length(t).alias("n"), F.regexp_replace(t, r"[\x21-\x7E]++", "").alias("rest")), lambda c: once(counts(c["n"], c["rest"]), broken))

    def counts(n: Column, rest: Column) -> Column:
        count = lambda p: F.regexp_count(rest, F.lit(p))
        control, private, replaced = count(r"[\x00-\x08\x0E-\x1F\x7F-\x9F]"), count(r"[\uE000-\uF8FF\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"), count("\uFFFD")
        rare = count(r"[\u3400-\u4DBF\u0530-\u058F\u10A0-\u10FF\u1200-\u137F\u2D30-\u2D7F\u2F00-\u2FDF]")
        return F.struct(n.alias("n"), control.alias("control"), private.alias("private"), replaced.alias("replaced"), rare.alias("rare"))

    def broken(c: Column) -> Column:
        n, control, private, rare = c["n"], c["control"], c["private"], c["rare"]
        severe = control + private + c["replaced"]
        found = (c["replaced"] >= 3) | ((control >= 8) & (control / n >= 0.005)) | ((private >= 50) & (private / n >= 0.03)) | ((severe >= 24) & (severe / n >= 0.012) & (rare >= 80) & (rare / n >= 0.08))
        return F.when(n < 80, False).otherwise(found)

    return once(bare, counted)


def dense_data(text: Column) -> Column:
    """A block of figures: 90 characters and six numbers at least, and figures are many, or
    there are percentages, separators or units."""
    t = collapse_blanks(F.coalesce(text, F.lit("")))
    count = lambda p: F.regexp_count(t, F.lit(p))
    units = count(r"(?i)\b(?:ms|s|MB|GB|TB|Hz|kHz|MHz|GHz|req/s|tokens?/s)\b")
    many = (count("[0-9%+−-]") / F.length(t) >= 0.18) | (count("[0-9](?:[.,][0-9]+)?%") >= 2) | (count("[：:；;|｜]") >= 3) | (units >= 3)
    return (F.length(t) >= 90) & (count("[-+]?[0-9]+(?:[.,][0-9]+)?%?") >= 6) & many


def block_kind(text: Column) -> Column:
    """list, heading, data or paragraph."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"^([-*•]|[0-9]+[.)])\s"), "list").when((F.length(t) <= 48) & ~t.rlike(r"[.!?。！？]$") & (t != ""), "heading").when(dense_data(t), "data").otherwise("paragraph")


def strip_markdown(text: Column) -> Column:
    """Marks out, text of links stays."""
    t = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?m)^#{1,6}\s+", ""), r"[*_`~]+", ""))


def compact_count(text: Column) -> Column:
    """1.2k, 3m or 1,234 as a whole number."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[, ]", ""))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)([km]?)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)([km]?)$", 2)
    return F.floor(number * F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1) + 0.5).cast("long")


def clock(seconds: Column) -> Column:
    """Seconds as [HH:]MM:SS."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.concat(F.when(hours > 0, F.concat(two(hours), F.lit(":"))).otherwise(""), two(minutes), F.lit(":"), two(F.pmod(s, F.lit(60))))


def iso_week(day: Column) -> Column:
    """YYYY-Www of the ISO calendar."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
