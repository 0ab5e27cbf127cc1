"""Quality of documents: hierarchical empirical Bayes over text and site.

A logistic model of text statistics, fitted on a bounded sample of labelled rows, gives
each document's evidence. Hosts and their paths have rates of good documents of their
own: labelled rows count fully, the evidence of all other rows counts as a fraction. A
path's rate is shrunk toward its host's, a host's toward the global one; how much
follows from how far hosts (paths) differ more than chance would let them. Text
evidence and site rate are added as log odds.

Sites may be as many as they like: their rates stay a table, made by grouped
aggregation and joined back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import settle, utf8_values

#: Labelled rows that the text model is fitted on; weight of an unlabelled row's
#: evidence in its site's rate; share of the site's log odds in the result.
SAMPLE, UNLABELLED, SITE_SHARE = 20_000, 0.2, 0.5
FEATURES = 15
UPPER, DIGITS, BLANKS = bytes(range(65, 91)), b"0123456789", b" \t\n\r\x0b\x0c"
MARKS, ENDS, SYMBOLS = b"|<>{}[]\\^~_", b"!?", b"#$%&*@+=/"
BYTES = bytes(range(256))
DOUBLED = re.compile(rb"([!?#$%&*|.,-])\1")


def statistics(text: bytes) -> list[float]:
    """Shares and sizes that describe a text; whole texts, in a few passes."""
    n = len(text) or 1
    words = text.split()
    m = len(words) or 1
    lower = [w.lower() for w in words]
    kinds = len(set(lower))
    lines = text.split(b"\n")
    share = [(n - len(text.translate(None, x))) / n for x in (UPPER, DIGITS, BLANKS, MARKS, ENDS, SYMBOLS, b".,;:")]
    return [
        *share,
        len(DOUBLED.findall(text)) / m,
        kinds / m,
        kinds / m**0.75,
        sum(map(bytes.__eq__, lower[1:], lower[:-1])) / m,
        len(set(lines)) / len(lines),
        min(40.0, sum(map(len, words)) / m) / 10,
        np.log1p(m) / 10,
        np.log1p(n / len(lines)) / 10,
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """With roots and squares, so that a linear model can bend."""
    return np.hstack([x, np.sqrt(np.abs(x)), x * x])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(center, scale, weights with the constant last) by Newton steps; y may be soft."""
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - center) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return center, scale, w


def with_statistics(rows: DataFrame, names: list[str], made: str, out) -> DataFrame:
    """rows(..., text) -> the columns `names` and what out(statistics, a row a text) makes of
    type `made`, as `found`."""
    schema = rows.select(*names).withColumn("found", F.lit(None).cast(made)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([statistics(t) for t in utf8_values(b.column(b.schema.get_field_index("text")))]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), out(stats)], names=[*names, "found"])

    return rows.select(*names, "text").mapInArrow(run, schema)


def site(source: Column) -> tuple[Column, Column]:
    """(host, path) of a source: a url's host and first path segment; without a scheme
    what stands before the first / is the host. Null is a site of its own."""
    bare = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?#]*)", 1))
    return host, F.concat(host, F.regexp_extract(bare, "^[^/?#]*(/[^/?#]*)", 1))


def spread(sites: DataFrame, rate: Column) -> float:
    """Strength of the beta prior under sites(good, n) around `rate`, from the moments: how
    much the sites' rates vary beyond the chance of their sizes."""
    off = F.col("good") / F.col("n") - rate
    by_chance = rate * (1 - rate) / F.col("n")
    row = sites.where("n > 1").agg(F.avg(off * off - by_chance).alias("between"), F.avg(rate * (1 - rate)).alias("within")).first()
    if row["within"] is None:
        return 10.0
    return float(np.clip(row["within"] / max(row["between"], 1e-4) - 1, 2.0, 1000.0))


def logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def site_rates(rows: DataFrame) -> DataFrame:
    """rows(host, path, quality, evidence) -> (host, path, site_odds): log odds of the
    path's shrunk rate against the global rate's."""
    weight = F.when(F.col("quality").isNotNull(), 1.0).otherwise(UNLABELLED)
    good = F.coalesce(F.col("quality").cast("double"), 1 / (1 + F.exp(-F.col("evidence"))))
    paths = settle(rows.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * good).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = paths.agg(F.sum("n"), F.sum("good")).first()
    overall = float(np.clip((total[1] or 1.0) / (total[0] or 2.0), 0.01, 0.99))
    host_prior = spread(hosts, F.lit(overall))
    hosts = settle(hosts.select("host", ((F.col("good") + host_prior * overall) / (F.col("n") + host_prior)).alias("host_rate")), "hosts")
    joined = paths.join(hosts, "host")
    path_prior = spread(joined, F.col("host_rate"))
    rate = (F.col("good") + path_prior * F.col("host_rate")) / (F.col("n") + path_prior)
    return joined.select("host", "path", (logit(F.least(F.greatest(rate, F.lit(0.01)), F.lit(0.99))) - float(np.log(overall / (1 - overall)))).alias("site_odds"))


def learned(labels: DataFrame, label: str, hold_out: bool) -> DataFrame:
    """(id, good) of the rows whose label may be used."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("good"))
    return known.where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0) if hold_out else known


def judged(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, source: str, label: str, sample: int, threshold: float, hold_out: bool) -> DataFrame:
    """One row per row of docs: id, own (a hash of its text and source), held_out, score,
    predicted, text_odds, site_odds. Each text is looked at once; what the text says is a
    table without texts, and sites meet it there."""
    host, path = site(F.col(source) if source in docs.columns else F.lit(None))
    body = F.col(text).cast("string")
    held = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    rows = docs.select(F.col(doc_id).alias("id"), identity(docs, text, source).alias("own"), held.alias("held_out"), host.alias("host"), path.alias("path"), body.alias("text"))
    known = settle(learned(labels, label, hold_out), "labels")

    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` ids and labels
    fitted = with_statistics(rows.select("id", "text").join(F.broadcast(picked), "id"), ["good"], "array<double>", lambda x: pa.array(list(x), pa.list_(pa.float64()))).toPandas()
    y = fitted["good"].to_numpy(np.float64)
    if len(y) and 0 < y.mean() < 1:
        center, scale, w = fit_logistic(expanded(np.array(fitted["found"].tolist())), y)
    else:
        center, scale, w = np.zeros(3 * FEATURES), np.ones(3 * FEATURES), np.zeros(3 * FEATURES + 1)

    def odds(stats: np.ndarray) -> pa.Array:
        return pa.array(np.clip((expanded(stats) - center) / scale @ w[:-1] + w[-1], -20, 20))

    evidence = settle(with_statistics(rows, ["id", "own", "held_out", "host", "path"], "double", odds).withColumnRenamed("found", "text_odds"), "evidence")
    rates = settle(site_rates(evidence.join(known, "id", "left").select("host", "path", F.col("good").alias("quality"), F.col("text_odds").alias("evidence"))), "rates")
    placed = evidence.join(rates, ["host", "path"], "left").withColumn("site_odds", F.coalesce("site_odds", F.lit(0.0)))
    placed = placed.withColumn("score", 1 / (1 + F.exp(-(F.col("text_odds") + SITE_SHARE * F.col("site_odds")))))
    return placed.select("id", "own", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_odds", "site_odds")


def identity(docs: DataFrame, text: str, source: str) -> Column:
    """Rows of one id that agree in this are judged alike."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), *([F.coalesce(F.col(source).cast("string"), F.lit(""))] if source in docs.columns else []))


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", label: str = "quality", sample: int = SAMPLE, threshold: float = 0.5, hold_out: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: better), predicted (1:
    good), text_odds and site_odds. Other columns are left out.

    Labels are learned from rows whose crc32(id as text) mod 5 isn't 0 (all rows without
    hold_out), at most `sample` of them for the text model. Null text is empty; a null or
    absent source is a site of its own; a null id has no label; of labels that repeat an
    id the mean is taken, 0.5 and more as good. Without any label of either kind every
    text has even odds. Repeated rows give repeated results; an empty table gives no
    rows."""
    found = judged(docs, labels, doc_id, text, source, label, sample, threshold, hold_out)
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", "text_odds", "site_odds")


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", label: str = "quality", sample: int = SAMPLE, threshold: float = 0.5, hold_out: bool = True) -> DataFrame:
    """The rows of docs that scored() predicts to be good, whole, whatever their columns are
    called. Nulls, repeats and empty tables: as there."""
    found = judged(docs, labels, doc_id, text, source, label, sample, threshold, hold_out)
    stay = settle(found.where("predicted = 1").select(F.struct("id", "own").alias("stays")).distinct(), "accepted")
    return docs.join(stay, F.struct(F.col(doc_id).alias("id"), identity(docs, text, source).alias("own")).eqNullSafe(stay["stays"]), "left_semi")
