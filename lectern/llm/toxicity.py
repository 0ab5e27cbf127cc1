"""Toxicity by weak supervision.

Voters are lexicons and patterns. A few lexicons are given (SEEDS); the others are
mined: terms (words and beginnings of words, hashed) that labelled rows of a bounded
sample associate with toxicity, dealt by how they begin; pattern voters look at shouting, symbols,
repetition and the like. Each voter says of a text whether it fires.

A generative label model explains the votes on all documents by one hidden class. It
needs how often voters fire and fire together, which is counted over every document and
is as large as the square of the number of voters, and how they go with the labels of
rows that no lexicon was mined from. The covariance of votes is one rank, from the
hidden class, and a rest: voters whose rest is large say the same, and the posterior
counts them accordingly.

A sparse linear classifier on hashed terms is trained on the posterior labels of a
bounded sample of labelled and unlabelled rows, those left out on which nobody speaks. A
row's own label, where it may be used, is one more voter, whose accuracy is learned from
how well it agrees with the others and whose say is less than theirs together
(OWN < FIRM). The sample's terms stay distributed; the driver sees sums by term and, of each row, the
terms that the classifier uses, TERMS at most in all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from math import fsum
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import texts_of
from lectern.llm.common import settle

#: Labelled and unlabelled rows in the sample, at most; terms of all its rows that the driver
#: takes, at most (the rows beyond are left out); hashed terms; mined lexicons.
SAMPLE, UNLABELLED, TERMS, SPACE, LEXICONS = 8_000, 8_000, 4_000_000, 1 << 21, 32
#: A term's least number of toxic rows, least log odds, and least distance from chance (in
#: standard deviations), to enter a lexicon.
LEAST_ROWS, LEAST_ODDS, LEAST_SURE = 4, 3.5, 9.0
#: Log odds that the voters together don't exceed, and those that a row's own label doesn't.
FIRM, OWN = 4.5, 4.0
#: Lexicons that are given: words that insult, belittle, curse, threaten or dehumanise.
SEEDS = (
    ("idiot", "moron", "imbecile", "fool", "dumb", "stupid", "dimwit", "blockhead", "idioten", "dummkopf", "trottel", "crétin", "imbécile", "estúpido", "tonto"),
    ("worthless", "pathetic", "loser", "useless", "disgusting", "ugly", "wertlos", "erbärmlich", "inútil", "minable", "asqueroso"),
    ("damn", "crap", "bastard", "bullshit", "shit", "fuck", "fucking", "bitch", "scheiße", "merde", "putain", "mierda", "puta"),
    ("kill", "die", "hang", "burn", "hurt", "beat", "stab", "shoot", "sterben", "töten", "crever", "tuer", "matar", "morir"),
    ("scum", "vermin", "trash", "filth", "parasite", "garbage", "pest", "subhuman", "abschaum", "ungeziefer", "vermine", "basura", "escoria"),
)
CACHE = 400_000
WORD = re.compile(r"\w+")
#: Bytes of a word's beginnings that are terms.
STARTS = (3, 4, 5, 6, 7)
SHOUT, MAIL = re.compile(r"[A-Z]{4,} [A-Z]{4,}"), re.compile(r"[\w.]+@\w+\.")
JUNK = ("###", "$$$", "%%%", "&&&", "***")
PATTERNS = 9
VOTERS = LEXICONS + len(SEEDS) + PATTERNS


def terms(word: bytes) -> list[int]:
    """Hashed terms of a word in lower case: itself and its beginnings, whose checksums are
    made one from the other. The upper bits are those of its first bytes: words that begin
    alike are in one lexicon."""
    crc = zlib.crc32(word[:3])
    family, rest = (crc ^ crc >> 16) % LEXICONS * (SPACE // LEXICONS), SPACE // LEXICONS - 1
    out, size, last, crc = [family | zlib.crc32(word) & rest], len(word), 0, 0x5BD1E995
    for n in STARTS:
        if n >= size:
            break
        crc, last = zlib.crc32(word[last:n], crc), n
        out.append(family | crc & rest)
    return out


def words_in(token: str) -> list[str]:
    """The words of one token, that is of what stands between blanks."""
    return [token] if token.isalnum() else WORD.findall(token)


def token_terms(token: str) -> list[int]:
    return [x for w in words_in(token) for x in terms(w.encode())]


def tokens_of(text: str) -> tuple[set[str], int, bool]:
    """(distinct tokens in lower case, number of tokens, whether one stands four times in a row)."""
    found = text.lower().split()
    own = set(found)
    stutter = len(own) <= len(found) - 3 and any(a == b == c == d for a, b, c, d in zip(found, found[1:], found[2:], found[3:], strict=False))
    return own, len(found), stutter


class Known(dict):
    """token -> what tables say of its terms and words; grows as tokens are met, up to a bound."""

    def __init__(self, table: dict[int, float], fold, start, words: dict[str, int] | None = None):
        super().__init__()
        self.table, self.fold, self.start, self.words = table, fold, start, words or {}

    def __missing__(self, token: str):
        if len(self) > CACHE:
            self.clear()
        found = self.start
        for w in words_in(token):
            for v in (*map(self.table.get, terms(w.encode())), self.words.get(w)):
                if v is not None:
                    found = self.fold(found, v)
        self[token] = found
        return found


def fired_patterns(text: str, own: set[str], count: int, stutter: bool) -> int:
    """Votes of the pattern voters, as bits above the lexicons'."""
    fired = (
        "!!" in text or "??" in text,
        SHOUT.search(text) is not None,
        any(x in text for x in JUNK),
        " | " in text,
        "http" in text or "www." in text,
        "@" in text and MAIL.search(text) is not None,
        stutter,
        count > 20 and 2 * len(own) < count,
        not own.isdisjoint(("you", "your", "you're", "du", "tu", "tú")),
    )
    return sum(1 << i for i, x in enumerate(fired) if x) << LEXICONS + len(SEEDS)


def bits_of(masks: np.ndarray) -> np.ndarray:
    """64-bit masks -> rows of VOTERS zeros and ones."""
    return np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :VOTERS].astype(np.float64)


def seeds() -> dict[str, int]:
    """Of the words of the given lexicons, the voter as a bit."""
    return {word: 1 << LEXICONS + i for i, words in enumerate(SEEDS) for word in words}


def lexicon_masks(term: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[int, int]:
    """Of the hashed terms that lexicons hold, the voter as a bit."""
    odds = np.log((toxic + 0.5) / (max(1, n_toxic) + 1)) - np.log((clean + 0.5) / (max(1, n_clean) + 1))
    share, rows = n_toxic / max(1, n_toxic + n_clean), toxic + clean
    beyond = (toxic - share * rows) / np.sqrt(share * (1 - share) * rows + 1e-9)
    held = (toxic >= LEAST_ROWS) & (odds >= LEAST_ODDS) & (beyond >= LEAST_SURE)
    return {t: 1 << t // (SPACE // LEXICONS) for t in term[held].tolist()}


def vote_counts(docs: DataFrame, masks: dict[int, int], text: str) -> tuple[np.ndarray, int]:
    """(counts, rows): counts[i, j] of documents on which voters i and j both fire."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(masks, or_, 0, seeds())
        total, n = np.zeros((VOTERS, VOTERS)), 0
        for b in batches:
            votes = []
            for t in texts_of(b.column(0)):
                own, count, stutter = tokens_of(t)
                mask = fired_patterns(t, own, count, stutter)
                for m in set(map(known.__getitem__, own)):
                    mask |= m
                votes.append(mask)
            x = bits_of(np.array(votes, np.uint64))
            total += x.T @ x
            n += len(x)
        i, j = np.triu_indices(VOTERS)
        yield pa.RecordBatch.from_arrays([pa.array([*i, VOTERS], pa.int32()), pa.array([*j, VOTERS], pa.int32()), pa.array([*total[i, j].astype(np.int64), n], pa.int64())], names=["i", "j", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    counts, rows = np.zeros((VOTERS, VOTERS)), 0
    for r in found:
        if r["i"] == VOTERS:
            rows = r["n"]
        else:
            counts[r["i"], r["j"]] = counts[r["j"], r["i"]] = r["n"]
    return counts, rows


class LabelModel:
    """Voters' accuracies and correlations. A voter fires for toxicity or keeps silent, and
    silence says nothing.

    `direction` is each voter's correlation with the labels of rows that its words were not
    mined from: the label is a voter like the others, whose own share g is learned. All
    others' shares s explain how often they fire together, over all documents."""

    #: How many voters' covariances the labels weigh as much as; correlation beyond the class
    #: of voters that say the same.
    ANCHOR, SAME = 100.0, 0.3

    def __init__(self, counts: np.ndarray, rows: int, prior: float, direction: np.ndarray, labelled: int = 10_000):
        self.prior = float(np.clip(prior, 0.01, 0.99))
        rate = np.diag(counts) / max(1, rows)
        cov = counts / max(1, rows) - np.outer(rate, rate)
        size = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(size, size)
        apart = ~np.eye(VOTERS, dtype=bool)
        use, s, g = apart, np.clip(direction, -0.9, 0.9), 0.9
        for _ in range(60):  # off the diagonal, corr is nearly s s', and direction is g s
            top = (np.where(use, corr, 0) * s).sum(axis=1) + self.ANCHOR * g * direction
            bottom = (np.where(use, 1.0, 0) * s**2).sum(axis=1) + self.ANCHOR * g * g
            s = 0.5 * s + 0.5 * np.clip(top / np.maximum(bottom, 1e-6), -0.97, 0.97)
            g = float(np.clip(direction @ s / max(s @ s, 1e-6), 0.9, 0.97))
            rest = corr - np.outer(s, s)
            use = (np.abs(rest) < 0.25) & apart
        s = np.sign(s) * np.maximum(np.abs(s) - 2 / np.sqrt(labelled), 0)  # what chance can't explain
        self.accuracy, self.label_accuracy = s, g
        self.correlated = (rest >= self.SAME) & apart
        #: Share of toxic texts among those on which a voter fires.
        self.precision = np.clip(self.prior + s * size * np.sqrt(self.prior * (1 - self.prior)) / np.maximum(rate, 1e-9), 0.02, 0.97)
        self.constant = float(np.log(self.prior / (1 - self.prior)))
        #: A voter that is wrong more often than right is not heard.
        says = np.where((np.diag(counts) >= LEAST_ROWS) & (self.precision >= 0.5), np.log(self.precision / (1 - self.precision)) - self.constant, 0.0)
        self.weights = says / (1 + np.where(self.correlated, rest, 0).sum(axis=1))

        #: Log odds that a row's own label adds, label 0 and label 1: as accurate as it is
        #: learned to be, but never more than voters that agree can say.
        no, yes = self.prior * (1 - g), self.prior + g * (1 - self.prior)
        self.own = tuple(float(np.clip(np.log(x / (1 - x)) - self.constant, -OWN, OWN)) for x in (no, yes))

    def odds(self, votes: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """Posterior log odds of rows; label: their own ones, nan where there is none."""
        said = np.clip(votes @ self.weights + self.constant, -FIRM, FIRM)
        return said if label is None else said + np.where(np.isnan(label), 0.0, np.where(label == 1, self.own[1], self.own[0]))

    def speaks(self, votes: np.ndarray) -> np.ndarray:
        """Where voters say more than the prior does."""
        return np.abs(votes @ self.weights) >= 2.0


def fit_sparse(rows: np.ndarray, cols: np.ndarray, m: int, target: np.ndarray, steps: int = 300, lasso: float = 0.4) -> tuple[np.ndarray, float]:
    """Weights of m terms and a constant: logistic regression on how many of a text's distinct
    tokens have a term (entries rows, cols), with an L1 penalty, by accelerated proximal
    steps whose size follows each term's own curvature."""
    n, share = len(target), float(np.clip(target.mean(), 0.001, 0.999))
    per_row = np.bincount(rows, minlength=n) + 1.0
    step = 1 / (0.25 * np.bincount(cols, per_row[rows], m) + 1e-6)
    step_c = 1 / (0.25 * per_row.sum())
    w, c = np.zeros(m), float(np.log(share / (1 - share)))
    v, d, pace = w.copy(), c, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, v[cols], n) + d, -30, 30)))
        new = v - step * np.bincount(cols, (p - target)[rows], m)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        new_c = d - step_c * (p - target).sum()
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        v, d = new + (pace - 1) / next_pace * (new - w), new_c + (pace - 1) / next_pace * (new_c - c)
        w, c, pace = new, new_c, next_pace
    return w, c


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int, unlabelled: int) -> DataFrame:
    """(place, y, patterns, terms, kind) of the sample's rows; place is their order, kind is
    mostly that of their copies. Rows whose label may be used come with it as y; others,
    held-out ones left out, have none. Both are chosen by the hash of their ids."""
    order = F.xxhash64("id")
    learn = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    picked = known.where(learn).orderBy(order, "id").limit(sample)
    if unlabelled:
        ids = docs.select(F.col(doc_id).alias("id")).where("id IS NOT NULL").where(learn).distinct()
        more = ids.join(known, "id", "left_anti").orderBy(order, "id").limit(unlabelled).withColumn("y", F.lit(None).cast("int"))
        picked = picked.unionByName(more)
    picked = settle(picked, "picked")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    # at most sample + unlabelled rows of an id and a number
    rows = rows.join(F.broadcast(picked), "id").select("text", order.alias("place"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Known({}, or_, 0, seeds())
        for b in batches:
            found, fired, kinds = [], [], []
            for t in texts_of(b.column(0)):
                own, count, stutter = tokens_of(t)
                found.append(np.array([x for w in own for x in token_terms(w)], "<i4").tobytes())
                fired.append(reduce(or_, map(given.__getitem__, own), fired_patterns(t, own, count, stutter)))
                kinds.append(zlib.crc32(b"".join(sorted(w.encode() for w in own)[:4])))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(fired, pa.int64()), pa.array(found, pa.binary()), pa.array(kinds, pa.int64())], names=["place", "y", "patterns", "terms", "kind"])

    return settle(rows.mapInArrow(run, "place long, y int, patterns long, terms binary, kind long"), "sample")


def sums_by_term(rows: DataFrame, share, distinct: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, sums, sums of shares) over the sample: share(terms of the rows, y, patterns) says
    how much of each row counts as toxic. Terms of LEAST_ROWS and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, high = np.zeros(SPACE), np.zeros(SPACE)
        for b in batches:
            found = [np.frombuffer(x, "<i4") for x in b.column(3).to_pylist()]
            for f, part in zip(found, share(found, b.column(1), b.column(2)), strict=True):
                if np.isnan(part):
                    continue
                f = np.unique(f) if distinct else f
                np.add.at(total, f, 1)
                np.add.at(high, f, part)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(high[at])], names=["term", "total", "high"])

    got = rows.mapInArrow(run, "term int, total double, high double").groupBy("term").agg(F.sum("total").alias("total"), F.sum("high").alias("high")).where(F.col("total") >= LEAST_ROWS).toPandas().sort_values("term")
    return tuple(got[c].to_numpy() for c in ("term", "total", "high"))


def numbers(y: pa.Array) -> np.ndarray:
    return y.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def classifier(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int, unlabelled: int, terms_bound: int = TERMS) -> tuple[dict[int, float], float]:
    """(weight of each term, constant), fitted on posterior labels."""
    rows = sampled(docs, labels, doc_id, text, label, sample, unlabelled)
    known = rows.where("y IS NOT NULL")
    n, toxic = known.agg(F.count("*"), F.sum("y")).first()
    share = float(np.clip(toxic / n, 0.001, 0.999)) if n else 0.5
    if not n or toxic in (0, n):
        return {}, float(np.log(share / (1 - share)))
    # of copies, one: all would say the same. Lexicons come from one half of the labelled rows,
    # voters' accuracies from the other
    known = known.join(known.groupBy("kind").agg(F.min("place").alias("place")), ["kind", "place"], "left_semi").select(*rows.columns)
    mined, held = known.where("place % 2 = 0"), known.where("place % 2 <> 0")
    n, toxic = mined.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    term, total, high = sums_by_term(mined, lambda found, y, patterns: numbers(y), distinct=True)
    masks = lexicon_masks(term, high, total - high, toxic, n - toxic)
    counts, seen = vote_counts(docs, masks, text)
    voters = np.zeros(SPACE, np.uint64)
    voters[list(masks)] = np.array([*masks.values()], np.uint64)

    def masks_of(terms: np.ndarray, patterns: int) -> int:
        return int(np.bitwise_or.reduce(voters[terms], initial=np.uint64(0))) | patterns

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x, "<i4") for x in b.column(3).to_pylist()]
            masks = [masks_of(f, p) for f, p in zip(found, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(masks, pa.int64())], names=["y", "votes"])

    told = held.mapInArrow(votes, "y int, votes long").toPandas()
    y, cast = told["y"].to_numpy(np.float64), bits_of(told["votes"].to_numpy().astype(np.uint64))
    off, about = cast - cast.mean(axis=0), y - y.mean()
    direction = (off * about[:, None]).mean(axis=0) / (off.std(axis=0) * about.std() + 1e-9)
    model = LabelModel(counts, seen, share, direction, len(y))

    def posterior(found: list[np.ndarray], y: pa.Array, patterns: pa.Array) -> np.ndarray:
        """Posterior labels; nan where neither a voter nor a label speaks."""
        own = numbers(y)
        cast = bits_of(np.array([masks_of(f, p) for f, p in zip(found, patterns.to_pylist(), strict=True)], np.uint64))
        return np.where(np.isnan(own) & ~model.speaks(cast), np.nan, 1 / (1 + np.exp(-model.odds(cast, own))))

    term, total, high = sums_by_term(rows, posterior)
    mean = float(np.clip(high.sum() / max(1.0, total.sum()), 0.001, 0.999))
    deviation = (high - mean * total) / np.sqrt(mean * (1 - mean) * total + 1e-9)
    chosen = term[np.abs(deviation) > 3.0]
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x, "<i4") for x in b.column(3).to_pylist()]
            short = [(x := place[f])[x >= 0] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in short], pa.int64()), pa.array([x.tobytes() for x in short], pa.binary()), pa.array(posterior(found, b.column(1), b.column(2)))], names=["place", "n", "cols", "target"])

    fit = settle(rows.mapInArrow(kept, "place long, n long, cols binary, target double").where("NOT isnan(target)"), "fit")
    # the sample's numbers, a row each, in one task
    room = fit.select("place", F.sum("n").over(Window.orderBy("place")).alias("sum")).where(F.col("sum") <= terms_bound).agg(F.max("place")).first()[0]
    got = fit.where(F.col("place") <= F.lit(room)).select("place", "cols", "target").toPandas().sort_values("place")
    if not len(got):
        return {}, float(np.log(share / (1 - share)))
    cols = [np.frombuffer(x, "<i4") for x in got["cols"]]
    w, c = fit_sparse(np.repeat(np.arange(len(cols)), [len(x) for x in cols]), np.concatenate(cols), len(chosen), got["target"].to_numpy())
    return {int(t): float(x) for t, x in zip(chosen, w, strict=True) if x}, c


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Labels are learned from rows whose crc32(id as text) mod 5 isn't 0, at most `sample` of
    them, with as many as `unlabelled` rows that have none; a null id is held out. Null
    text is empty and is scored like any other. Of labels that repeat an id the mean is
    taken. Without labels of both kinds the score is the share of toxic labels (0.5
    without any). Repeated rows give repeated results; other columns are left out; an
    empty table gives no rows."""
    weight_of, constant = classifier(docs, labels, doc_id, text, label, sample, unlabelled)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(weight_of, add, 0.0)
        for b in batches:
            odds = np.array([fsum(map(known.__getitem__, tokens_of(t)[0])) + constant for t in texts_of(b.column(2))])
            score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
