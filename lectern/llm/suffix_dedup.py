"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

Wanted are all windows of `width` bytes that start earlier somewhere (smaller id, or
same document and earlier start); the bytes that they cover are removed.

1. Suffix buckets. Windows are dealt to the bucket of their anchor (see anchors):
   equal windows are in one bucket, at one distance from the anchor. A row stands for
   an anchor and its context, the bytes that its windows cover together. Buckets of
   one row hold nothing that repeats and go no further.
2. Contexts whose sums of bytes are equal are candidates for whole copies. Those that
   follow each other in both documents are taken together, and a copy's SHA-256 must
   be that of the bytes it repeats; within a task's batch the bytes themselves are
   compared. Where that fails, the bucket is sorted whole.
3. Buckets in which contexts differ are sorted, some at a time. Contexts are laid out
   with their anchors at multiples of PERIOD. The suffixes at the places of a
   difference cover are ranked first, by doubling. Then a bucket's windows are sorted
   by what stands before the next place of the cover, by the rank there, and by what
   the rank doesn't reach: no comparison looks at more than a few bytes, however
   long the tie, and memory is that of the buckets at hand.
4. A bucket with too many contexts is dealt anew by more bytes: those of its windows
   that begin long before the anchor share bytes before it, the others behind it.
   Equal contexts of the new buckets are reduced to the first by an aggregate.

No group is ever in one task as a whole: buckets are counted by partial aggregates, met
by joins that adaptive execution can split, and sorted in streams of bounded blocks.
Texts cross the network twice: to cut what is asked of them, and to meet the decisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.anchors import GRAM, prefix_sums, span_sums, windows_by_anchor
from lectern.llm.common import settle, utf8_values

WIDTH = 100
#: A difference cover modulo 16. Any distance is that of two of its
#: places, and from any place the next one is at most 7 bytes away.
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
REACH = 7
#: Contexts of a bucket before it is dealt anew, bytes of contexts sorted at once, bytes
#: of documents whose anchors are reduced at once, and bytes of a document at once.
BUCKET, BLOCK, BATCH, SEGMENT = 256, 1_000_000, 12_000_000, 1_000_000
RECORD = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("n", "<i4"), ("run", "<i4"), ("at", "<i4")])
#: spot packs where a context begins, how many windows follow its first, and how far its anchor
#: is: lo * 2**16 + run * 2**8 + at. So spots of a document are ordered as places are.
ANCHORS = "doc long, spot long, key long, ctx long"
PLACES = ("CAST(shiftright(spot, 16) AS int) AS lo", "CAST(shiftright(spot, 8) & 255 AS int) AS run", "CAST(spot & 255 AS int) AS at")


def numbered_documents(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """((doc, text), (doc, doc_id, ...)): doc grows in the order of ids. Unique ids of an
    integer type stand for themselves. Else rows are sorted by id, nulls last, and
    numbered partition by partition."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.struct(*(F.col(c) for c in carry)).alias("carry") if carry else F.lit(0).alias("carry"))
    plain = rows.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if plain and not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count():
        doc = F.col("doc_id").cast("long").alias("doc")
        return rows.select(doc, "text"), rows.select(doc, "doc_id", "carry")
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).withColumn("doc", F.monotonically_increasing_id())
    ordered = settle(ordered, "numbered")
    return ordered.select("doc", "text"), ordered.select("doc", "doc_id", "carry")


def _contexts(texts: list[tuple[int, bytes]], width: int, segment: int) -> pa.RecordBatch:
    """Rows of ANCHORS for a batch of documents. Of contexts that the batch repeats, the
    first keeps its key; the others, equal to it byte for byte, have none."""
    found = []
    for n, (doc, text) in enumerate(texts):
        whole = np.frombuffer(text, np.uint8)
        for begin in range(0, len(text) - width + 1, segment):  # a window's anchor doesn't depend on where a segment begins
            data = whole[begin : begin + segment + width - 1]
            anchor, lo, hi, gram = windows_by_anchor(data, width)
            rows = np.empty(len(lo), RECORD)
            rows["key"], rows["ctx"] = gram, span_sums(prefix_sums(data), lo, hi + width)
            rows["doc"], rows["lo"], rows["n"], rows["run"], rows["at"] = doc, begin + lo, n, hi - lo, anchor - lo
            found.append(rows)
    rows = np.concatenate(found) if found else np.zeros(0, RECORD)
    rows = rows[np.lexsort((rows["lo"], rows["doc"], rows["run"], rows["ctx"], rows["key"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["ctx"][1:] != rows["ctx"][:-1]) | (rows["run"][1:] != rows["run"][:-1])
    other = np.flatnonzero(~first)
    head = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))[other]
    sides = (rows["n"][other], rows["lo"][other], rows["n"][head], rows["lo"][head], rows["run"][other] + width)
    equal = [texts[a][1][i : i + k] == texts[b][1][j : j + k] for a, i, b, j, k in zip(*(x.tolist() for x in sides), strict=True)]
    again = np.zeros(len(rows), bool)
    again[other] = equal
    spot = (rows["lo"].astype(np.int64) << 16) + (rows["run"] << 8) + rows["at"]
    keys = [pa.array(np.ascontiguousarray(rows[c]).view(np.int64), mask=again) for c in ("key", "ctx")]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["doc"])), pa.array(spot), *keys], names=["doc", "spot", "key", "ctx"])


def anchors_of(docs: DataFrame, width: int, batch: int = BATCH, segment: int = SEGMENT) -> DataFrame:
    """docs(doc, text) -> ANCHORS: the context from lo on stands for the windows that
    begin at lo to lo + run; their anchor is at lo + at. Without key: to be removed."""
    if width - GRAM > 255:
        raise ValueError("windows of at most 287 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), utf8_values(b.column(1)), strict=True):
                held.append((doc, text))
                size += len(text)
                if size >= batch:
                    yield _contexts(held, width, segment)
                    held, size = [], 0
        if held:
            yield _contexts(held, width, segment)

    return docs.mapInArrow(run, ANCHORS)


def copied_spans(met: DataFrame, width: int) -> DataFrame:
    """met(ANCHORS) -> (doc, start, size, of_doc, of_start): bytes that seem to be those of an
    earlier place. Contexts that follow each other there and here are one span."""
    place = F.struct("doc", "spot")
    firsts = met.groupBy("key", "ctx").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = met.join(firsts, ["key", "ctx"]).where(place != F.col("first")).selectExpr("doc", *PLACES[:2], "first.doc AS of_doc", "CAST(shiftright(first.spot, 16) - shiftright(spot, 16) AS int) AS shift")
    along = Window.partitionBy("doc", "of_doc", "shift").orderBy("lo")
    begins = (F.col("lo") != F.coalesce(F.lag(F.col("lo") + F.col("run") + 1).over(along), F.lit(-1))).cast("long")
    spans = copies.withColumn("begins", begins).withColumn("span", F.sum("begins").over(along)).groupBy("doc", "of_doc", "shift", "span").agg(F.min("lo").alias("start"), (F.max(F.col("lo") + F.col("run")) + width).alias("end"))
    return spans.select("doc", "start", (F.col("end") - F.col("start")).alias("size"), "of_doc", (F.col("start") + F.col("shift")).alias("of_start"))


def _cut_out(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(doc, lo, size, key, at) -> the same with what stands there: the bytes where
    there is a key, else their SHA-256."""
    rows = asked.groupBy("doc").agg(F.collect_list(F.struct("lo", "size", "key", "at")).alias("asked")).join(texts, "doc")

    def piece(a):
        body = F.substring(F.col("bytes"), a["lo"] + 1, a["size"])
        return F.struct(a["lo"].alias("lo"), a["size"].alias("size"), a["key"].alias("key"), a["at"].alias("at"), F.when(a["key"].isNull(), F.unhex(F.sha2(body, 256))).otherwise(body).alias("body"))

    return rows.select("doc", F.explode(F.transform("asked", piece)).alias("p")).select("doc", "p.*")


def _words(table: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The `size` bytes (at most 8) from each place, as integers in byte order."""
    return np.where(size > 0, table[at] >> (np.uint64(64) - np.uint64(8) * np.maximum(size, 1).astype(np.uint64)), 0)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """The rank of each row in the order of the keys; equal rows have one rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(table: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at all places of the cover, by their first `depth` bytes (32
    at least). table: the eight bytes from each place. Two words give 16 bytes; a place
    of the cover and the one PERIOD times 1, 2, 4... further on give twice as many."""
    rank, reached, per = _ranks(table[places], table[places + 8]), PERIOD, len(COVER)
    while 2 * reached <= depth:
        further = np.zeros_like(rank)
        step = per * reached // PERIOD
        further[:-step] = rank[step:]
        rank, reached = _ranks(rank, further), 2 * reached
    rest = [*range(reached, depth - 8, 8), depth - 8] if reached < depth else []
    return _ranks(rank, *(table[places + o] for o in rest)) if rest else rank


def repeated_windows(contexts: list[bytes], anchor: np.ndarray, bucket: np.ndarray, doc: np.ndarray, lo: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts that stand for all their windows: (context, start in it) of each window
    that is also found earlier in the same bucket, at the same distance from the
    anchor; earlier: by (doc, lo + start). anchor: the anchor's place in the context."""
    size = np.array([len(c) for c in contexts])
    lead = -anchor % PERIOD
    room = -(-(lead + size) // PERIOD) * PERIOD
    base = np.cumsum(room) - room + lead
    total = int(room.sum())
    data = np.zeros(total + -(-width // PERIOD) * PERIOD + 16, np.uint8)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    data[np.repeat(base - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat
    table = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").ravel().astype(np.uint64)

    places = (np.arange(0, total, PERIOD)[:, None] + np.array(COVER)).ravel()
    rank = cover_ranks(table, places, width - REACH)

    windows = size - width + 1
    ctx = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(ctx)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = base[ctx] + start
    ahead = np.array([min(c - r if c >= r else c - r + PERIOD for c in COVER) for r in range(PERIOD)])
    head = ahead[place % PERIOD]
    sample = place + head
    slot = np.zeros(PERIOD, np.int64)
    slot[list(COVER)] = np.arange(len(COVER))

    before, behind = _words(table, place, head), _words(table, sample + width - REACH, REACH - head)
    key = (bucket[ctx] * 1024 + start - anchor[ctx], before, rank[len(COVER) * (sample // PERIOD) + slot[sample % PERIOD]], behind)
    order = np.lexsort((lo[ctx] + start, doc[ctx], *key[::-1]))
    again = np.ones(len(order), bool)
    again[:1] = False
    for k in key:
        k = k[order]
        again[1:] &= k[1:] == k[:-1]
    found = np.sort(order[again])
    return ctx[found], start[found]


def _runs(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Window starts -> (doc, lo, run), following ones together."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]) if len(doc) else np.zeros(0, np.int64)
    run = np.diff(np.r_[begin, len(doc)]) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(at[begin].astype(np.int32)), pa.array(run.astype(np.int32))], names=["doc", "lo", "run"])


def _sort_buckets(batches: Iterator[pa.RecordBatch], width: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, lo, at, near, far, body), buckets (key, near, far) standing
    together -> runs of repeated windows. A block ends with the bucket that fills it."""

    def of(rows: list[tuple]) -> pa.RecordBatch:
        key, near, far = (np.array([r[i] for r in rows], np.int64) for i in (0, 4, 5))
        new = np.r_[False, (key[1:] != key[:-1]) | (near[1:] != near[:-1]) | (far[1:] != far[:-1])]
        doc, lo, at = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        ctx, start = repeated_windows([r[6] for r in rows], at, np.cumsum(new), doc, lo, width)
        return _runs(doc[ctx], lo[ctx] + start)

    held: list[tuple] = []
    size = 0
    last = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            mark = row[0], row[4], row[5]
            if size >= block and mark != last:
                yield of(held)
                held, size = [], 0
            held.append(row)
            size += len(row[6])
            last = mark
    if held:
        yield of(held)


def sorted_buckets(contexts: DataFrame, width: int = WIDTH, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """contexts(key, doc, lo, at, body), a settled table: body starts at lo, its anchor is
    `at` bytes on. -> runs (doc, lo, run) of windows that are found earlier."""
    # A row holds the windows that begin between `far` and `near` bytes before the anchor.
    rows = contexts.select("key", "doc", "lo", "at", F.lit(0).alias("near"), F.lit(width - GRAM).alias("far"), "body")
    names, found = ["key", "near", "far"], None
    while True:
        hot = settle(rows.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > bucket).drop("n"), "hot")
        any_hot = hot.limit(1).count() > 0
        calm = rows.join(hot, names, "left_anti") if any_hot else rows
        ordered = calm.repartition(*names).sortWithinPartitions(*names).select("key", "doc", "lo", "at", "near", "far", "body")
        runs = settle(ordered.mapInArrow(lambda b: _sort_buckets(b, width, block), "doc long, lo int, run int"), "runs")
        found = runs if found is None else found.unionByName(runs)
        if not any_hot:
            return found
        middle = F.floor((F.col("near") + F.col("far")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("near").alias("near2"), middle.alias("far2")), F.struct((middle + 1).alias("near2"), F.col("far").alias("far2"))))
        part = rows.join(hot, names, "left_semi").where("near < far").select("key", "doc", "lo", "at", "body", halves.alias("h")).select("key", "doc", "lo", "at", "body", "h.*")
        # window starts s of the body with near <= at - s <= far
        part = part.withColumn("s", F.greatest(F.lit(0), F.col("at") - F.col("far2"))).withColumn("e", F.least(F.length("body") - width, F.col("at") - F.col("near2"))).where("s <= e")
        shared = F.substring("body", F.col("at") - F.col("near2") + 1, F.col("near2") + width - F.col("far2"))
        finer = part.select(
            F.xxhash64("key", "near2", "far2", shared).alias("key"), "doc", (F.col("lo") + F.col("s")).cast("int").alias("lo"), (F.col("at") - F.col("s")).cast("int").alias("at"), F.col("near2").alias("near"), F.col("far2").alias("far"),
            F.substring("body", F.col("s") + 1, F.col("e") - F.col("s") + width).alias("body"),
        )
        finer = settle(finer, "finer")
        place, same = F.struct("doc", "lo"), ["key", "near", "far", "at", "body"]
        firsts = settle(finer.groupBy(*same).agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")
        again = finer.join(firsts.where("n > 1").drop("n"), same).where(place != F.col("first"))
        found = found.unionByName(settle(again.select("doc", "lo", (F.length("body") - width).cast("int").alias("run")), "runs"))
        # of rows with one window left, those that remain differ
        rows = firsts.where("near < far").select("key", "first.doc", "first.lo", "at", "near", "far", "body")


def cut(text: bytes, lo: np.ndarray, run: np.ndarray, width: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, spans removed) without the windows."""
    if not len(lo):
        return text, 0, 0
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + run + width, -1)
    gone = np.cumsum(edge[:-1]) > 0
    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return left, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def repeated_runs(texts: DataFrame, anchors: DataFrame, width: int, **how) -> DataFrame:
    """texts(doc, bytes), anchors(ANCHORS) -> (doc, lo, run): all windows that are found
    earlier, those that begin at lo to lo + run together."""
    keyed = anchors.where("key IS NOT NULL")
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = settle(keyed.join(several, "key"), "met")

    spans = settle(copied_spans(met, width), "spans")
    mixed = met.groupBy("key").agg(F.min("ctx").alias("least"), F.max("ctx").alias("most")).where("least <> most").select("key")
    firsts = met.join(mixed, "key").groupBy("key", "ctx").agg(F.min(F.struct("doc", "spot")).alias("f")).select("key", "f.*")
    places = firsts.selectExpr("key", "doc", *PLACES)
    bodies = places.select("doc", "lo", (F.col("run") + width).alias("size"), "key", "at")
    no_key, no_at = F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("at")
    whole = spans.select("doc", F.col("start").alias("lo"), "size").unionByName(spans.select(F.col("of_doc").alias("doc"), F.col("of_start").alias("lo"), "size")).distinct()
    pieces = settle(_cut_out(texts, bodies.unionByName(whole.select("doc", "lo", "size", no_key, no_at))), "pieces")
    sums = pieces.where("key IS NULL")
    own = spans.join(sums.select("doc", F.col("lo").alias("start"), "size", F.col("body").alias("own")), ["doc", "start", "size"])
    told = settle(own.join(sums.select(F.col("doc").alias("of_doc"), F.col("lo").alias("of_start"), "size", F.col("body").alias("of")), ["of_doc", "of_start", "size"]).select("doc", "start", "size", (F.col("own") == F.col("of")).alias("same")), "told")
    copied = told.where("same").select("doc", F.col("start").alias("lo"), (F.col("size") - width).cast("int").alias("run"))
    contexts = pieces.where("key IS NOT NULL").select("key", "doc", "lo", "at", "body")

    wrong = told.where("not same")
    if wrong.limit(1).count():  # sums were equal and bytes aren't: all contexts of these keys are sorted
        placed = met.selectExpr("doc", "key", *PLACES)
        inside = (placed["doc"] == wrong["doc"]) & (placed["lo"] >= wrong["start"]) & (placed["lo"] + placed["run"] + width <= wrong["start"] + wrong["size"])
        keys = settle(placed.join(wrong, inside, "left_semi").select("key").distinct(), "unclear")
        unclear = placed.join(keys, "key", "left_semi").select("doc", "lo", (F.col("run") + width).alias("size"), "key", "at")
        contexts = settle(contexts.join(keys, "key", "left_anti").unionByName(_cut_out(texts, unclear).select("key", "doc", "lo", "at", "body")), "contexts")
    return anchors.where("key IS NULL").selectExpr("doc", *PLACES[:2]).unionByName(copied).unionByName(sorted_buckets(contexts, width, **how))


def removed_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, batch: int = BATCH, carry: tuple[str, ...] = (), left: str = "bytes", **how) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, carry (a struct of
    the columns named so), and kept: the bytes that are left, or with left="text" what
    of them is whole characters, or nothing with left="".

    Null text is empty. Rows that repeat an id count as different documents, in an order
    that follows their texts, as do null ids, which come after all others; other
    columns are left out; an empty table gives no rows."""
    rows, names = numbered_documents(docs, doc_id, text, carry)
    anchors = settle(anchors_of(rows, width, batch), "anchors")
    texts = rows.select("doc", F.col("text").cast("binary").alias("bytes"))
    gone = repeated_runs(texts, anchors, width, **how).groupBy("doc").agg(F.collect_list(F.struct("lo", "run")).alias("gone"))
    # all but the text meets first, so that texts are joined once more and not moved again
    extra = ["carry"] if carry else []
    side = names.join(gone, "doc", "left").select("doc", "doc_id", *extra, "gone")
    joined = texts.join(side, "doc").drop("doc")
    schema = joined.select("doc_id", *extra).select("*", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit("").alias("kept_sha256"), F.lit("" if left == "text" else b"").alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            of = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            flat, edges = of["gone"].flatten(), np.r_[0, np.cumsum(pc.list_value_length(of["gone"]).fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
            lo, length = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for i, body in enumerate(of["bytes"]):
                body = body.as_py()
                rest, n, spans = cut(body, lo[edges[i] : edges[i + 1]], length[edges[i] : edges[i + 1]], width)
                shown = rest.decode("utf-8", "ignore") if left == "text" else rest if left else b""
                for to, x in zip(out, (len(body), n, spans, hashlib.sha256(rest).hexdigest(), shown), strict=True):
                    to.append(x)
            made = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if left == "text" else pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([of["doc_id"], *(of[x] for x in extra), *made], names=["doc_id", *extra, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, schema)
