"""Alignment of two tokenizers over a corpus, by inverted pair bitmaps.

Where the tokens of both end at one byte, a text is cut into groups; tokens whose bytes
overlap are linked. Postings are kept by pair of ids and block of documents: compressed
bitmaps of the documents that hold the pair, one for each binary digit of how often they
do. Documents' bits are OR-ed together word by word; counts of documents are set bits of
the planes' union, counts of links the planes' set bits by their weight. The corpus-wide
counts go back along the postings and are added up for each document.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import LONGEST_GUESS, Codec, texts_of
from lectern.llm.common import settle
from lectern.llm.piece_bpe import BLANK, WORD, PieceCodec

#: Stretches that both tokenizers take apart: a blank after another visible character
#: begins a new one.
STRETCH = re.compile(r" *+(?:[^ ]++(?:(?<=\s) ++)?+)++| ++")
#: Stretches kept by a worker, characters whose stretches are listed at once, stretches of
#: a long text listed at once, stretches aligned at once; postings and documents of a block.
CACHE, CHUNK_CHARS, LISTED, AT_ONCE, POSTINGS, DOCUMENTS = 200_000, 1_000_000, 500_000, 50_000, 4_000_000, 1 << 16
#: A word of a bitmap: the digit it belongs to, its place, the bits of 16 documents.
WORDS = np.dtype([("plane", "u1"), ("at", "<u2"), ("bits", "<u2")])
ROWS = 50_000


def flat_bytes(codec: Codec, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, id) of all words by the byte-level tokenizer, in order: longest
    matches, pairs checked, failing words merged."""
    raw = [w.encode("utf-8", "replace") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    short = np.flatnonzero((size > 0) & (size <= LONGEST_GUESS))
    word, token = codec.propose([raw[i] for i in short.tolist()]) if len(short) else (short, short)
    inner = np.flatnonzero(word[1:] == word[:-1])
    pair, back = np.unique(token[inner] << 32 | token[inner + 1], return_inverse=True)
    failed = np.zeros(len(short), bool)
    failed[word[inner[~codec.compatible(pair >> 32, pair & 0xFFFFFFFF)[back]]]] = True
    good = ~failed[word]
    numbers, tokens = [short[word[good]]], [token[good]]
    again = short[failed]
    if len(again):
        word, token = codec.merge_all([raw[i] for i in again.tolist()])
        numbers.append(again[word])
        tokens.append(token)
    for i in np.flatnonzero(size > LONGEST_GUESS).tolist():
        tokens.append(np.array(codec.merged(raw[i]), np.int64))
        numbers.append(np.full(len(tokens[-1]), i))
    number, token = np.concatenate(numbers), np.concatenate(tokens)
    order = np.argsort(number, kind="stable")
    return number[order], token[order]


def cuts_of(number: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of n numbers begin, and the end."""
    return np.searchsorted(number, np.arange(n + 1))


def decimals(token: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, each with its mark after it, and where each ends."""
    digits = np.ones(len(token), np.int64)
    top = 10
    while (token >= top).any():
        digits += token >= top
        top *= 10
    ends = np.cumsum(digits + 1)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - 1] = mark
    rest, at = token.copy(), ends - 2
    live = np.arange(len(token))
    while len(live):
        out[at[live]] = 48 + rest[live] % 10
        rest[live] //= 10
        at[live] -= 1
        live = live[rest[live] > 0]
    return out, ends


class Aligner:
    """Both tokenizers over stretches of text."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.a, self.b = Codec(bytes_path), PieceCodec(pieces_path)  # special tokens' strings are plain text
        a_bytes = [self.a.token_bytes.get(i, b"") for i in range(max(self.a.token_bytes) + 1)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, self.b.token_bytes))
        #: Stretch to its entry in words of 64 bits: links, tokens of A, length of the text of its
        #: groups, the links, that text with a mark after it; empty if the bytes differ. When
        #: it is full it becomes the older one, from which what is met again comes back.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, stretches: Collection[str]) -> None:
        """Puts unknown stretches into the cache, which then has all of them."""
        if len(self.cache) + len(stretches) > CACHE:
            self.older, self.cache = self.cache, {}
        new = []
        for s in stretches:
            if s not in self.cache:
                if s in self.older:
                    self.cache[s] = self.older[s]
                else:
                    new.append(s)
        # a piece's mark for a blank spells a blank, so a text that holds the mark isn't spelled
        self.cache.update((s, b"") for s in new if BLANK in s)
        new = [s for s in new if BLANK not in s]
        # stretches that end in a blank stand before nothing but the end of a text
        for some in ([s for s in new if not s[-1].isspace()], *([s] for s in new if s[-1].isspace())):
            for at in range(0, len(some), AT_ONCE):
                self._align(some[at : at + AT_ONCE])

    def _tokens(self, stretches: list[str], blank: str, words_of: re.Pattern, flat: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, id) in order; distinct words are encoded once."""
        words = words_of.findall("".join(stretches).replace(" ", blank))
        numbers: dict[str, int] = defaultdict(count().__next__)
        which = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        owner = np.searchsorted(np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches))), np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        number, token = flat([*numbers])
        cuts = cuts_of(number, len(numbers))
        size = np.diff(cuts)[which]
        return np.repeat(owner, size), token[ragged(cuts[which], size)]

    def _align(self, stretches: list[str]) -> None:
        if not stretches:
            return
        n = len(stretches)
        in_a, a = self._tokens(stretches, " ", self.a.words_re if not self.a.usual_re.fullmatch("".join(stretches)) else self.a.plain_re, lambda w: flat_bytes(self.a, w))
        in_b, b = self._tokens(stretches, BLANK, WORD, self.b.flat)
        # do tokens of both spell the text?
        raw = np.fromiter((len(s.encode("utf-8", "replace")) for s in stretches), np.int64, n)
        same = (np.bincount(in_a, self.a_size[a], n) == raw) & (np.bincount(in_b, self.b_size[b], n) == raw)
        for i in np.flatnonzero(~same).tolist():
            self.cache[stretches[i]] = b""
        keep_a, keep_b = same[in_a], same[in_b]
        in_a, a, in_b, b = in_a[keep_a], a[keep_a], in_b[keep_b], b[keep_b]
        if not len(a):
            return
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        over = np.cumsum(np.where(same, raw, 0))  # where stretches end
        groups = np.intersect1d(end_a, end_b, assume_unique=True)
        cells = np.union1d(end_a, end_b)  # each piece between ends is one link
        link = a[np.searchsorted(end_a, cells)] << 32 | b[np.searchsorted(end_b, cells)]
        link_cuts = np.r_[0, np.searchsorted(cells, over, side="right")]
        links = link.tobytes()
        side = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
        group = np.r_[np.searchsorted(groups, end_a), np.searchsorted(groups, end_b)]
        order = np.argsort(group * 2 + side, kind="stable")
        side, group, token = side[order], group[order], np.r_[a, b][order]
        last = np.r_[(side[1:] != side[:-1]) | (group[1:] != group[:-1]), True]
        text, ends = decimals(token, np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(",")))
        text, ends = text.tobytes(), np.r_[0, ends]
        text_cuts = ends[np.r_[0, np.searchsorted(group, np.searchsorted(groups, over, side="right"))]]
        head = np.stack([np.diff(link_cuts), np.bincount(in_a, minlength=n), np.diff(text_cuts)], axis=1).tobytes()
        pad = [bytes(k) for k in (0, 7, 6, 5, 4, 3, 2, 1)]
        link_at, text_at = (link_cuts * 8).tolist(), text_cuts.tolist()
        for i in np.flatnonzero(same).tolist():
            own = text[text_at[i] : text_at[i + 1]]
            self.cache[stretches[i]] = b"".join((head[24 * i : 24 * i + 24], links[link_at[i] : link_at[i + 1]], own, pad[len(own) & 7]))

    def documents(self, texts: list[str]) -> Iterator[tuple[str, int, int, int, np.ndarray]]:
        """(SHA-256 of the groups, tokens of A, of B, groups, links) of each text."""
        held: list[list[str]] = []
        size = 0
        for t in texts:
            if len(t) > 8 * CHUNK_CHARS:
                yield from self._listed(held)
                held, size = [], 0
                yield self._long(t)
                continue
            held.append(STRETCH.findall(" " + t) if t else [])
            size += len(t)
            if size > CHUNK_CHARS:
                yield from self._listed(held)
                held, size = [], 0
        yield from self._listed(held)

    def _listed(self, listed: list[list[str]]) -> Iterator[tuple[str, int, int, int, np.ndarray]]:
        sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        numbers: dict[str, int] = defaultdict(count().__next__)
        which = np.fromiter(map(numbers.__getitem__, chain.from_iterable(listed)), np.int64, int(sizes.sum()))
        self.learn(numbers.keys())
        raw = [*map(self.cache.__getitem__, numbers)]
        words = np.frombuffer(b"".join(raw), np.int64)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) >> 3
        first = np.cumsum(size) - size
        spelled = size > 0
        n_links, n_a, n_text = (np.where(spelled, words[np.minimum(first + i, max(0, len(words) - 1))], 0) if len(words) else np.zeros(len(raw), np.int64) for i in range(3))
        # links and texts of all stretches, in the order of the documents
        link = words[ragged(first[which] + 3, n_links[which])]
        text = words.view(np.uint8)[ragged((first[which] + 3 + n_links[which]) * 8, n_text[which])]
        cuts = np.r_[0, np.cumsum(sizes)]
        bad, a_sum, link_cut, text_cut = (np.r_[0, np.cumsum(x[which])][cuts] for x in (~spelled, n_a, n_links, n_text))
        marks = np.r_[0, np.cumsum(text == ord(";"))][text_cut]
        text, empty = text.tobytes(), ("", 0, 0, 0, np.zeros(0, np.int64))
        for s, e, wrong, s_link, e_link, s_text, e_text, in_a, groups in zip(*(x[:-1].tolist() if d < 0 else x[1:].tolist() if d > 0 else np.diff(x).tolist() for x, d in ((cuts, -1), (cuts, 1), (bad, 0), (link_cut, -1), (link_cut, 1), (text_cut, -1), (text_cut, 1), (a_sum, 0), (marks, 0))), strict=True):
            if s == e or wrong:
                yield empty
            else:
                yield hashlib.sha256(memoryview(text)[s_text : e_text - 1]).hexdigest(), in_a, e_link - s_link + groups - in_a, groups, link[s_link:e_link]

    def _long(self, text: str) -> tuple[str, int, int, int, np.ndarray]:
        sha, n_a, groups, links, more = hashlib.sha256(), 0, 0, [], STRETCH.finditer(" " + text)
        while stretches := [m.group() for m in islice(more, LISTED)]:
            self.learn(set(stretches))
            found = [self.cache[s] for s in stretches]
            if b"" in found:
                return "", 0, 0, 0, np.zeros(0, np.int64)
            heads = np.frombuffer(b"".join([x[:24] for x in found]), np.int64).reshape(-1, 3)
            part = b"".join([x[24 + 8 * n : 24 + 8 * n + t] for x, (n, _, t) in zip(found, heads.tolist(), strict=True)])
            sha.update(b";" + part[:-1] if groups else part[:-1])
            n_a, groups = n_a + int(heads[:, 1].sum()), groups + part.count(b";")
            links.append(np.frombuffer(b"".join([x[24 : 24 + 8 * n] for x, n in zip(found, heads[:, 0].tolist(), strict=True)]), np.int64))
        link = np.concatenate(links)
        return sha.hexdigest(), n_a, len(link) + groups - n_a, groups, link


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at first and have size items each."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def bitmaps(pair: np.ndarray, document: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of postings (pair, document in the block, times), each pair and document once: the
    pairs, the bitmap words of all of them, where each pair's words end, and its counts of
    documents and links."""
    order = np.lexsort((document, pair))
    pair, document, times = pair[order], document[order], times[order]
    first = np.r_[True, pair[1:] != pair[:-1]]
    number = np.cumsum(first) - 1
    words, owner = [], []
    for plane in range(int(times.max()).bit_length()):
        one = np.flatnonzero(times >> plane & 1)
        if not len(one):
            continue
        own, at = number[one], document[one] >> 4
        start = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1])])
        made = np.zeros(len(start), WORDS)
        made["plane"], made["at"] = plane, at[start]
        made["bits"] = np.bitwise_or.reduceat(np.uint16(1) << (document[one] & 15).astype(np.uint16), start)
        words.append(made)
        owner.append(own[start])
    words, owner = np.concatenate(words), np.concatenate(owner)
    # the union of the planes, word by word, for documents
    by_place = np.lexsort((words["at"], owner))
    own, at, bits = owner[by_place], words["at"][by_place], words["bits"][by_place]
    start = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1])])
    some = np.bitwise_count(np.bitwise_or.reduceat(bits, start)).astype(np.int64)
    n = int(number[-1]) + 1
    documents, links = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(documents, own[start], some)
    np.add.at(links, owner, np.bitwise_count(words["bits"]).astype(np.int64) << words["plane"].astype(np.int64))
    order = np.argsort(owner, kind="stable")
    return pair[first], words[order], np.cumsum(np.bincount(owner, minlength=n)), documents, links


def postings(docs: DataFrame, bytes_path: str, pieces_path: str, doc_id: str, text: str, most: int) -> DataFrame:
    """Rows of documents (pair is null) and of pairs in blocks, from one pass over docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"block long, place int, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, words binary, documents long, links long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(bytes_path, pieces_path)
        block = TaskContext.get().partitionId() << 32
        held, told, pairs, times, places, size = [], [], [], [], [], 0
        names = ["block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "words", "documents", "links"]
        kinds: dict[str, pa.DataType] = {}

        def table(n: int, **columns: pa.Array) -> pa.RecordBatch:
            full = {"block": pa.array(np.full(n, block)), **columns}
            return pa.RecordBatch.from_arrays([full[c] if c in full else pa.nulls(n, kinds[c]) for c in names], names=names)

        def closed() -> Iterator[pa.RecordBatch]:
            sha, n_a, n_b, groups, links = zip(*told, strict=True)
            made = dict(zip(names[3:8], (pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.int64()), pa.array(links, pa.int64()), pa.array(sha, pa.string())), strict=True))
            yield table(len(told), place=pa.array(np.arange(len(told), dtype=np.int32)), doc_id=pa.concat_arrays(held), **made)
            if not size:
                return
            pair, words, ends, documents, n = bitmaps(np.concatenate(pairs), np.repeat(np.array(places), [len(x) for x in pairs]), np.concatenate(times))
            for s in range(0, len(pair), ROWS):
                e = min(s + ROWS, len(pair))
                low = int(ends[s - 1]) if s else 0
                offsets = np.r_[0, ends[s:e] - low].astype(np.int32) * WORDS.itemsize
                data = pa.BinaryArray.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words[low : ends[e - 1]].tobytes())])
                yield table(e - s, pair=pa.array(pair[s:e]), words=data, documents=pa.array(documents[s:e]), links=pa.array(n[s:e]))

        for b in batches:
            kinds = {"place": pa.int32(), "doc_id": b.column(0).type, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pair": pa.int64(), "words": pa.binary(), "documents": pa.int64(), "links": pa.int64()}
            at = 0
            for n, (sha, n_a, n_b, groups, links) in enumerate(own.documents(texts_of(b.column(1)))):
                if len(links):
                    pair, often = np.unique(links, return_counts=True)
                    pairs.append(pair)
                    times.append(often)
                    places.append(len(told))
                    size += len(pair)
                told.append((sha, n_a, n_b, groups, len(links)))
                if size >= most or len(told) == DOCUMENTS:
                    held.append(b.column(0).slice(at, n + 1 - at))
                    at = n + 1
                    yield from closed()
                    block += 1
                    held, told, pairs, times, places, size = [], [], [], [], [], 0
            if at < b.num_rows:
                held.append(b.column(0).slice(at))
        if told:
            yield from closed()

    return rows.mapInArrow(run, schema)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One for each worker process."""
    key = bytes_path, pieces_path
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


@dataclass
class Alignment:
    """documents: a row for each row of the corpus; pairs: a_id, b_id, documents (that hold
    the pair linked), links (how many, in all), best (no pair of this B id has more links)."""

    documents: DataFrame
    pairs: DataFrame


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, doc_id: str = "doc_id", text: str = "text", block: int = POSTINGS) -> Alignment:
    """Alignment of a byte-level tokenizer (A) and a piece model (B, which adds a blank)
    over space and text of each row of docs.

    Null and empty texts, and such whose tokens don't spell them, have no tokens, zeros and
    an empty groups_sha256. Rows that repeat are documents of their own, a null id is kept.
    A block holds 65 536 documents and, but for its last document, `block` postings at most; a pair has one row in a block, however often it occurs. Other columns are left
    out; an empty table gives no rows."""
    made = settle(postings(docs, bytes_path, pieces_path, doc_id, text, block), "postings")
    held = made.where(F.col("pair").isNotNull()).select("block", "pair", "words", "documents", "links")
    counts = held.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    counts = counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy(b_id)))
    counts = settle(counts, "pair-counts")
    # bitmaps move once, to their block; counts come there by pair and block
    back = held.select("block", "pair").join(counts.select("pair", F.col("links").alias("count"), "best"), "pair")
    columns = ["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    told = made.where(F.col("pair").isNull()).select("block", F.lit(0).alias("kind"), *columns)
    both = told.unionByName(back.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.unionByName(held.select("block", F.lit(2).alias("kind"), "pair", "words"), allowMissingColumns=True)
    dealt = both.repartition("block").sortWithinPartitions("block", "kind", "place", "pair")
    pairs = counts.select(F.shiftright("pair", 32).alias("a_id"), b_id.alias("b_id"), "documents", "links", "best")
    return Alignment(added_up(dealt), pairs)


def added_up(dealt: DataFrame) -> DataFrame:
    """The documents of each block with what its postings bring back. Rows come by block,
    documents first, then counts of pairs, then bitmaps, in order."""
    id_type = dealt.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, told, counts = None, [], []
        best, total = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def closed() -> Iterator[pa.RecordBatch]:
            if told:
                rows = pa.Table.from_batches(told).combine_chunks().to_batches()[0]
                values = [rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(best[: len(rows)]), pa.array(total[: len(rows)]), rows.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(values, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        for b in batches:
            blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(blocks)]
            for s, e in zip(cuts, cuts[1:]):
                if blocks[s] != block:
                    yield from closed()
                    block, told, counts = blocks[s], [], []
                    best, total = np.zeros(DOCUMENTS, np.int64), np.zeros(DOCUMENTS, np.int64)
                part = b.slice(s, e - s)
                if kinds[s] == 0:
                    told.append(part)
                elif kinds[s] == 1:
                    counts.append([part.column("pair").to_numpy(), part.column("count").to_numpy(), part.column("best").to_numpy(zero_copy_only=False).astype(np.int64)])
                else:
                    if len(counts) > 1:
                        counts = [[np.concatenate(x) for x in zip(*counts, strict=True)]]
                    add_postings(part, *counts[0], best, total)
        yield from closed()

    return dealt.mapInArrow(run, out)


def add_postings(rows: pa.RecordBatch, pair: np.ndarray, count: np.ndarray, good: np.ndarray, best: np.ndarray, total: np.ndarray) -> None:
    """Adds each pair's count, and 1 if it is the best, to all documents of its bitmap, as
    often as they hold it. pair: all pairs of the block, in order."""
    words = rows.column("words").to_pylist()
    flat = np.frombuffer(b"".join(words), WORDS)
    row = np.repeat(np.searchsorted(pair, rows.column("pair").to_numpy()), [len(w) // WORDS.itemsize for w in words])
    bits = np.unpackbits(np.ascontiguousarray(flat["bits"]).view(np.uint8), bitorder="little")
    where = np.flatnonzero(bits)
    word = where >> 4
    place = (flat["at"][word].astype(np.int64) << 4) + (where & 15)
    plane = flat["plane"][word].astype(np.int64)
    np.add.at(total, place, count[row[word]] << plane)
    np.add.at(best, place, good[row[word]] << plane)
