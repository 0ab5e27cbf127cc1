"""Operators over documents, against brute force and on odd inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lectern.llm import bpe, exact_dedup, packing, quality, simhash, suffix_dedup, toxicity
from lectern.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    passage, shared = words(rng, 60), words(rng, 300)
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 4), (3, "one", "en", "b", 3), (3, "one", "en", "b", 3), (None, "two words", None, "b", 9), (4, "o n\te", "en", "b", 5)]
    rows += [(10 + i, words(rng, 200) + " " + passage + " " + words(rng, 40), "en", "c", 1) for i in range(4)]
    rows += [(20 + i, shared, "en", "c", 1) for i in range(12)]
    rows += [(40 + i, shared + " " + words(rng, 1), "en", "d", 1) for i in range(6)]
    rows += [(60, "é" * 9000 + "<|endoftext|>" + "ab " * 3000, "fr", "d", 1), (61, "x" * 30_000, "en", "d", 1), (62, "x" * 120, "en", "d", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_is_the_library(spark, docs, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    got = Counter(tuple(r) for r in bpe.round_trip(docs, vocabulary()).collect())
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(empty(spark), vocabulary()).count() == 0


def test_bpe_words_of_all_kinds():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x4E00, 0x9FFF), 0x1F600, 10, 9, 0xA0])) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    library, own = Tokenizer.from_file(vocabulary()), bpe.codec(vocabulary())
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids).decode() == t
    assert own.decode(np.array([999_999, 0], "<u4").tobytes()) == b"!"


def test_bpe_columns(spark, docs):
    rows = bpe.decode_documents(bpe.encode_documents(docs.withColumnRenamed("lang", "ids"), vocabulary()), vocabulary())
    assert "ids" in rows.columns and rows.where("decoded <> coalesce(text, '')").count() == 0


def by_key(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((i, t))
    return groups


@pytest.mark.parametrize("how", [{}, {"block_chars": 7, "bucket_rows": 3}, {"block_chars": 50, "bucket_rows": 9, "key": "weak"}])
def test_exact_dedup_against_brute_force(spark, docs, odd_rows, how):
    from pyspark.sql import functions as F

    if how.get("key") == "weak":  # keys that collide all the time
        how = how | {"key": lambda block: F.length(block).cast("long") % 3}
    got = exact_dedup.exact_duplicates(docs, **how).collect()
    groups = by_key([(i, t) for i, t, *_ in odd_rows])
    kept = Counter()
    for r in got:
        own = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(own))
        if r.kept:
            assert r.doc_id == best[0]
            kept[r.text_sha256] += 1
    assert len(got) == len(odd_rows) and set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_without_copies_keeps_whole_rows(docs, odd_rows):
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns and left.count() == len(by_key([(i, t) for i, t, *_ in odd_rows]))


def slow_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    grams = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def slow_components(prints):
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    kinds = sorted(set(prints))
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= 2:
                root[top(a)] = top(b)
    return {p: top(p) for p in kinds}


def test_simhash_against_brute_force(spark, docs, odd_rows):
    got = simhash.near_duplicates(docs).collect()
    prints = [slow_fingerprint(t) for _, t, *_ in odd_rows]
    root = slow_components(prints)
    least = {}
    for (i, *_), p in zip(odd_rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((i, f"{p:016x}", least.get(root[p])) for (i, *_), p in zip(odd_rows, prints, strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("group", [4096, 5])
def test_near_links_find_all_components(spark, group):
    rng = random.Random(7)
    codes = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for c in list(codes)[:60]:
        for _ in range(3):
            c ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            codes.add(c)
    base = rng.getrandbits(64)
    codes |= {base ^ rng.getrandbits(12) for _ in range(300)}
    rows = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp long")
    links = simhash.near_links(rows, group=group)
    found = {r.node & simhash.ALL: r.root & simhash.ALL for r in simhash.connected_components(links).collect()}
    root = slow_components(codes)
    assert Counter(Counter(found.get(c, c) for c in codes).values()) == Counter(Counter(root.values()).values())
    assert all(root[c] == root[found.get(c, c)] for c in codes)


def slow_removal(rows, width=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(w)
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"bucket": 3, "batch": 3000, "block": 2000}])
def test_passages_against_brute_force(spark, docs, odd_rows, how):
    got = suffix_dedup.removed_passages(docs, **how).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == slow_removal([r[:2] for r in odd_rows])
    unique = [r for r in {r[0]: r for r in odd_rows}.values() if r[0] is not None]
    rows = spark.createDataFrame(unique, DOCS)
    got = suffix_dedup.removed_passages(rows, left="text", carry=("lang", "source"), **how).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == slow_removal([r[:2] for r in unique])
    assert suffix_dedup.removed_passages(empty(spark)).count() == 0


def test_cover_reaches():
    c, n = suffix_dedup.COVER, suffix_dedup.PERIOD
    assert {(a - b) % n for a in c for b in c} == set(range(n))
    assert all(any((r + g) % n in c for g in range(suffix_dedup.REACH + 1)) for r in range(n))


def test_packing_is_exact(spark, docs, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    got = packing.pack(docs, vocabulary(), group_pieces=8).toPandas()
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            want[i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    keys = got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(object).where(got.notna(), None)
    assert Counter((None if i is None else int(i), *map(int, r)) for i, *r in keys.itertuples(index=False)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 1024
    assert packing.pack(empty(spark), vocabulary()).count() == 0


def test_first_fit_decreasing_is_the_rule():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 500)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room = []
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(100)
        assert (bins[i], offsets[i]) == (at, 100 - room[at])
        room[at] -= lengths[i]


def labelled(spark, mark, n=400):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        text = words(rng, 40) + (f" {mark} " if bad else " ") + words(rng, 10)
        rows.append((i, text, "en", f"https://h{i % 5}.example/{i % 2}/x", len(text)))
        labels.append((i, 0 if bad else 1, 1 if bad else 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_holds_out(spark, docs):
    rows, labels = labelled(spark, "qqzzq")
    got = toxicity.toxicity(rows, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == got["toxic"])[got["held_out"]].mean() > 0.95
    again = toxicity.toxicity(rows.withColumnRenamed("lang", "score"), labels).toPandas()
    assert sorted(again["score"]) == sorted(got["score"])


def test_toxicity_on_odd_rows(spark, docs, odd_rows):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = labels.where("false")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(empty(spark), none).count() == 0


def test_label_model_finds_accuracy_and_correlation():
    rng = np.random.default_rng(4)
    y = rng.random(40_000) < 0.3
    votes = np.zeros((40_000, toxicity.VOTERS))
    for j in range(8):
        votes[:, j] = rng.random(40_000) < np.where(y, 0.7, 0.01)
    votes[:, 7] = votes[:, 6]  # one voter twice
    votes[:, 8] = rng.random(40_000) < 0.1  # and one that knows nothing
    truth = y ^ (rng.random(40_000) < 0.02)
    off = votes - votes.mean(axis=0)
    direction = (off * (truth - truth.mean())[:, None]).mean(axis=0) / (off.std(axis=0) * truth.std() + 1e-9)
    model = toxicity.LabelModel(votes.T @ votes, len(votes), 0.3, direction, len(votes))
    assert model.correlated[6, 7] and not model.correlated[0, 1]
    assert model.weights[7] < 0.8 * model.weights[0] and model.weights[8] == 0
    # Bayes by hand: of the texts on which voter 0 fires, so many are toxic
    assert abs(model.precision[0] - y[votes[:, 0] == 1].mean()) < 0.05
    assert ((model.odds(votes) > 0) == y).mean() > 0.9


def test_voters_overrule_a_wrong_label_and_silence_keeps_the_prior():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.2
    votes = np.zeros((20_000, toxicity.VOTERS))
    for j in range(6):
        votes[:, j] = rng.random(20_000) < np.where(y, 0.6, 0.01)
    off = votes - votes.mean(axis=0)
    direction = (off * (y - y.mean())[:, None]).mean(axis=0) / (off.std(axis=0) * y.std() + 1e-9)
    model = toxicity.LabelModel(votes.T @ votes, len(votes), 0.2, direction, len(votes))
    three, none = np.zeros((1, toxicity.VOTERS)), np.zeros((1, toxicity.VOTERS))
    three[0, :3] = 1
    assert model.odds(three, np.array([0.0]))[0] > 0 > model.odds(three * [0], np.array([0.0]))[0]
    assert abs(1 / (1 + np.exp(-model.odds(none)[0])) - 0.2) < 0.01
    assert model.speaks(three)[0] and not model.speaks(none)[0]
    assert all(abs(x) <= toxicity.OWN < toxicity.FIRM for x in model.own)


def test_unlabelled_rows_are_trained_on_posterior_labels(spark, monkeypatch):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        rows.append((i, words(rng, 40) + (f" {rng.choice(toxicity.SEEDS[0][:6])} " if bad else " ") + words(rng, 5)))
        if i < 500:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    seen, fit = [], toxicity.fit_sparse
    monkeypatch.setattr(toxicity, "fit_sparse", lambda rows, cols, m, target: seen.append(target) or fit(rows, cols, m, target))
    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    given = {w for x in toxicity.SEEDS for w in x}
    spoken = sum(learn(i) and i >= 500 and bool(given & set(t.split())) for i, t in rows)
    for unlabelled in (0, 1000):
        weight, _ = toxicity.classifier(docs, marks, "doc_id", "text", "toxic", 1000, unlabelled)
        assert weight[toxicity.terms(b"idiot")[0]] > 0
    own, more = map(len, seen)
    assert own == sum(learn(i) for i in range(500)) and more == own + spoken
    assert seen[0].min() < 0.1 < 0.9 < seen[0].max()


def test_quality_learns_and_shrinks(spark, docs, odd_rows):
    rows, labels = labelled(spark, "### $$$ ||| ### $$$ |||")
    got = quality.scored(rows.withColumnRenamed("n_chars", "score"), labels).join(labels, "doc_id").toPandas()
    assert (got["predicted"] == got["quality"])[got["held_out"]].mean() > 0.95
    odd = quality.scored(docs, labels)
    assert odd.count() == len(odd_rows)
    none = labels.where("false")
    assert {r.text_odds for r in quality.scored(docs, none).collect()} == {0.0}
    assert quality.scored(empty(spark), none).count() == 0


def test_quality_against_brute_force(spark):
    """Sites by loops over all rows, from the text's evidence; the text model by its gradient."""
    rows, labels = labelled(spark, "### $$$ ||| ### $$$ |||", 300)
    got = {r.doc_id: r for r in quality.scored(rows, labels).collect()}
    texts = {r.doc_id: r for r in rows.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    x = quality.expanded(np.array([quality.statistics(texts[i].text.encode()) for i in sorted(known)]))
    y = np.array([known[i] for i in sorted(known)], float)
    center, scale, w = quality.fit_logistic(x, y)
    z = np.hstack([(x - center) / scale, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    assert np.abs(z.T @ (y - p) - np.r_[w[:-1], 1e-6 * w[-1]]).max() < 1e-4
    assert all(abs(got[i].text_odds - np.clip(z[k] @ w, -20, 20)) < 1e-6 for k, i in enumerate(sorted(known)))

    def sums(of):
        out = defaultdict(lambda: [0.0, 0.0])
        for i, r in got.items():
            weight = 1.0 if i in known else quality.UNLABELLED
            good = known.get(i, 1 / (1 + np.exp(-r.text_odds)))
            out[of(texts[i].source)][0] += weight
            out[of(texts[i].source)][1] += weight * good
        return out

    def strength(sites, rate):
        many = [(g / n - rate(s), rate(s) * (1 - rate(s)), n) for s, (n, g) in sites.items() if n > 1]
        between = sum(d * d - v / n for d, v, n in many) / len(many)
        return float(np.clip(sum(v for _, v, _ in many) / len(many) / max(between, 1e-4) - 1, 2, 1000))

    host = lambda s: s.split("/")[2]
    path = lambda s: "/".join(s.split("/")[2:4])
    hosts, paths = sums(host), sums(path)
    overall = sum(g for _, g in paths.values()) / sum(n for n, _ in paths.values())
    prior = strength(hosts, lambda _: overall)
    host_rate = {h: (g + prior * overall) / (n + prior) for h, (n, g) in hosts.items()}
    prior = strength(paths, lambda s: host_rate[s.split("/")[0]])
    logit = lambda q: np.log(q / (1 - q))
    for i, r in got.items():
        n, g = paths[path(texts[i].source)]
        rate = np.clip((g + prior * host_rate[host(texts[i].source)]) / (n + prior), 0.01, 0.99)
        site = logit(rate) - logit(overall)
        assert abs(r.site_odds - site) < 1e-6
        assert abs(r.score - 1 / (1 + np.exp(-(r.text_odds + quality.SITE_SHARE * site)))) < 1e-6


def test_sparse_sites_stay_near_the_global_rate(spark):
    rows = [("big", "big/a", 1, 0.0)] * 400 + [("bad", "bad/a", 0, 0.0)] * 300 + [("small", "small/a", 0, 0.0)]
    odds = {r.host: r.site_odds for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, quality int, evidence double")).collect()}
    assert odds["big"] > 1 and odds["bad"] < -1 and odds["bad"] < odds["small"] < 0.5


def test_long_documents_in_segments():
    rng = random.Random(9)
    texts = [(i, words(rng, 400).encode()) for i in range(3)]
    texts.append((3, texts[0][1][300:1500] + texts[1][1][:900]))
    windows = lambda s: sorted((r["doc"], (r["spot"] >> 16) + k) for r in suffix_dedup._contexts(texts, 100, s).to_pylist() for k in range((r["spot"] >> 8 & 255) + 1))
    assert windows(137) == windows(1 << 20) == sorted((i, p) for i, t in texts for p in range(len(t) - 99))


def test_passages_when_sums_say_too_much(spark, docs, odd_rows, monkeypatch, tmp_path):
    """Sums that confuse contexts cost time, never bytes that don't repeat."""
    rng = random.Random(11)
    line = words(rng, 60).encode()
    texts = [(n, line + words(rng, 10).encode() + bytes(rng.choice(b"ab") for _ in range(40))) for n in range(30)]
    sums = suffix_dedup.span_sums
    monkeypatch.setattr(suffix_dedup, "span_sums", lambda *x: sums(*x) & np.uint64(1))
    made = suffix_dedup._contexts(texts, 100, 1000).to_pylist()
    body, by_key = dict(texts), {}
    for r in made:
        if r["key"] is None:
            lo, size = r["spot"] >> 16, (r["spot"] >> 8 & 255) + 100
            assert any(body[o["doc"]][(at := o["spot"] >> 16) : at + size] == body[r["doc"]][lo : lo + size] for o in made if (o["doc"], o["spot"]) < (r["doc"], r["spot"]))
        else:
            by_key.setdefault((r["key"], r["ctx"]), []).append(r)
    assert max(map(len, by_key.values())) > 1
    rows = [(n, b.decode()) for n, b in texts]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    anchors = spark.createDataFrame([tuple(r.values()) for n, t in texts for r in suffix_dedup._contexts([(n, t)], 100, 1000).to_pylist()], suffix_dedup.ANCHORS)
    monkeypatch.setattr(suffix_dedup, "anchors_of", lambda *_: anchors)
    got = suffix_dedup.removed_passages(table, left="").drop("kept").collect()
    assert Counter(tuple(r) for r in got) == slow_removal(rows)
