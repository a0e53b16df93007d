"""The training-data operators against brute force, libraries and round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillbom.llm import html_text, licenses, maxent_lm, overlap, packing, piece_codec, quality, queries, shared, simhash, substring_dedup, suffix_dedup, topk, windows

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, row long, hash string, chunk int, k string, t string, order int"


def fixture(seed=0):
    """Texts with nulls, empties, repeats, ties, a very long text and columns of clashing names."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["the", "of", "Ring", "été", "x1", "tree,", "日本", "|", "over"]) for _ in range(rng.randint(36, 90))) for _ in range(5)]
    texts = [None, "", " \n\t", "a", "a b", "a b c", "A  b\x0bC\x1fd", "aaaa " * 40, "x" * 700, pool[0] + " " + pool[1] * 40]
    texts += [rng.choice(pool) + rng.choice(["", "\n", " tail words here"]) + rng.choice(pool) for _ in range(25)] + [pool[2], pool[2], pool[2].upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "a"), (None, pool[3]), (None, None)]
    return [(i, t, 7, "h", 1, "k", "t", 5) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# 1


def test_codec_equals_library():
    sp, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.codec(PIECES), random.Random(1)
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for n in range(4000):
        pool = [list(" \n\ta b é日本😀▁xyz'.,<s>0123"), pieces, list("abcdehinorst "), [" ", "   ", "a", "\n", "the"]][n % 4]
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert codec.encode(text) == sp.encode(text), text
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258)]) for _ in range(8)]
        assert codec.decode(ids) == sp.decode(ids), ids


def test_round_trip_digests(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(i, len(ids := sp.encode(t or "")), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t in pairs(docs)]
    assert ordered(piece_codec.round_trip_digests(docs, PIECES).collect()) == ordered(want)
    assert piece_codec.round_trip_digests(none, PIECES).count() == 0
    back = piece_codec.decode_ids(piece_codec.encode_texts(docs, PIECES), PIECES)
    assert back.where("decoded <> coalesce(text, '')").count() == 0


# 2


def test_scores(docs, none):
    tokens = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    counts = Counter(w for i, t in pairs(docs) if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in pairs(docs):
        w = tokens(t)
        want.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    got = maxent_lm.score(docs).collect()
    for g, w in zip(ordered(got), ordered(want), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert maxent_lm.score(none).count() == 0


def plain_model(texts):
    """The language model from its definition, token by token: the log10 probability of a text."""
    m, tokens = maxent_lm, lambda t: WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) + ["\n"]
    counts = Counter(w for t in texts for w in tokens(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    own = {w: i for i, w in enumerate(ranked[: m.OWN_ROWS])}
    singles = [w for w in own if w != "\n"][: m.SINGLE - 1] + ["\n"]
    ends = Counter()
    for w in counts:
        if w not in singles and len(w) > 1:
            ends[w[-2:]] += counts[w]
    spellings = sorted(ends, key=lambda x: (-ends[x], x))[: m.SPELLINGS - 1]
    classes = len(singles) + len(spellings) + 1
    cls = lambda w: singles.index(w) if w in singles else len(singles) + spellings.index(w[-2:]) if w[-2:] in spellings else classes - 1
    members = {}
    for w in ranked:
        if w not in singles:
            members.setdefault(cls(w), []).append(w)
    places = {c: ws[: m.PLACES - 1] for c, ws in members.items()}
    rest = {c: ws[m.PLACES - 1:] for c, ws in members.items()}
    row = lambda w: m.WORD_ROWS - 1 if w is None else own[w] if w in own else m.OWN_ROWS + zlib.crc32(w[-3:].encode()) % (m.WORD_ROWS - m.OWN_ROWS - 1)
    mixed = lambda x, by, rows: (x * by % 2**64 >> 40) % rows

    def features(last, before):
        a, b = row(last), row(before)
        return [("last", a), ("before", b), ("pair", mixed(a * m.WORD_ROWS + b, 0x9E3779B97F4A7C15, m.PAIR_ROWS))]

    place_feature = lambda c, last: mixed(c * m.WORD_ROWS + row(last), 0xD6E8FEB86659FD93, m.PLACE_ROWS)
    place = lambda c, w: places.get(c, []).index(w) if w in places.get(c, []) else m.PLACES - 1
    total = [sum(counts[w] for w in counts if cls(w) == c) + m.PRIOR for c in range(classes)]
    bias = np.log(np.array(total) / sum(total))
    own_place = {}
    for c in range(len(singles), classes):
        n = np.zeros(m.PLACES)
        for i, w in enumerate(places.get(c, [])):
            n[i] = counts[w] + m.PRIOR
        n[-1] = sum(counts[w] for w in rest.get(c, [])) + m.PRIOR
        own_place[c] = np.log(np.maximum(n, 1e-300) / n.sum())
    weight, place_weight = {}, {}
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    class_shares = lambda fs: softmax(bias + sum(weight.get(f, 0) for f in fs))
    place_shares = lambda c, last: softmax(own_place[c] + place_weight.get(place_feature(c, last), 0))

    def walk(t):
        before = last = None
        for w in tokens(t):
            yield w, cls(w), last, before
            before, last = last, w

    seen, place_seen = {}, {}
    for t in texts:
        for w, c, last, before in walk(t):
            for f in features(last, before):
                seen.setdefault(f, np.zeros(classes))[c] += 1
            if c >= len(singles):
                place_seen.setdefault(place_feature(c, last), np.zeros(m.PLACES))[place(c, w)] += 1
    share = np.exp(bias)
    for f, n in seen.items():
        prior = m.PAIR_PRIOR if f[0] == "pair" else m.PRIOR
        weight[f] = m.FIRST_STEP * np.log((n + prior * share) / (n.sum() * share + prior * share))
    for _ in range(m.ROUNDS):
        told, place_told = {f: np.zeros(classes) for f in seen}, {f: np.zeros(m.PLACES) for f in place_seen}
        for t in texts:
            for _w, c, last, before in walk(t):
                p = class_shares(features(last, before))
                for f in features(last, before):
                    told[f] += p
                if c >= len(singles):
                    place_told[place_feature(c, last)] += place_shares(c, last)
        for w, s, e in ((weight, seen, told), (place_weight, place_seen, place_told)):
            for f in s:
                size = {"last": m.STEP, "before": m.STEP, "pair": m.PAIR_STEP}[f[0]] if isinstance(f, tuple) else m.PLACE_STEP
                w[f] = w.get(f, 0) + size * (s[f] - e[f]) / (0.5 * (s[f] + e[f]) + (m.PAIR_PRIOR if isinstance(f, tuple) and f[0] == "pair" else m.PRIOR))

    def in_rest(c, w):
        size, words, once = sum(counts[x] for x in rest.get(c, [])), len(rest.get(c, [])), sum(counts[x] == 1 for x in rest.get(c, []))
        unseen = (once + 0.5) / (size + 1) if size else 1.0
        return (1 - unseen) * (counts[w] - m.DISCOUNT) / (size - m.DISCOUNT * words) if w in counts else unseen

    def probability(w, last, before):
        c = cls(w)
        p = class_shares(features(last, before))[c]
        if c < len(singles):
            return p
        k = place(c, w)
        return p * place_shares(c, last)[k] * (in_rest(c, w) if k == m.PLACES - 1 else 1)

    unseen_of = lambda c: "".join(["\r", spellings[c - len(singles)] if c - len(singles) < len(spellings) else "\r\r"])  # noqa: E731  # no word of a text
    everything = lambda last, before: sum(probability(w, last, before) for w in [*counts, *(unseen_of(c) for c in range(len(singles), classes))])
    return lambda t: sum(math.log10(probability(w, last, before)) for w, _, last, before in walk(t)), everything


def test_scores_equal_the_definition(spark):
    """Every score against the plain version, whose probabilities of all words and of an unseen one in each class sum to 1."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) + rng.choice(["", "xy", "uv"]) for _ in range(400)]
    rows = [(n, " ".join(words[int(400 * rng.random() ** 2)] for _ in range(rng.randint(0, 60)))) for n in range(60)] + [(None, None), (61, "unseen Words"), (62, "abxyz " * 20), (62, "")]
    score, everything = plain_model([t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1])
    assert everything(words[0], words[1]) == pytest.approx(1) and everything(None, None) == pytest.approx(1)
    got = maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((repr(i), score(t)) for i, t in rows)
    have = sorted((repr(r["doc_id"]), r["score"]) for r in got)
    assert have == [(i, pytest.approx(x, abs=1e-3)) for i, x in want]


def test_held_out_texts_score_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = maxent_lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


# 3


def plain_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, none):
    rows = pairs(docs)
    prints = [plain_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    want = [(rows[k][0], f"{prints[k]:016x}", least[group[k]]) for k in range(len(rows))]
    assert ordered(simhash.near_duplicate_groups(docs).collect()) == ordered(want)
    assert simhash.near_duplicate_groups(none).count() == 0


def test_near_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, number = [], 0
    for g in range(40):
        base = [word() for _ in range(300)]
        rows.append((number, " ".join(base)))
        for c in range(3):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(300)] = word()
            rows.append((number + c + 1, " ".join(copy)))
        number += 10
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows + [(1, rows[1][1]), (None, None), (None, "")], "doc_id long, text string"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == list(range(0, 400, 10)) and ids.count(None) == 1


def test_recall_by_similarity(spark):
    """Pairs of texts of known similarity: those of 0.8 and more are found as often as stated, those below never."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, similar = [], {}
    for n in range(700):
        base = [word() for _ in range(200)]
        copy = list(base)
        for _ in range(rng.randint(1, 7)):
            copy[rng.randrange(200)] = word()
        a, b = ({tuple(w[i:i + 5]) for i in range(196)} for w in (base, copy))
        similar[2 * n] = len(a & b) / len(a | b)
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(copy))]
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    found = {n: n + 1 not in kept for n in similar}
    assert all(n in kept for n in similar) and not any(found[n] for n in similar if similar[n] < 0.8)
    for low, high, least in ((0.8, 0.83, 0.9), (0.83, 0.9, 0.95), (0.9, 1.01, 0.99)):
        band = [found[n] for n in similar if low <= similar[n] < high]
        assert len(band) > 50 and sum(band) >= least * len(band), (low, sum(band), len(band))
    assert simhash.meeting_chance(0.8) > 0.95


def pairs_of_similarity(count, low, high, size=120, seed=23):
    """Texts 2 n and 2 n + 1 whose sets of five-word shingles have a Jaccard similarity from low up to high."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    while len(rows) < 2 * count:
        base = [word() for _ in range(size)]
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(size)] = word()
        a, b = ({tuple(w[i:i + 5]) for i in range(size - 4)} for w in (base, copy))
        if low <= len(a & b) / len(a | b) < high:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    return rows


def test_no_pair_is_left_out(spark, monkeypatch):
    """of pairs at the limit that fingerprints miss, none is left out, in any number of chunks; those below it are not linked."""
    monkeypatch.setattr(overlap, "CHUNK", 1 << 11)
    similar, others = pairs_of_similarity(400, 0.8, 0.82), pairs_of_similarity(100, 0.72, 0.7999, seed=24)
    rows = similar + [(800 + n, t) for n, t in others]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 800, 2)) + list(range(800, 1000))


@pytest.mark.parametrize("alone", [True, False])
def test_texts_that_can_be_similar(spark, monkeypatch, alone):
    """Texts with enough shingles in common with other groups stay; any two that share so many share one of those given, and rare ones come first."""
    monkeypatch.setattr(overlap, "CHUNK", 500)
    rng = np.random.default_rng(3)
    pool, rare = rng.integers(1 << 62, size=40), rng.integers(1 << 62, size=4000)
    sets = [np.unique(np.concatenate((pool[rng.random(40) < 0.5], rare[rng.integers(4000, size=20)]))) for _ in range(200)]
    sets = sets[:150] + [x[rng.random(len(x)) < 0.95] for x in sets[:50]] + [np.zeros(0, np.int64)]
    roots = list(range(len(sets))) if alone else [n % 60 for n in range(len(sets))]
    rows = [(n, roots[n], len(x), overlap._narrow(x) if alone else x.tolist()) for n, x in enumerate(sets)]
    docs = spark.createDataFrame(rows, f"node long, root long, size long, tokens {'binary' if alone else 'array<long>'}")
    need = lambda n: overlap.least(n, 0.8)
    got = {r["node"]: r["tokens"] for r in overlap.meeting(docs, need, alone).collect()}
    groups = {}
    for x, root in zip(sets, roots, strict=True):
        for t in x.tolist():
            groups.setdefault(t, set()).add(root)
    mixed = [{t for t in x.tolist() if len(groups[t]) > 1} for x in sets]
    want = [n for n, x in enumerate(sets) if mixed[n] and len(mixed[n]) >= need(len(x))]
    assert sorted(got) == want and 50 < len(want) < len(sets)
    if not alone:
        assert all(set(got[n]) <= mixed[n] and len(got[n]) == len(mixed[n]) - need(len(sets[n])) + 1 for n in want)
        assert all(set(got[a]) & set(got[b]) for a in want for b in want if len(mixed[a] & mixed[b]) >= max(need(len(sets[a])), need(len(sets[b]))))


def test_near_copies_with_clashing_names(spark):
    names = ["key", "digest", "_key", "_digest", "t", "c0", "node", "root"]
    rows = [(i, "one text of some words here", *[f"{i}{c}" for c in names]) for i in (2, 1)] + [(3, None, *names), (3, None, *names), (4, "", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and ordered(kept.collect()) == ordered([rows[1], rows[2]])
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_components_with_a_hot_node(spark):
    rng = random.Random(17)
    edges = [(0, n) for n in range(1, 3000)] + [(5000 + n, 5001 + n) for n in range(60)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(300)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_near_copies_with_a_repeated_line(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for n in range(0, 40, 2):
        text, line = " ".join(word() for _ in range(300)), " ".join(word() for _ in range(10))
        rows += [(n, text), (n + 1, text + f"\n{line}" * 20)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 2))


def test_near_copies_without_ids(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)) for _ in range(12)]
    near = lambda t: t + " tail"
    # a null id linked to a document, two linked null ids, unrelated null ids, and unrelated texts of one id
    rows = [(0, texts[0]), (None, near(texts[0])), (None, texts[1]), (None, near(texts[1]))] + [(None, t) for t in texts[2:7]] + [(5, t) for t in texts[7:]]
    kept = [(r["doc_id"], r["text"].removesuffix(" tail")) for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(kept) == Counter([(0, texts[0])] + [(None, t) for t in texts[1:7]] + [(5, t) for t in texts[7:]])


def family(members, shared, size, twins, seed=8):
    """Texts that share the first words of one passage, and a copy of each of the first twins with two words changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, rows = [word() for _ in range(shared)], []
    for n in range(members):
        words = passage + [word() for _ in range(size - shared)]
        rows.append((2 * n, " ".join(words)))
        if n < twins:
            for at in (shared + 20, size - 20):
                words[at] = word()
            rows.append((2 * n + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("shared", [200, 245])  # Jaccard similarities of about 0.5 and 0.7
def test_near_copies_in_a_family(spark, shared):
    rows = family(250, shared, 300, 60)
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 500, 2))


@pytest.mark.parametrize("shared", [200, 245])
def test_near_copies_in_a_family_of_blocks(spark, monkeypatch, shared):
    """A family of many blocks has the groups that one of a single block has."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 50, raising=False)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 10_000)
    rows = family(250, shared, 300, 60)
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 500, 2))


def most_rows(spark, run):
    """The most rows that one step of a plan gives out while run() works."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {(x := store.executionsList().apply(i)).executionId(): x for i in range(store.executionsList().size())}
    before, most = set(ids()), 0
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for number, execution in ids().items():
        if number not in before:
            metrics, values = execution.metrics(), store.executionMetrics(number).iterator()
            rows = {m.accumulatorId() for m in map(metrics.apply, range(metrics.size())) if m.name() == "number of output rows"}
            while values.hasNext():
                value = values.next()
                if value._1() in rows and (count := value._2().replace(",", "")).isdigit():
                    most = max(most, int(count))
    return most


def test_near_copies_of_a_family_are_no_rows(spark):
    """Texts that are alike but not linked: no step gives out rows for variants or for pairs of places where texts meet."""
    rows = family(400, 245, 300, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    most = most_rows(spark, lambda: simhash.keep_one_of_each(docs).collect())
    assert len(rows) <= most <= 2 * simhash.MINIMA * len(rows)


@pytest.mark.parametrize("blocks", [1, 2])
def test_texts_with_a_close_one_are_found_as_by_pairs(blocks):
    rng = np.random.default_rng(11)
    base = [np.unique(rng.integers(1 << 62, size=200)) for _ in range(50)]
    sets = base + [np.unique(np.concatenate((x[rng.random(len(x)) < 0.95], rng.integers(1 << 62, size=5)))) for x in base[:25]]
    longs = simhash._long_fingerprints([x.view(np.uint64) for x in sets], simhash.LONG_WORDS)
    roots, parts, far = np.arange(len(sets)) // 2, rng.integers(blocks, size=len(sets)), 62
    bits = lambda x: int(x).bit_count()
    meets = lambda x: any(bits(x >> 16 * t & 0xFFFF) <= 2 for t in range(4))
    want = [any(roots[i] != roots[j] and (blocks == 1 or parts[i] != parts[j]) and sum(map(bits, longs[i] ^ longs[j])) <= far and meets(int(longs[i][0] ^ longs[j][0]))
                for j in range(len(sets))) for i in range(len(sets))]
    assert simhash._near(roots, parts, longs, far).tolist() == want and 10 < sum(want) < len(sets)


def test_rows_of_a_key_lie_in_many_batches():
    keys = np.repeat([3, 5, 5, 8, 9], [1, 4, 3, 1, 7])
    table = pa.table({"m": keys, "at": np.arange(len(keys)), "long": [[i, -i] for i in range(len(keys))]})
    for size in (1, 3, 100):
        got = [(set(x["m"].to_pylist()), x["at"].to_pylist(), simhash._matrix(x, 2)[:, 0].tolist()) for x in simhash._keyed(iter([table.to_batches()[0].slice(0, 0), *table.to_batches(size)]), ["m"])]
        assert got == [({k}, at := np.flatnonzero(keys == k).tolist(), at) for k in (3, 5, 8, 9)]


@pytest.mark.parametrize("blocks", [1, 2])
def test_blocks_are_joined_as_by_pairs(blocks):
    """Links of blocks have the components of all similar pairs that meet, and are fewer than the groups."""
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(1 << 62, size=200))
    sets = [np.zeros(0, np.int64)] * 2 + [np.unique(np.concatenate((base[rng.random(len(base)) < keep], rng.integers(1 << 62, size=9)))) for keep in np.repeat([0.85, 0.9, 0.97], 20)]
    longs = simhash._long_fingerprints([x.view(np.uint64) for x in sets], simhash.LONG_WORDS)
    roots, parts, far = np.arange(len(sets)) // 2 * 2 + 7, rng.integers(blocks, size=len(sets)), 62
    a, b = simhash._joined(roots, parts, longs, np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), 0.8, far)
    bits = lambda x: int(x).bit_count()
    meets = lambda x: any(bits(x >> 16 * t & 0xFFFF) <= 2 for t in range(4))
    pairs = [(roots[i], roots[j]) for i in range(len(sets)) for j in range(i) if (blocks == 1 or parts[i] != parts[j]) and sum(map(bits, longs[i] ^ longs[j])) <= far
             and meets(int(longs[i][0] ^ longs[j][0])) and (met := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - met)]

    def components(links):
        of = {x: x for x in set(roots.tolist())}
        for x, y in links:
            x, y = of[int(x)], of[int(y)]
            of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
        return of

    assert components(zip(a, b, strict=True)) == components(pairs) and len(pairs) > 50
    assert len(a) < len(set(roots.tolist()))


# 4


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p>One &amp; two<p>Three\n  four</p>", "One & two\nThree four"),
        ('<body><nav><a href=x>Menu</a></nav><div class="ad">Buy this, now, please.</div><article><h1>T</h1><p>Text, with commas.<br>More</p></article><footer>f</footer>', "T\nText, with commas. More"),
        ("<script>var a='</p>'</script><style>p{}</style><main>Only text<!-- no --></main>", "Only text"),
        ('<div><p>A long paragraph, with words, and more words.</p></div><div id="comments"><p>I think, therefore, I comment.</p></div><form>f</form>', "A long paragraph, with words, and more words."),
        ('<div class="comment">all there is</div>', "all there is"), ("<p>unclosed <b>bold", "unclosed bold"), ("plain", "plain"), ("<<<>>>&&&", "<<<>>>&&&"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


ARTICLE = "<article><h1>T</h1><p>Text, with commas, and so on.</p></article>"
PROSE = "Long sentences, with commas, that read like any other part of the article. " * 4


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<svg width="1"/>{ARTICLE}', "T\nText, with commas, and so on."),
        (f'<div><svg><g><text>no</text><svg>no</svg></g>no</svg></div>{ARTICLE}', "T\nText, with commas, and so on."),
        (f"<form action=x>{ARTICLE}<label>Name</label><button>Send</button></form>", "T\nText, with commas, and so on."),
        ("<form><div><p>All of the page, with commas, stands in a form.</p></div></form>", "All of the page, with commas, stands in a form."),
        (f"<head><title>x</title><body>{ARTICLE}", "T\nText, with commas, and so on."),
        (f'<article><p>Start.</p><section class="related-work"><p>{PROSE}</p></section><div class="share-price">Up, again</div></article>', f"Start.\n{PROSE.strip()}\nUp, again"),
        (f'<article><p>{PROSE}</p><div class="related-posts"><a href=x>Other</a></div><div class="shareButtons">Share</div><div id="comments"><p>{PROSE}</p></div></article>', PROSE.strip()),
        (f'<article><p>{PROSE}</p><div class="related"><p>{PROSE}</p></div></article>', f"{PROSE.strip()}\n{PROSE.strip()}"),
        (f'<article><p title="a>b">One</p><script src="x>y">var a = "<p>";</script><noscript>no</noscript></article>', "One"),
        (f"<aside>{PROSE}</aside><nav><ul><li>a</ul></nav><footer>f</footer>", ""),
        (f"<div><article><p>{PROSE}</p></article><article><p>{PROSE}</p></article></div>", f"{PROSE.strip()}\n{PROSE.strip()}"),
        (f"<section><article><p>{PROSE}</p></article></section><section><article><h2>Two</h2><div><p>{PROSE}</p></div></article></section><article><a href=x>More</a></article>", f"{PROSE.strip()}\nTwo\n{PROSE.strip()}"),
        (f"<article><p>{PROSE}</p><p>See:</p><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>End.</p></article>", f"{PROSE.strip()}\nSee:\nOne\nTwo\nEnd."),
        (f"<div><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><h1>Title</h1><div><p>By me</p><div><p>{PROSE}</p><p>{PROSE}</p></div></div><h3>Elsewhere</h3><ul><li><a href=x>Other</a></ul></div>", f"Title\n{PROSE.strip()}\n{PROSE.strip()}"),
        (f"<body><h1>Title</h1><div><main><p>{PROSE}</p></main></div><div>Bottom</div></body>", f"Title\n{PROSE.strip()}"),
        (f"<div><div><p>{PROSE}</p></div><div><p>{PROSE}</p></div></div>", f"{PROSE.strip()}\n{PROSE.strip()}"),
    ],
)
def test_main_text_inside_other_elements(html, text):
    assert html_text.main_text(html) == text


class PlainPage(HTMLParser):
    """The article of a page by the standard library's parser: its blocks' texts, without navigation, adverts and so on."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.text = [], [], ""

    def end_block(self):
        if self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attributes):
        if tag == "br":
            self.text += " "
        elif tag in ("b", "i", "a", "meta"):
            return
        else:
            self.end_block()
            if tag in ("p", "li") and self.open[-1] == tag:
                self.open.pop()
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            self.end_block()
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "article" in self.open and not {"script", "style", "nav"} & set(self.open):
            self.text += data


def test_all_pages_against_plain(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        plain = PlainPage()
        plain.feed(r["html"])
        plain.end_block()
        text = "\n".join(plain.blocks)
        assert got[r["page_id"]] == (text, len(text))


def test_extract(spark):
    schema = "page_id long, url string, html string, text string, raw_page string, n_chars string"
    rows = [(1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (None, None, None), (2, "v", "<p>" + "word, " * 50000 + "</p>"), (3, None, "")]
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["n_chars"], r["url"] or "") for r in got.collect()) == [(0, ""), (0, ""), (1, "u"), (1, "u"), (299999, "v")]
    assert html_text.extract(pages.limit(0)).count() == 0


# 5


def test_ids_equal_library():
    library, words, rng = Tokenizer.from_file(BYTES), packing.tokenizer(BYTES), random.Random(9)
    assert library.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    pool = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "hello", " world", "été", "日本", "'s", "12", "<", "|", "endoftext"]
    for _ in range(2000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(words.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def plain_pieces(rows, capacity):
    """How often each piece (doc_id, piece, start, length, crc) is to be there, from the library's ids."""
    library, want = Tokenizer.from_file(BYTES), Counter()
    for i, t in rows:
        data = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(data) % capacity or capacity, len(data), capacity), len(data)]
        want.update((i, p, a, b - a, zlib.crc32(data[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return want


def test_packing(docs, none, spark):
    docs = docs.unionByName(spark.createDataFrame([(70, "one <|endoftext|> two<|endoftext|><|endoftext|>three"), (71, "<|endoftext|>")], "doc_id long, text string"), allowMissingColumns=True)
    got = packing.pack_documents(docs, BYTES, capacity=64).collect()
    assert Counter(tuple(r)[:5] for r in got) == plain_pieces(pairs(docs), 64)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, BYTES).count() == 0


def test_best_fit_is_near_the_bound():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 1024) for _ in range(5000)), reverse=True)
    bins, _ = packing.best_fit(lengths, 1024)
    assert max(bins) + 1 <= 1.01 * sum(lengths) / 1024
    bins, _ = packing.best_fit(lengths, 1024, open_bins=1)
    assert max(Counter(bins)) + 1 <= len(lengths)


def test_pre_tokens_equal():
    words, rng = packing.tokenizer(BYTES), random.Random(4)
    letters = [chr(i) for i in [*range(0x260), *range(0x2000, 0x2040)]]
    for _ in range(3000):
        text = "".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice(" '\nabs_1.") for _ in range(9))
        assert words.split(text) == words.split_any(text), text


# 6 and 8


def plain_words(rows, size):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    counts = Counter(tuple(w[p:p + size]) for _, w in split for p in range(len(w) - size + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if counts[tuple(w[p:p + size])] > 1:
                gone[p:p + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def plain_bytes(rows, size):
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        data = (t or "").encode()
        for p in range(len(data) - size + 1):
            first.setdefault(data[p:p + size], key(i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - size + 1):
            if first[data[p:p + size]] < key(i):
                gone[p:p + size] = [True] * size
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone) if not g))))
    return out


@pytest.fixture(params=[1 << 14, 2], ids=["by anchor", "split"])
def small_parts(request, monkeypatch):
    """Many chunks and parts; with few contexts an anchor, so that most anchors are split."""
    monkeypatch.setattr(windows, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(windows, "PART_BYTES", 3000)
    monkeypatch.setattr(windows, "HOT_CONTEXTS", request.param)


@pytest.mark.parametrize(("size", "seed"), [(35, 0), (10, 1), (3, 2)])
def test_substring_dedup(spark, small_parts, size, seed):
    docs = spark.createDataFrame(fixture(seed), SCHEMA)
    assert ordered(substring_dedup.remove_repeats(docs, size, digests=True).collect()) == ordered(plain_words(pairs(docs), size))


@pytest.mark.parametrize(("size", "seed"), [(50, 0), (20, 1), (60, 2)])
def test_suffix_dedup(spark, small_parts, size, seed):
    docs = spark.createDataFrame(fixture(seed), SCHEMA)
    assert ordered(suffix_dedup.remove_repeats(docs, size, digests=True).collect()) == ordered(plain_bytes(pairs(docs), size))


def test_asks_grow_with_the_texts():
    """Chunks times parts, the rows between them, in proportion to the bytes from ROOT_BYTES up to two TB."""
    rows = lambda size: math.prod(windows.dealt_to(size))
    assert windows.dealt_to(0) == (1, 1) and windows.dealt_to(5 << 29) == (1280, 640)
    for size in (1 << 34, 1 << 36, 1 << 40):
        assert rows(2 * size) < 2.1 * rows(size)


def test_dedup_of_a_common_phrase(spark, small_parts):
    """One phrase in every text, each time between other words, and some texts that share a stretch around it."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    phrase, shared = "it goes without saying that we all like rain", [word() for _ in range(30)]
    rows = []
    for n in range(60):
        before, after = [word() for _ in range(40)], [word() for _ in range(40)]
        if n % 3 == 0:
            before[-15:], after[:9] = shared[:15], shared[15:24]
        rows.append((n, " ".join([*before, phrase, *after])))
    docs = spark.createDataFrame(rows + rows[:3] * 5, "doc_id long, text string")
    assert ordered(substring_dedup.remove_repeats(docs, 20, digests=True).collect()) == ordered(plain_words(pairs(docs), 20))
    assert ordered(suffix_dedup.remove_repeats(docs, 50, digests=True).collect()) == ordered(plain_bytes(pairs(docs), 50))


def test_equal_hashes_of_different_contexts(spark, small_parts, monkeypatch):
    """Contexts are told apart by their text, even where all hashes of contexts are equal."""
    rows = fixture(3)
    spec = [windows.Spec(10, 4, words=True, earlier=False), windows.Spec(20, 8, words=False, earlier=True)]
    for s in spec:
        texts = s.texts(pa.chunked_array([pa.array([r[1] for r in rows], pa.string())]))
        a = s.anchors(texts)
        bodies = windows._bodies(s).of(s, texts, a)
        zero = np.zeros(len(a["hash"]), np.uint64)
        values = a["row"] if s.earlier else np.ones(len(zero), np.int64)
        e = windows.Entries(s, a["hash"], zero, values, a["left"], a["right"], bodies)
        assert not bodies.differ(np.arange(len(zero)), e.first[e.of]).any()


def test_longest_previous_factor():
    rng = random.Random(13)
    for _ in range(50):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        n = len(text)
        keys = np.frombuffer(b"".join(text[i:].ljust(64, b"\0") for i in range(n)), ">u8").reshape(n, 8).astype(np.uint64)
        place = np.arange(n)
        order = suffix_dedup.suffix_order(keys, place)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
        lcp = np.minimum(suffix_dedup.common_prefixes(keys, order), n - np.maximum(order, np.roll(order, 1)))
        match = lambda i, j: next((k for k in range(n - max(i, j)) if text[i + k] != text[j + k]), n - max(i, j))
        lpf = dict(zip(order.tolist(), suffix_dedup.longest_previous_factor(order, lcp).tolist()))
        assert lpf == {i: max((match(i, j) for j in range(i)), default=0) for i in range(n)}


def test_dedup_of_nothing(none):
    assert substring_dedup.remove_repeats(none).count() == suffix_dedup.remove_repeats(none).count() == 0


def test_kept_texts(docs):
    kept = suffix_dedup.remove_repeats(docs, carry=("hash", "row"))
    assert kept.columns == ["doc_id", "kept_text", "n_removed", "n_bytes", "hash", "row"] and kept.count() == docs.count()


def test_cleaned_with_clashing_names(spark):
    names = ["n_removed", "kept_text", "k", "chunk", "rid", "order", "v0", "c0"]
    text = "a sentence of more than fifty bytes that two texts have, "
    rows = [(2, text + "later", 9, *names), (1, text + "first", 9, *names), (None, None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"{c} string" for c in names))
    assert suffix_dedup.remove_repeats(docs, carry=("n_removed", "kept_text")).columns == ["doc_id", "n_bytes", "n_removed", "kept_text"]
    got = suffix_dedup.cleaned(docs)
    assert got.schema == docs.schema
    assert ordered(got.collect()) == ordered([(2, "later", 5, *names), (1, text + "first", len(text) + 5, *names), (None, "", 0, *names)])


# 7


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)] + [(400, None), (500, [float("nan")] * 8), (600, [None] + [0.1] * 7), (None, [0.1] * 8), (7, [9.0] * 8), (801, [0.5] * 3), (900, [])]
    rows += [(1000 + i, [0.25] * 8) for i in range(5)]
    rows += [(200, [0.1] * 8), (200, [0.1] * 8), (200, [0.3] * 8), (800, [2.0] * 8), (800, [2.0] * 8)] + [(77, [3.0] * 8)] * 13
    ints = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(ints):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(ints) if m != n and len(w) == len(v))[:10]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    found = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ordered(topk.search(found).collect()) == ordered(want)
    assert topk.search(found.limit(0)).count() == 0


def test_huge_components():
    assert topk.product([2**40, -(2**40)], [2**40, 2**40]) == 0
    assert topk.product([2**62], [2**62]) == (1 << 63) - 1 and topk.product([], []) == 0


def test_top_k_of_copies_against_sql(spark, tmp_path):
    """Repeated ids, large groups of equal vectors and near ties, against the registered SQL."""
    rng = random.Random(19)
    rows = [(i, [0.5, 0.25, -0.125, 1.0]) for i in range(0, 3000, 3)] + [(i, [rng.gauss(0, 0.5) for _ in range(4)]) for i in range(1, 3000, 3)]
    rows += [(100, [0.1] * 4), (100, [0.1] * 4), (100, [0.05] * 4), (7, [3.0] * 4), (7, [2.0] * 4), (None, [9.0] * 4), (5, [0.5, 0.2499999, -0.125, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op7_exact_top_k"]).fetchall()
    got = queries.op7_exact_top_k(spark, str(tmp_path)).collect()
    assert ordered(got) == ordered(want) and len(got) == 230  # 23 queries: the rows of multiples of 100


# 9


def plain_features(text):
    text = text or ""
    words = WORD.findall(text)
    threes = Counter(zip(words, words[1:], words[2:]))
    covered = {p + k for p in range(len(words) - 2) if threes[tuple(words[p:p + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("values", [None, 5])  # None: the hash itself; 5: nearly all windows meet by chance
def test_base_features(docs, spark, monkeypatch, values):
    if values:
        monkeypatch.setattr(quality, "window_hash", lambda *w: F.pmod(F.xxhash64(*w), F.lit(values)))
    got = {(r["doc_id"], r["text"]): tuple(r)[-5:] for r in quality.base_features(docs.select("doc_id", "text"), "text").drop("words").collect()}
    for i, t in pairs(docs):
        assert got[i, t] == plain_features(t), t


def test_quality_against_plain(spark, docs):
    """Every score and verdict from its definition, over trusted and other rows, nulls and repeats."""
    rng = random.Random(11)
    good, bad = ([f"{c}{n}" for n in range(60)] for c in "gb")
    rows = [(n, " ".join(rng.choice(good if n % 3 else bad) for _ in range(rng.choice([20, 60, 90])))) for n in range(60)] + pairs(docs)
    marks = [(n, 1 if n % 3 else 0, 0) for n in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 0), (8, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {}  # buckets of grams, by Spark's own hash
    grams = {(g,) if isinstance(g, str) else g for _, t in rows for w in [WORD.findall(t or "")] for g in [*w, *zip(w, w[1:])]}
    for size in (1, 2):
        some = [g for g in grams if len(g) == size]
        frame = spark.createDataFrame(some, ", ".join(f"g{k} string" for k in range(size)))
        hashed |= {tuple(r)[:size]: r["b"] for r in frame.withColumn("b", F.pmod(F.xxhash64(*frame.columns), F.lit(quality.BUCKETS))).collect()}
    of = lambda t: [hashed[g] for w in [WORD.findall(t or "")] for g in [*((x,) for x in w), *zip(w, w[1:])]]
    trusted = {n for n, q, t in marks if n is not None and min(x[1] for x in marks if x[0] == n) == 1 and not any(x[2] for x in marks if x[0] == n)}
    raw, target = Counter(b for _, t in rows for b in of(t)), Counter(b for i, t in rows if i in trusted for b in of(t))
    share = lambda counts, b: (counts[b] + 1) / (sum(counts.values()) + quality.BUCKETS)
    score = lambda t: sum(math.log(share(target, b) / share(raw, b)) for b in of(t)) / len(of(t)) if of(t) else 0.0
    own = [score(t) for i, t in rows if i in trusted and len(WORD.findall(t or "")) >= quality.MIN_WORDS]
    least = float(np.quantile(own, quality.TRUSTED_LOSS)) - quality.MARGIN
    got = quality.judge(table, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        n, *_, repeats = plain_features(r["text"])
        failed = n < 50 or 100 * repeats > 50 * n
        assert r["score"] == pytest.approx(score(r["text"]), abs=1e-6) and r["base_failed"] == failed
        assert r["kept"] == (not failed and r["score"] >= least)


def test_quality_with_clashing_names(spark):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    names = ["words", "grams", "packed", "Score", "kept", "n_words", "verdict", "met", "starts", "low_bits", "c0", "trusted_id", "quality"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60 * i)), *[f"{i}{c}" for c in names]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and ordered(kept.collect()) == ordered(rows[1:])
    judged = quality.judge(docs, labels)
    assert {r["words"] for r in judged.collect()} == {"0words", "1words", "2words"} and len({c.lower() for c in judged.columns}) == len(judged.columns)


def test_quality_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.2
    assert quality.accepted(docs, labels).count() == quality.judge(docs, labels).where("kept").count()
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_trust_without_a_shuffle_of_texts(spark, monkeypatch):
    """Where Spark would not broadcast the trusted ids by itself, counting shuffles no text; ids far apart or not numbers give the same."""
    rows = [(n, f"w{(n or 1) % 7} w{(n or 1) % 5} w{n}") for n in [*range(-70, 300), *(k << 40 for k in range(-5, 5)), (1 << 63) - 1, -(1 << 63), None, 3]]
    marks = [(n, n % 3 % 2, 0) for n, _ in rows[::2] if n is not None] + [(None, 1, 0)]
    table, labels = spark.createDataFrame(rows, "k long, text string"), spark.createDataFrame(marks, "k long, quality int, toxic int")
    trusted = {n for n, q, _ in marks if n is not None and min(x[1] for x in marks if x[0] == n) == 1}
    executions = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = executions().size()
        found = quality.fit(table, labels, "k", "text")
        plans = [executions().apply(n).physicalPlanDescription() for n in range(before, executions().size())]
        assert any("Generate" in x for x in plans) and not any("SortMergeJoin" in x for x in plans)
        for most, kind in [(1 << 20, "long"), (0, "long"), (1 << 20, "string")]:
            monkeypatch.setattr(quality, "MOST_BIT_ROWS", most)
            docs, ids = table.withColumn("k", F.col("k").cast(kind)), labels.withColumn("k", F.col("k").cast(kind))
            got = quality.with_trust(docs, quality.trusted_ids(ids, "k"), "k", "text").collect()
            assert Counter(map(tuple, got)) == Counter((t, n in trusted) for n, t in rows)
            assert quality.fit(docs, ids, "k", "text")[0] == pytest.approx(found[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_without_trusted_rows(docs, spark):
    rows = quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)


# 10


def plain_rules(ids):
    """The licences that a sequence of identifiers stands for: each rule in turn takes all that it matches."""
    left, names = list(ids), []
    for name, pattern in licenses.RULES:
        want, at = pattern.split(), 0
        while at <= len(left) - len(want):
            if left[at:at + len(want)] == want:
                left[at:at + len(want)] = [""]
                names.append(name)
            at += 1
    names = list(dict.fromkeys(names))
    return ",".join(n for n in names if n != "All-rights-reserved" or set(names) == {n})


def test_licenses_of_shuffled_sentences(spark, docs, none):
    """Known sentences in any order, parted in any way and wrapped anywhere, among others."""
    rng = random.Random(8)
    of = {s: i for i, group in licenses.SENTENCES.items() for s in group}
    rows, want = [], []
    for n in range(200):
        text, ids, unknown = "", [], 0
        for _ in range(rng.randint(1, 8)):
            s = rng.choice([*of, "hello world", "the licence of bar"])
            ids += [of[s]] if s in of else []
            unknown += s == "the licence of bar"
            words = s.split()
            if len(words) > 12:
                words[rng.randint(3, 10)] += "\n   "
            text += " ".join(words).capitalize() + rng.choice([". ", ".\n", ".\n\n"])
        rows.append((n, text))
        want.append((plain_rules(ids) or ("UNKNOWN" if unknown else "NONE"), ",".join(ids), len(ids), unknown))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    for g, w, (_, text) in zip(got, want, rows, strict=True):
        assert tuple(g)[1:] == w, text
    assert licenses.scan(docs).count() == docs.count() and {r["license"] for r in licenses.scan(docs).collect()} == {"NONE"}
    assert licenses.scan(none).count() == 0
    assert all(re.search(licenses.LICENCE_WORDS, s) or i == "ApacheCopy" for i, group in licenses.SENTENCES.items() for s in group)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """
3. Neither the name of Example, Inc. nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_whole_licence_texts(spark):
    cases = {
        "MIT": [MIT, "MIT License\n\nCopyright (c) 2020 X\n\n" + MIT, "This code is licensed under the MIT License.", "Licensed under the MIT License (see LICENSE).", "// SPDX-License-Identifier: MIT\nint x;", "MIT License\nCopyright (c) 2020 X"],
        "BSD-2-Clause": [BSD2, "This library is released under the BSD 2-Clause License."], "BSD-3-Clause": [BSD3], "GPL-3.0-or-later": [GPL], "Apache-2.0": [APACHE, "some prose\nLicensed under the Apache License, Version 2.0.\nmore prose"],
        "NONE": ["no such words", None, ""], "UNKNOWN": ["Under the licence of Foo."], "MIT,GPL-3.0-or-later": [GPL.replace("\n", "\n") + "\n\n" + MIT],
    }
    cases |= {
        "BSD-2-Clause ": ["Copyright (c) 2001 The Example Project. All rights reserved.\n\n" + BSD2],
        "LicenseRef-BSD": ["Copyright 2001 X. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
        "All-rights-reserved": ["Copyright (c) 2001 X. All rights reserved.", "All Rights Reserved"],
        "MIT OR Apache-2.0": ["SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: (MIT OR Apache-2.0)\nfn main"], "GPL-2.0-only WITH Classpath-exception-2.0": ["SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"],
        "(MIT OR ISC) AND BSD-3-Clause": ["SPDX-License-Identifier: (MIT OR ISC) AND BSD-3-Clause"],
        "LGPL-2.1-or-later": [LGPL], "AGPL-3.0-or-later": [GPL.replace("GNU General", "GNU Affero General")], "GPL-2.0-only": [GPL.replace("either version 3 of the License, or\n(at your option) any later version", "version 2 of the License")],
        "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at\nhttp://www.boost.org/LICENSE_1_0.txt)"],
        "EPL-2.0": ["This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/"],
        "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable\nfor any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including\ncommercial applications, and to alter it and redistribute it freely, subject to\nthe following restrictions:"],
        "MIT,CC-BY-4.0": ["The code is licensed under the MIT License and the data under CC BY 4.0."], "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
        "UNKNOWN ": ["Permission is hereby granted, free of payment, to any person obtaining a copy of this software."], "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    }
    cases = {w.strip(): cases.get(w.strip(), []) + t if w != w.strip() else t for w, t in cases.items()}
    shapes = [lambda t: t, lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */", lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")), lambda t: "\n".join(f"    {x}" for x in t.split("\n")), lambda t: "\n".join(f"// {x}" for x in t.split("\n"))]
    rows = [(n, shape(t) if t else t, want) for n, (want, t, shape) in enumerate((w, t, f) for w, ts in cases.items() for t in ts for f in shapes)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {n: want for n, _, want in rows}


# The pipeline


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    judged = corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.001")
    assert judged.columns == docs.columns
    single = corpus_pipeline.near_duplicates(spark, judged, "")
    texts = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert len({t for _, t in texts}) == len(texts)
    cleaned = corpus_pipeline.repeated_strings(spark, single, "")
    assert cleaned.columns == docs.columns
    want = {i: (n, gone) for i, n, gone, _, _ in plain_bytes(texts, 50)}
    got = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    for i, t in texts:
        assert len(got[i].encode()) <= want[i][0] - want[i][1] and (want[i][1] or got[i] == t)
    assert {r["doc_id"] for r in rows} == set(got)


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, k string, chunk int, score string, _key string"


def stage_rows():
    """Nulls, empty texts, repeated rows, ties, near copies, a very long text and columns of clashing names."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(120)) for _ in range(6)]
    rows = [(0, texts[0]), (1, texts[0]), (1, texts[0]), (2, texts[0] + " tail"), (3, texts[1]), (3, texts[2]), (None, texts[3]), (None, texts[3]), (None, None), (4, None), (5, ""), (6, "few words")]
    rows += [(7, " ".join(word() for _ in range(40000))), (8, texts[4] + "\n" + texts[5][:300]), (9, texts[5])]
    return [(i, t, None, "s", None if t is None else len(t), "w", "k", 1, None, "x") for i, t in rows]


def test_stages_on_odd_rows(spark):
    """Each stage of the pipeline against a plain version, on rows of every odd kind, and on none."""
    rows = stage_rows()
    docs, sf = spark.createDataFrame(rows, STAGE_SCHEMA).repartition(4), "/root/testdata/sf0.001"
    judged = corpus_pipeline.quality_rules(spark, docs.where("doc_id is null or doc_id not in (1, 8)"), sf)
    assert judged.schema == docs.schema
    # the verdicts are held against a plain version above; here, that they take effect and nothing else does
    for some in (docs, docs.where("doc_id is null or doc_id not in (1, 8)")):
        verdicts = quality.judge(some.drop("score", "words"), spark.read.parquet(f"{sf}/labels.parquet")).where("kept").select("doc_id", "text")
        kept = corpus_pipeline.quality_rules(spark, some, sf)
        assert ordered(kept.select("doc_id", "text").collect()) == ordered(verdicts.collect()) and kept.exceptAll(some).count() == 0
        assert all(len((r["text"] or "").split()) >= 50 for r in kept.collect()) and 0 < kept.count() < some.count()
    single = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert single.schema == docs.schema
    want = [r for r in rows if (r[0], r[1]) not in {(1, rows[0][1]), (2, rows[3][1]), (None, None), (5, "")}]
    want = list({(r[0], r[1]): r for r in want}.values())
    assert ordered(single.collect()) == ordered(want)
    cleaned = corpus_pipeline.repeated_strings(spark, docs, sf)
    assert cleaned.schema == docs.schema and cleaned.count() == len(rows)
    plain = {(i, n) for i, n, *_ in plain_bytes([(r[0], r[1]) for r in rows], 50)}
    assert {r["doc_id"] for r in cleaned.collect()} == {i for i, _ in plain}
    for r in cleaned.where("doc_id in (0, 1, 8)").collect():
        assert r["n_chars"] == len(r["text"]) and (r["text"] == "") == (r["doc_id"] == 1)
    packed = corpus_pipeline.best_fit_packing(spark, docs, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == plain_pieces([(r[0], r[1]) for r in rows], 1024)
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
