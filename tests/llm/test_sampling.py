"""Source mixes, spelling variants and importance resampling against plain versions and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillbom.llm import importance, mixing, queries, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, source string, size long, part int, `of` string, word string, n long, key string"


def rows_of(seed=0):
    """Texts with nulls, empties, repeats, ties, very long texts, null sources and columns of clashing names; one source holds half."""
    rng = random.Random(seed)
    vocabulary = ["Ring", "été", "naïveté", "x1", "tree,", "日本", "|", "colour", "colours", "color", "couleur", "aaaaaa", "aaaaab", "AAAAAA", "don't", "ß", "÷×ÿÿÿÿÿ", "a" * 300, "seven7seven"]
    texts = [None, "", " \n\t", "a", "a b", "a\n\nb\nc", "colour " * 90, "x" * 700, "line of words\n" * 40, "\n".join(["one", "two three", "four"] * 30)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))).replace("| ", "\n") for _ in range(70)] + [" ".join(rng.choice(vocabulary) for _ in range(9000))]
    sources = ["b"] * 6 + ["a", "é", None, "Z"]
    rows = [(i, t, rng.choice(sources)) for i, t in enumerate(texts)] + [(12, texts[12], "b"), (12, texts[12], "b"), (12, "other words here", "b"), (None, texts[14], None), (None, None, None), (None, texts[15], "a")]
    return [(*r, 7, 1, "o", "w", 5, "k") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def digest(key, digits):
    return int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:digits], 16)


# 11


def plain_mix(rows):
    """(doc_id, size, source_size, target, taken) from the definition."""
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    sizes = Counter()
    for (_, _, s, *_), w in zip(rows, words, strict=True):
        sizes[s] += len(w)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    targets, open_sources = {}, set(order)
    goal = 1.5 * sum(sizes.values())
    while True:
        left = goal - sum(targets.values())
        share = {s: weight[s] * left / sum(weight[x] for x in open_sources) for s in open_sources}
        over = [s for s in open_sources if share[s] > 2 * sizes[s]]
        if not over:
            targets |= share
            break
        targets |= {s: 2.0 * sizes[s] for s in over}
        open_sources -= set(over)
    out = []
    for s in order:
        own = []
        for (key, _, of, *_), w in zip(rows, words, strict=True):
            if of == s:
                rate = math.sqrt(len(set(w)) / len(w)) if w else 1.0
                own.append((-math.log((digest(key, 13) + 0.5) / 2**52) / rate, len(w), key))
        epochs = math.floor(targets[s] / sizes[s]) if sizes[s] else 0
        budget = math.floor(targets[s]) - epochs * sizes[s]
        for _, size, key in sorted(own, key=lambda x: (x[:2], x[2] is not None, x[2] or 0)):
            take = max(0, min(size, budget))
            budget -= size
            out.append((key, size, sizes[s], targets[s], epochs * size + take))
    return out


def test_mix(docs, none):
    want = plain_mix([tuple(r) for r in docs.collect()])
    got = mixing.mix(docs, keep=["doc_id"]).collect()
    same([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got], [(*w[:3], round(w[3], 6), w[4]) for w in want])
    same(mixing.mix(docs.repartition(2), keep=["doc_id"]).collect(), map(tuple, got))
    per = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[r["source_size"], r["target"]] += r["taken"]
    for (_, target), taken in per.items():
        assert target - 1 <= taken <= target
    assert mixing.mix(none, keep=["doc_id"]).count() == 0


def test_mix_keeps_columns_and_copies(spark, docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "part", "of", "word", "n", "key", "size", "source_size", "target", "taken"]
    words = Counter()
    for r in mixing.copies(mixed).collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    assert words == +want
    heavy = mixing.mix(spark.createDataFrame([(i, "w " * 10, "s", float(i >= 500) * 99 + 1) for i in range(1000)], "doc_id long, text string, source string, q double"), share=0.5, quality=mixing.F.col("q"))
    taken = Counter(r["doc_id"] >= 500 for r in heavy.where("taken > 0").collect())
    assert taken[True] > 450 and taken[False] < 50


# 12


def plain_variants(rows, least, slips):
    counts = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 6
    v = {w: n for w, n in counts.items() if n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    found = {w: sorted((x for x in v if near(w, x)), key=lambda x: (-v[x], x)) for w in v}
    form = {w: xs[0] if xs and v[xs[0]] >= 5 * v[w] else None for w, xs in found.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), v[w], len(found[w]), v[form[w]] if form[w] else None) for w in v]


@pytest.mark.parametrize("block", [3, 1 << 14])
@pytest.mark.parametrize("slips", [1, 3, 199])
def test_variants(spark, docs, none, block, slips):
    """With any slip rate, and with groups of any size cut into blocks."""
    rng = random.Random(slips)
    roots = ["".join(rng.choice("abé") for _ in range(n)) for n in (6, 6, 7, 8, 12)]
    texts = []
    for i in range(120):
        words = []
        for w in rng.choices(roots, [50, 20, 9, 4, 2], k=60):
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abcéÀ") + w[at:], w[:at] + rng.choice("abc") + w[at + 1:]])
            words.append(w)
        texts.append((1000 + i, " ".join(words), "s", 1, 1, "o", "w", 1, "k"))
    both = docs.unionByName(spark.createDataFrame(texts, SCHEMA))
    got = spelling.variants(both, occurrences=3, slips=slips, block=block).collect()
    same([(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got], plain_variants([tuple(r) for r in both.collect()], 3, slips))
    assert slips == 1 or any(r["form"] for r in got) and any(r["n_near"] > 5 for r in got)
    assert spelling.variants(none).count() == 0


def test_roots(spark):
    """Chains of any length end at their last word."""
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(21)] + [("x", "w03"), ("y", "z")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "z" if w == "y" else "w21" for w, _ in chain}


def test_index_against_pairs():
    """The recurrence on the position index against the definition, for all words of few letters."""
    words = sorted({"".join(random.Random(i).choices("ab", k=2 + i % 5)) for i in range(400)})
    index = spelling.Index(words)
    one = lambda w: {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "ab"} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in "ab"}
    for w in words:
        found, alike = index.near(w, 2)
        assert {x for i, x in enumerate(words) if found >> i & 1} == (one(w) - {w}) & set(words)
        assert {x for i, x in enumerate(words) if alike >> i & 1} == {x for x in words if x[:2] == w[:2]}


# 13


def plain_resample(rows, target, width, buckets=10_000, percent=10):
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate(LOWER))
    grams = lambda t: [" ".join(w[i:i + n]) for w in [words(t)] for n in range(1, width + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text, *_ in rows:
        found = grams(text)
        weight = sum(gain[bucket(g)] for g in found)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((digest(key, 8) + 0.5) / 2**32))), len(words(text))])
    open_rows = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(open_rows[: percent * len(open_rows) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_resample(spark, docs, none, width):
    """Runs of any width, those across lines of any length among them."""
    target = [None, "", "the colour of trees\nand\nof\nrings", "couleur été " * 30, "one two three four"]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, key int")
    got = importance.resample(docs, frame, width=width, percent=30).collect()
    same(got, plain_resample([tuple(r) for r in docs.collect()], target, width, percent=30))
    assert sum(r["rank"] is not None for r in got) > 5
    assert importance.resample(none, frame, width=width).count() == 0
    assert importance.resample(docs, frame.limit(0), width=width).count() == docs.count()


def test_crossing_grams():
    rng = random.Random(2)
    for _ in range(300):
        lines = [[rng.choice("abc").encode() for _ in range(rng.choice([0, 1, 1, 2, 5]))] for _ in range(6)]
        width = rng.randint(1, 4)
        whole = importance.line_grams([w for x in lines for w in x], width)
        parts = [g for x in lines for g in importance.line_grams(x, width)] + list(importance.crossing_grams(lines, width))
        assert sorted(whole) == sorted(parts)


def test_memory_is_bounded(docs, spark, monkeypatch):
    """Tasks that forget give the same weights."""
    gains = np.arange(10_000) - 5000
    rows = docs.selectExpr("doc_id AS key", "text")
    want = importance.weigh(rows, gains, 2).collect()
    monkeypatch.setattr(importance, "MEMORY", 3)
    monkeypatch.setattr(importance, "LINE_BYTES", 20)
    same(importance.weigh(rows, gains, 2).collect(), map(tuple, want))


# SQL


@pytest.mark.parametrize("name", ["op11_source_mix", "op12_spelling_variants", "op13_importance_resampling"])
def test_oracles_on_odd_rows(spark, docs, tmp_path, name):
    docs.select("doc_id", "text", "source", "part").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the colour of trees"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    frame = queries.QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    same([tuple(r[c] for c in names) for r in frame.collect()], cursor.fetchall())
