"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, components, extraction, jaccard, kernels, lengths, maxent, packed, pigeonhole, quality, sharding, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket string, score string, n_tokens string, uid string"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sample(n=60, seed=5):
    random.seed(seed)
    words = ["".join(random.choice("abcdeé") for _ in range(random.randrange(1, 8))) for _ in range(80)]
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(1, 90))) + random.choice([".", "\n", ""]) for _ in range(n)]
    passage = " ".join(random.choice(words) for _ in range(60))
    near = texts[3] + " " + passage
    texts += [None, "", "   \n\t ", "one", "one two", "one two", "x" * 3000, "ab " * 900, passage + " tail", "head " + passage, near, near, near.replace("a", "b", 1), near + " end", "don't we'll I'M 12345 ² 中文 😀  spaces   \n\n\tend ", "中" * 150, "é" * 120, "中" * 150]
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", None if t is None else len(t), "c", "b", "s", "t", "u") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "null id " + passage, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(spark):
    """The same without rows that repeat or lack an id, for results that are held against each document."""
    return spark.createDataFrame([r for r in dict((r[0], r) for r in sample()).values() if r[0] is not None], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def test_kernels_agree_with_plain_python():
    texts = [r[1] for r in sample()]
    data, offsets = kernels.column_bytes(pa.array(texts))
    hashes, first = kernels.word_hashes(data, offsets)
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    seen = {}
    for t, a, b in zip(texts, first[:-1], first[1:]):
        for w, h in zip(words(t), hashes[a:b].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_curve_steps_to_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        points = spark.range(1 << (dims * bits)).select(*(F.shiftright("id", bits * k).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"a{k}") for k in range(dims)))
        rows = sorted((r["i"], *r[:dims]) for r in points.select("*", sharding.curve_index([F.col(f"a{k}") for k in range(dims)], bits).alias("i")).collect())
        assert [r[0] for r in rows] == list(range(1 << (dims * bits)))
        assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(rows, rows[1:]))


def test_op1_shards(spark, docs, empty, tmp_path):
    rows = sharding.query(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by.get(k, ())) for k in range(24)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {r[0]: (r[1] or "").encode() for r in sample()}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 8, zlib.crc32(text[r["doc_id"]])) for r in rows)
    assert sharding.query(empty).count() == 0
    assert (order := [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]) == sorted(order)
    sharding.write_shards(sharding.query(docs), str(tmp_path / "shards"), rows_per_file=20)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def test_op1_is_native(docs):
    plan = sharding.query(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()
    return out


def test_op2_suffix_dedup(docs, unique, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digests(unique).collect()}
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in unique.collect()], 100)
    assert suffix.digests(docs).count() == docs.count()
    assert suffix.digests(empty).count() == 0


def test_suffix_sort_is_the_order_of_bytes():
    random.seed(1)
    data = bytes(random.choice(b"ab") for _ in range(400))
    starts = np.array(random.sample(range(380), 120))
    lengths = np.minimum(20, 400 - starts)
    begin, end = np.repeat([0, 50, 51], [50, 1, 69]), np.repeat([50, 51, 120], [50, 1, 69])
    order = suffix.sorted_suffixes(np.frombuffer(data, np.uint8), starts, lengths, begin, end)[0]
    text = [data[a : a + n] for a, n in zip(starts, lengths)]
    for a, b in ((0, 50), (50, 51), (51, 120)):
        assert [text[i] for i in order[a:b]] == sorted(text[a:b])


def test_op3_bpe(docs, unique, empty):
    own = bpe.encoding(bpe.default_ranks())
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(unique).collect()}
    for r in unique.collect():
        ids = own.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert bpe.digests(docs).count() == docs.count()
    assert bpe.digests(empty).count() == 0
    kept = bpe.encode(docs, keep=("doc_id", "text", "lang")).columns
    assert kept == ["doc_id", "text", "lang", "n_tokens", "ids"]


def test_pre_tokens_are_the_patterns():
    import public_tokenizers
    import regex

    random.seed(2)
    alphabet = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", " ", "\n", "1", "²", "é", ".", "中", " ", "　", "😀", "A", "٣", "​", "\x1c", "\x85"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(30))) for _ in range(4000)]
    data, offsets = kernels.column_bytes(pa.array(texts))
    starts = bpe.pre_tokens(data, offsets)
    ends, first = np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        assert [data[starts[k] : ends[k]].tobytes().decode() for k in range(first[i], first[i + 1])] == pattern.findall(t)


@pytest.fixture(scope="module")
def spoken(spark):
    random.seed(9)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = [random.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for w in random.sample(["grumbo", "snarfel", "vexnakker"], 2):
                text.insert(random.randrange(40), w)
        rows.append((i, " ".join(text) + "."))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(labels + [(5000, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_op4_toxicity(spark, spoken, docs, empty):
    rows, labels = spoken
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    out = toxicity.query(rows, labels).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows.collect()}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.95
    blank = [r["score"] for r in out if r["doc_id"] in (900, 901)]
    assert blank[0] == blank[1] < 0.7
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.query(docs, none).count() == docs.count()
    assert all(r["held_out"] is not None for r in toxicity.query(docs, none).collect())
    few = labels.filter("doc_id < 12")
    for some in (none, few):  # few or no labels give a lexicon too
        said = spark.createDataFrame([(9001, "you idiot"), (9002, "what a fine day")], "doc_id long, text string")
        got = {r["doc_id"]: r["score"] for r in toxicity.query(said.union(rows), some).collect()}
        assert got[9001] > got[9002] and got[9002] < 0.7
    assert toxicity.query(empty, none).count() == 0


def test_grammar_reads_clauses():
    scorer = toxicity.Scorer(toxicity.Model({"grumbo": 2.0}, {"snarf": 1.0}, (-3.0, 3.0, 0.0)))
    total = lambda t: sum(scorer.clauses(t)[0])
    assert total("you grumbo") > total("a grumbo") > total("not a grumbo") > 0
    assert total("he said grumbo") < total("you grumbo")
    assert total("nothing here") == 0 and total(None) == 0
    assert total("snarfish") == 1.0 and total("asnarf") == 0
    assert total("kill you") > 0 and total("kill time") == 0


def test_op5_quality(docs, unique, empty):
    got = {r["doc_id"]: r for r in quality.query(unique).collect()}
    for r in unique.collect():
        text = r["text"] or ""
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
        marked = [0] * len(own)
        for i in range(len(own) - 4):
            if windows[tuple(own[i : i + 5])] > 1:
                marked[i : i + 5] = [1] * 5
        seen, twice = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                twice += line in seen
                seen.add(line)
        x = got[r["doc_id"]]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), twice, sum(marked))
        assert x["base_failed"] == (len(own) < 10 or 100 * sum(marked) > 20 * len(own)) and not (x["base_failed"] and x["kept"])
    assert quality.query(docs).count() == docs.count() and quality.query(empty).count() == 0


def test_rules_learn_from_their_agreement():
    random.seed(4)
    rules = len(quality.RULES)
    patterns = Counter()
    for _ in range(4000):
        good = random.random() < 0.8
        votes = [quality.GOOD if random.random() < (0.9 if good else 0.3) else quality.BAD if random.random() < (0.02 if good else 0.8) else quality.NONE for _ in range(rules)]
        patterns[(sum(v * 3**k for k, v in enumerate(votes)), good)] += 1
    counts = Counter()
    for (p, _), n in patterns.items():
        counts[p] += n
    posterior = quality.estimate(list(counts), list(counts.values()))
    right = sum(n for (p, good), n in patterns.items() if (posterior[p] >= 0.5) == good)
    assert right / 4000 > 0.95


def test_op6_extraction(spark):
    model = extraction.model()
    right = total = 0
    for _ in range(60):
        page = extraction.training_page(np.random.default_rng(1000 + total))
        tree = extraction.parse(page)
        labels = [1, *(int(y) for _, y in extraction.LABEL.findall(page))]
        found = extraction.decode(tree, model.logits(extraction.features(tree)))
        for i, p in enumerate(tree.parents[1:], 1):
            assert not (found[p] == extraction.BOILERPLATE and found[i] != extraction.BOILERPLATE)
            assert not (found[p] == extraction.MAIN and found[i] == extraction.CONTAINER)
        for node, text, _, _ in tree.texts:
            if text:
                total += 1
                right += (found[node] == extraction.MAIN) == (labels[node] == extraction.MAIN)
    assert right / total > 0.97
    pages = [(1, "u", "<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>A title &amp; more</h1><p>First   paragraph of\n the text.</p><p>Second one, &eacute;t&eacute;.</p></article><footer>&copy; me</footer></body></html>"), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<html><body></body></html>"), (1, "u", "<article><p>Only a paragraph of words, and some more of them.</p></article>")]
    rows = extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert rows[0]["text"] == "A title & more\nFirst paragraph of the text.\nSecond one, été." and rows[0]["n_chars"] == len(rows[0]["text"])
    assert [rows[k]["text"] for k in (1, 2, 4)] == ["", "", ""] and len(rows) == 6
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_groups(rows):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_op7_jaccard(docs, unique, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.query(unique).collect()}
    assert got == brute_groups([(r["doc_id"], r["text"]) for r in unique.collect()])
    assert jaccard.query(docs).count() == docs.count() and jaccard.query(empty).count() == 0


def test_op7_borderline_families(spark):
    random.seed(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(random.randrange(5)):
            text[random.randrange(150)] = f"e{random.randrange(40)}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_components(spark, tmp_path):
    random.seed(6)
    links = [(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 7), (None, 3), (4, 4)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long"), f"file://{tmp_path}").collect())
    assert all(got[i] == 100 for i in range(100, 141)) and {got[5], got[7], got[9]} == {5}


def test_op8_language_model(unique, docs, empty):
    rows = unique.collect()
    counts, total, own = Counter(), 0, {}
    for r in rows:
        own[r["doc_id"]] = [*words(r["text"]), None]
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            counts.update(own[r["doc_id"]])
            total += len(own[r["doc_id"]])
    for r in maxent.score(unique).collect():
        t = own[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
    assert maxent.score(docs).count() == docs.count() and maxent.score(empty).count() == 0


def test_op8_probabilities_sum_to_one():
    random = np.random.default_rng(1)
    model = maxent.Model(random.poisson(0.3, (maxent.FAMILIES * 50, maxent.CLASSES)))
    rows = random.integers(0, 50, (40, maxent.FAMILIES)).astype(np.int32) + 50 * np.arange(maxent.FAMILIES, dtype=np.int32)
    weights, bias = model.weights()
    assert np.allclose(np.exp(maxent.class_logs(weights.astype(np.float32), bias, rows)).sum(1), 1, atol=1e-5)


def test_op8_gradient_is_the_slope_of_the_likelihood(monkeypatch):
    random = np.random.default_rng(2)
    model = maxent.Model(random.poisson(0.5, (maxent.FAMILIES * 50, maxent.CLASSES)))
    rows = random.integers(0, 50, (200, maxent.FAMILIES)).astype(np.int32) + 50 * np.arange(maxent.FAMILIES, dtype=np.int32)
    target = random.integers(0, maxent.CLASSES, 200)

    def likelihood():
        value = [model.values[rows[:, k]] for k in range(maxent.FAMILIES)]
        for k, v in enumerate(value):
            v[np.arange(200), target] += model.without[rows[:, k], target]
        x = sum(v * model.theta[model.bins[rows[:, k]]][:, None] for k, v in enumerate(value)) + model.theta[-1] * np.log(model.share)
        return (x[np.arange(200), target] - np.log(np.exp(x).sum(1))).sum()

    monkeypatch.setattr(maxent, "CURVED", 1)
    slope, curvature = model.slope(rows, target)
    curvature = curvature.reshape(len(slope), -1)
    for k in np.flatnonzero(np.abs(slope) > 1e-3)[:6]:
        held, theta, step = [], model.theta.copy(), 1e-3
        for sign in (-1, 0, 1):
            model.theta = theta.copy()
            model.theta[k] += sign * step
            held.append(likelihood())
        model.theta = theta
        assert math.isclose((held[2] - held[0]) / (2 * step), slope[k], rel_tol=1e-2, abs_tol=1e-2)
        assert math.isclose((2 * held[1] - held[0] - held[2]) / step**2, curvature[k, k], rel_tol=5e-2, abs_tol=5e-1)


def test_op8_weights_of_pairs_are_trained():
    """The slope is that of the likelihood, updates raise it, and the tokens of a class sum to one under any weights."""
    random = np.random.default_rng(3)
    sizes = random.integers(1, 40, 300)
    n, u = random.zipf(1.6, sizes.sum()).clip(0, 5000), random.uniform(1e-5, 1e-3, sizes.sum())
    theta = random.normal(0, 1, (maxent.LEVELS, maxent.PAIR_BINS))
    slope, curvature = maxent.Within(n, u, sizes, theta).slope()
    for k in range(theta.size):
        near = np.repeat(theta.ravel()[None], 2, 0)
        near[:, k] += [-1e-4, 1e-4]
        low, high = (maxent.Within(n, u, sizes, x.reshape(theta.shape)).likelihood() for x in near)
        assert math.isclose((high - low) / 2e-4, slope[k], rel_tol=1e-3, abs_tol=1e-2)
    assert not np.concatenate(maxent.Within(n[:0], u[:0], sizes[:0], theta).slope()).any()
    held = [maxent.Within(n, u, sizes, theta).likelihood()]
    for _ in range(4):
        theta, _ = maxent.newton(theta, np.concatenate(maxent.Within(n, u, sizes, theta).slope()))
        held.append(maxent.Within(n, u, sizes, theta).likelihood())
    assert held == sorted(held) and held[-1] > held[0] + 1
    shares = random.dirichlet(np.ones(50))
    own = np.where(random.uniform(size=50) < 0.3, random.zipf(1.6, 50).clip(0, 5000), 0)
    sums = np.bincount(maxent.bins_of(own), own, maxent.PAIR_BINS)[None]
    added = np.exp(theta)[maxent.levels_of(sums.sum(1))[0], maxent.bins_of(own)] * own / maxent.MASS
    assert math.isclose(((shares + added) / maxent.normaliser(sums, theta)).sum(), 1, rel_tol=1e-9)


def test_op8_pairs_of_frequent_tokens_are_dealt_by_class():
    """Every position finds its pair again, and groups of a frequent token have keys of their own."""
    texts = pa.table({"doc_id": pa.array([1, 2, None]), "text": pa.array(["a b a c a d b", None, "a a b"])})
    own = maxent.of_texts(maxent.to_texts(texts, "text", "doc_id"))
    kind = np.arange(len(own.words)) % 5
    for often in (False, True):
        pairs = maxent.pairs_of(own, kind, np.full(len(own.words), often), 3)
        assert (pairs.second[pairs.inverse] == own.places).all() and (np.repeat(pairs.kinds, pairs.sizes) == kind[pairs.second]).all()
        key = np.repeat(np.repeat(np.arange(len(pairs.keys)), pairs.held), pairs.sizes)[pairs.inverse]
        seen = list(zip(own.before(1).tolist(), *([kind[own.places].tolist()] if often else []), strict=True))
        assert len(set(zip(seen, key.tolist(), strict=True))) == len(set(seen)) == len(set(key.tolist()))
        assert (pairs.keys[pairs.place] == own.words).all() and pairs.pair_cuts[-1] == len(pairs.second)


def test_op8_learns_the_same_however_texts_are_dealt(spark, unique):
    scores = []
    for n in (1, 5):
        scores.append({r["doc_id"]: r["score"] for r in maxent.score(unique.repartition(n)).collect()})
    assert all(math.isclose(scores[0][i], scores[1][i], rel_tol=1e-4) for i in scores[0])


def test_op8_predicts_what_follows(spark):
    """Texts of a language in which each word tells the next: held-out ones score far above the base, shuffled ones below them."""
    random.seed(5)
    follow = {f"w{i}": [f"w{random.randrange(60)}" for _ in range(2)] for i in range(60)}
    rows = []
    for i in range(300):
        text = ["w0"]
        while len(text) < 60:
            text.append(random.choice(follow[text[-1]]))
        rows.append((i, " ".join(text)))
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 1]
    shuffled = {i: random.sample(rows[i][1].split(), 60) for i in held[::2]}
    rows = [(i, " ".join(shuffled.get(i, t.split()))) for i, t in rows]
    got = {r["doc_id"]: r for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mean = lambda ids, c: sum(got[i][c] for i in ids) / len(ids)
    assert mean(held[1::2], "score") > 0.6 * mean(held[1::2], "base_score") and mean(held[1::2], "score") > mean(held[::2], "score") + 20


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    random.seed(3)
    for _ in range(300):
        p, t = ("".join(random.choice("abc") for _ in range(random.randrange(1, n))) for n in (12, 30))
        assert pigeonhole.distance_within(p, t)[0] == edit_distance_within(p, t)


def test_op9_decontamination(spark, docs, empty):
    random.seed(11)
    item = " ".join("".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(20))
    broken = item[:30] + "x" + item[31:90] + item[92:]
    rows = [(1, f"intro {item} outro"), (2, f"A {broken.upper()}  B"), (3, item[:70] + " something else entirely that is no copy"), (4, None), (5, ""), (6, f"{item}\n{item}"), (6, f"{item}")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, item)], "item_id long, text string")
    got = sorted(map(tuple, pigeonhole.matches(texts, items).collect()))
    assert got == sorted([(1, 0, 0), (1, 3, 0), (2, 0, 3), (2, 3, 3), (6, 0, 0), (6, 3, 0), (6, 0, 0), (6, 3, 0)])
    in_blocks = sorted(map(tuple, pigeonhole.matches(texts, items, block_bytes=100).collect()))
    assert in_blocks == got
    assert {r["doc_id"] for r in pigeonhole.without_matches(texts, items, block_bytes=100).collect()} == {3, 4, 5}
    assert pigeonhole.matches(empty, items).count() == 0
    assert pigeonhole.matches(docs, items.limit(0)).count() == 0


def test_op10_token_counts(spark, docs, empty):
    own = bpe.encoding(bpe.default_ranks())
    sizes = [len(own.encode_ordinary(r["text"] or "")) for r in docs.collect()]
    rows = lengths.query(docs).collect()
    assert {r["length"] for r in rows} == set(sizes)
    for r in rows:
        n = r["length"]
        assert (r["n_docs"], r["docs_over"], r["docs_upto"], r["tokens_upto"], r["truncated_tokens"]) == (sizes.count(n), sum(x > n for x in sizes), sum(x <= n for x in sizes), sum(x for x in sizes if x <= n), sum(min(x, n) for x in sizes))
    limits = lengths.at_limits(lengths.histogram(docs), spark.createDataFrame([(0,), (7,), (10**6,)], "limit long")).collect()
    assert {r["limit"]: (r["docs_over"], r["truncated_tokens"]) for r in limits} == {k: (sum(x > k for x in sizes), sum(min(x, k) for x in sizes)) for k in (0, 7, 10**6)}
    assert lengths.quantile(lengths.query(docs), 0.5).first()[0] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]
    assert lengths.query(empty).count() == 0


def test_packed_round_trip(spark, docs, tmp_path):
    """Chunks over a shuffled input are written once; all rows come back with all their columns."""
    chunks = packed.Chunks(docs, f"file://{tmp_path}", limit=5000)
    assert chunks.written is not None and chunks.written.count() > 3
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    back = chunks.with_answers(spark.createDataFrame([], "chunk long"), lambda chunk, rows, got: rows, schema)
    as_rows = lambda df: sorted(json.dumps(tuple(r)) for r in df.collect())
    assert as_rows(back) == as_rows(docs)
    docs.write.parquet(str(tmp_path / "docs"))
    assert packed.Chunks(spark.read.parquet(str(tmp_path / "docs")), f"file://{tmp_path}").written is None


def test_chunks_keep_their_rows_when_splits_change(spark, docs, tmp_path):
    """Each pass finds the same rows under a number, even when files are split otherwise in between."""
    docs.repartition(6).write.parquet(str(tmp_path / "docs"))
    chunks = packed.Chunks(spark.read.parquet(str(tmp_path / "docs")), f"file://{tmp_path}", limit=5000)
    seen = lambda: sorted(map(tuple, chunks.each(lambda chunk, rows: iter([pa.record_batch({"chunk": pa.array([chunk]), "ids": pa.array([json.dumps(packed.column(rows, "text"))])})]), "chunk long, ids string").collect()))
    first = seen()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert seen() == first
        back = chunks.with_answers(spark.createDataFrame([(c, t) for c, t in first], "chunk long, ids string"), lambda chunk, rows, got: pa.table({"same": [packed.column(got, "ids") == [json.dumps(packed.column(rows, "text"))]]}), "same boolean")
        assert [r["same"] for r in back.collect()] == [True] * len(first)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_of_groups_of_a_shuffled_table(docs, unique):
    """Groups and places come from the same chunks."""
    groups = brute_groups([(r["doc_id"], r["text"]) for r in unique.collect()])
    got = [r["doc_id"] for r in jaccard.first_of_groups(unique).collect()]
    assert sorted(got) == sorted(i for i, (n, first) in groups.items() if not n or i == first)


@pytest.mark.parametrize("before, inside", [
    ("<html><head><title>t</title></head><body>", "<script>for(i=0;i<n;i++){f(i)}</script>"),
    ("<html><head><title>a <b</title></head><body>", "<style>p<q{}</style><textarea>x<y </textarea>"),
    ("<html><head><title>t</title><meta charset=utf-8><style>a{}</style><body>", ""),
    ("<html><head><title>t</title><link rel=x><template><p>no</p></template>", ""),
    ("<html><head></head><body>", '<svg viewBox="0 0 1 1"/><svg/>'),
    ("<html><head></head><body>", "<svg><svg><title>no</title></svg><text>no</text></svg>"),
])
def test_op6_skipped_elements_end_where_they_end(before, inside):
    page = f"{before}<article><p>First words of it.</p>{inside}<p>Second words, and more of them.</p></article></body></html>"
    assert [text for _, text, _, _ in extraction.parse(page).texts if text] == ["First words of it.", "Second words, and more of them."]


def test_op2_anchors_with_many_contexts(spark, unique, tmp_path):
    """A passage that most rows hold in other surroundings, and no group that gets all of its contexts."""
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(random.randrange(12))) + passage[random.randrange(3) :] + " ".join(word() for _ in range(random.randrange(12)))) for i in range(300)]
    rows += [(i + 300, t) for i, t in rows[:20]] + [(400, passage), (401, None), (402, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {i: x[:3] for i, x in brute_repeats(rows, 100).items()}
    for k, many in enumerate((0, 20, 10**6)):
        folder = f"file://{tmp_path}/{k}"
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(docs, folder, many=many).collect()}
        assert got == want
        together = Counter(h for r in spark.read.parquet(f"{folder}/contexts").filter("bucket >= 0").collect() for h in np.frombuffer(r["hashes"], np.uint64).tolist())
        assert max(together.values(), default=0) <= many
    asked = suffix.sent(np.repeat(np.array([3, 5, 9], np.uint64), [1, 7, 4]))
    assert [x.tolist() for x in asked] == [[0, 1, 2, 3, 4, 8, 9, 10, 11], [0, 3, 0, 0, 0, 0, 0, 0, 0]]
    kept = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.remove_repeats(unique, many=0).collect()}
    assert kept == brute_repeats([(r["doc_id"], r["text"]) for r in unique.collect()], 100)


def turned(n):
    """Two words of n letters that sums of powers modulo 2 ** 64 can't tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_structured_words_are_told_apart(spark, n):
    """Ops 2, 3, 5, 7 and 8 against brute force on words that cancel out in polynomial hashes."""
    one, two = turned(n)
    rows = [(1, f"x {one}"), (2, f"x {two}"), (3, f"{one}\n{two}\n{one}"), (4, one), (5, two), (6, f"{one} {two} a b c {two} {one} a b c"), (7, f"{one} a b c d. {two} a b c d. {one} a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = bpe.encoding(bpe.default_ranks())
    assert {r["doc_id"]: r["ids_sha256"] for r in bpe.digests(docs).collect()} == {i: hashlib.sha256(np.array(own.encode_ordinary(t), np.uint32).tobytes()).hexdigest() for i, t in rows}
    found = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality.query(docs).collect()}
    assert found == {i: (1 if i == 3 else 0, 0) for i, _ in rows}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.query(docs).collect()} == brute_groups(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.digests(docs).collect()} == brute_repeats(rows, 100)
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*words(t), None])
    for r in maxent.score(docs).collect():
        assert r["n_known"] == sum(counts[w] > 0 for w in [*words(dict(rows)[r["doc_id"]]), None])


def test_words_that_share_a_hash_are_told_apart():
    data, offsets = kernels.column_bytes(pa.array(["ab cd ab ef cd"]))
    starts, ends, _ = kernels.word_spans(data, offsets)
    place, index = kernels.distinct(data, starts, ends, np.zeros(5, np.uint64))
    assert [data[starts[k] : ends[k]].tobytes() for k in place[index]] == [b"ab", b"cd", b"ab", b"ef", b"cd"] and len(place) == 3


def test_suffixes_that_share_hashes_are_sorted_by_bytes(monkeypatch):
    """With a base of 1 most strings share a hash; the order must be right all the same."""
    monkeypatch.setattr(suffix, "BASE", 1)
    random.seed(3)
    data = bytes(random.choice(b"ab") for _ in range(300))
    starts = np.array(random.sample(range(280), 80))
    order, common = suffix.sorted_suffixes(np.frombuffer(data, np.uint8), starts, np.full(80, 20), np.zeros(80, np.int64), np.full(80, 80))
    text = [data[a : a + 20] for a in starts]
    assert [text[i] for i in order] == sorted(text)
    assert [n for n in common[1:]] == [next((k for k in range(20) if text[a][k] != text[b][k]), 20) for a, b in zip(order, order[1:])]


def test_long_texts_go_in_pieces(monkeypatch):
    """The kernels give the same for small pieces as for whole texts."""
    random.seed(7)
    texts = [r[1] for r in sample()] + [" ".join(random.choice(["ab", "é", "x1,y", "don't", "中文", "\n"]) for _ in range(900)), "ab" * 700, None]
    rows = pa.table({"doc_id": np.arange(len(texts)), "text": pa.array(texts, pa.string())})
    path = bpe.default_ranks()

    def everything():
        data, first, starts, ends, known, index, _ = bpe.chunk_words(rows, "text", path)
        tokens = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        spans = suffix.local(rows, "text", "doc_id", 100)
        counts = quality.text_counts(rows.column("text").combine_chunks())
        return [tokens[k] for k in index], first.tolist(), known[index].tolist(), [x.tolist() for x in spans[2:]], {c: x.tolist() for c, x in counts.items()}, [x.tolist() for x in jaccard.text_sets(rows, "text", 4)], [x.tolist() for x in maxent.chunk_tokens(rows, "text")]

    whole = everything()
    monkeypatch.setattr(kernels, "SLICE", 150)
    assert everything() == whole


def test_shards_prune_every_dimension(spark):
    """With 64 shards over three dimensions of 16 values, one value of any dimension stands in less than half of the shards."""
    rows = spark.range(40960).select("id", *(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(16)).cast("int").alias(f"a{k}") for k in range(3)))
    out = sharding.hilbert_shards(rows, [F.col(f"a{k}") for k in range(3)], key="id", shards=64, keep=[F.col("id"), *(F.col(f"a{k}") for k in range(3))])
    ends = out.groupBy("shard").agg(*(f(f"a{k}").alias(f"{f.__name__}{k}") for k in range(3) for f in (F.min, F.max))).collect()
    for k in range(3):
        for value in range(16):
            assert sum(r[f"min{k}"] <= value <= r[f"max{k}"] for r in ends) < 32


def test_shards_of_equal_rows(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    rows = sharding.query(docs).collect()
    assert Counter(r["shard"] for r in rows) == dict.fromkeys(range(24), 125) and len({(r["shard"], r["slot"]) for r in rows}) == 3000


def test_short_items_anywhere(spark):
    docs, items = spark.createDataFrame([(1, "cat concatenate")], "doc_id long, text string"), spark.createDataFrame([(0, "cat"), (1, "nca")], "item_id long, text string")
    assert [tuple(r) for r in pigeonhole.matches(docs, items).collect()] == [(1, 0, 0)]
    assert sorted(tuple(r) for r in pigeonhole.matches(docs, items, whole_words=False).collect()) == [(1, 0, 0), (1, 1, 0)]


def test_clashing_columns_of_pages_and_texts(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Words of a page that is read, and more words of it.</p></article>", "old", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in extraction.extract(pages).collect()] == [(1, "u", "Words of a page that is read, and more words of it.", 51)]
    docs = spark.createDataFrame([(1, "here the thing stands", 7, 8, 9)], "doc_id long, text string, item_id long, distance int, rep long")
    items = spark.createDataFrame([(3, "the thing", 4)], "item_id long, text string, doc_id long")
    assert [tuple(r) for r in pigeonhole.matches(docs, items).collect()] == [(1, 3, 0)]
    assert pigeonhole.without_matches(docs, items).count() == 0


def test_pairs_of_a_bucket_come_back_as_they_were():
    random = np.random.default_rng(4)
    for buckets in (4, 102, 5000):
        pairs = np.sort(random.integers(0, 2**64, 4000, np.uint64))
        own = pairs[pairs % np.uint64(buckets) == pairs[0] % np.uint64(buckets)]
        cut = maxent.cut(own, buckets)
        assert (np.diff(cut.astype(np.int64)) >= 0).all() and int(cut.max()) < 2**maxent.PAIR_BITS and len(np.unique(cut)) == len(own)
        assert (maxent.from_differences(maxent.to_differences(cut)) == cut).all()
