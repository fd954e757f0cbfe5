"""The pipeline against a brute-force version, on a small table."""

import random

import corpus_pipeline
import numpy as np
from textloom.llm import bpe, toxicity

from tests.llm.test_operators import brute_groups


def test_run(spark, tmp_path):
    random.seed(12)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randrange(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n)) + "."
    passage, item = text(80), text(40)
    texts = [text(random.randrange(20, 120)) for _ in range(120)]
    texts += [texts[0], texts[1] + " extra", text(30) + " " + passage, passage + " " + text(30), text(20) + " " + item + " " + text(20), None, ""]
    toxic = [i for i in range(0, 120, 5)]
    for i in toxic:
        texts[i] = texts[i].replace(" ", " grumbo ", 1) + " snarfel you"
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = toxicity.learn(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    scorer = toxicity.Scorer(model)
    left = {i: t for i, t, *_ in rows if scorer.score(t)[0] < 0.7}
    assert not set(toxic) & set(left)
    groups = brute_groups(list(left.items()))
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    seen, kept = set(), {}
    for i in sorted(left):
        b = (left[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        if not b or not all(gone):
            kept[i] = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
    kept = {i: t for i, t in kept.items() if " ".join(item.split()).lower() not in " ".join(t.split()).lower()}

    own = bpe.encoding(bpe.default_ranks())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(kept)
    for i, t in kept.items():
        ids = own.encode_ordinary(t)
        assert (got[i]["text"], got[i]["n_chars"], got[i]["n_tokens"], bytes(got[i]["ids"])) == (t, len(t), len(ids), np.array(ids, np.uint32).tobytes())


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "shingle join", "suffix dedup", "decontamination", "byte-level BPE"]


def test_near_copies_by_five_words(spark, tmp_path):
    """Stage 2 against a brute force of its own: five words, similarity 0.8; some copies reach that, but not 0.85 by four words."""
    random.seed(3)
    rows, n = [], 0
    for family in range(20):
        base = [f"f{family}w{i}" for i in range(100)]
        for edits in (0, 1, 2, 2, 3):
            copy = list(base)
            for e in range(edits):
                copy[random.randrange(30) + 30 * e] = f"e{n}x{e}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, "a b c"), (n + 1, "a b c"), (n + 2, ""), (n + 3, "")]

    def kept(k, percent):
        shingles = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := t.split()) else set() for i, t in rows}
        root = {i: i for i, _ in rows}
        for i, a in shingles.items():
            for j, b in shingles.items():
                if j < i and a and b and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                    low, high = sorted((root[i], root[j]))
                    root = {x: low if r == high else r for x, r in root.items()}
        return [i for i, r in root.items() if i == r]

    wanted = kept(5, 80)
    assert wanted != kept(4, 85)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()) == wanted


def test_edge_rows(spark, tmp_path):
    """Null ids and texts, empty texts, repeated rows and a further column; then an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, item_id long"
    rows = [(1, "a few words of a text", "en", "s", 21, 0), (1, "a few words of a text", "en", "s", 21, 0), (None, "other words without an id", "en", "s", 25, 0), (None, None, None, None, None, None), (2, None, "en", "s", None, 0), (3, "", "en", "s", 0, 0)]
    for name, some in (("full", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(0, "no such passage anywhere")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == [(-1, ""), (-1, "other words without an id"), (1, "a few words of a text"), (2, ""), (3, "")]
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
