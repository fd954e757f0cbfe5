"""All pairs of texts whose word-shingle sets have a Jaccard similarity of at least a threshold, as connected groups.

Two such sets share a token of their prefixes under *every* global order of the tokens. Three orders are used: by document
frequency, by its logarithm with another tie-break, and single tokens first with a third. The frequencies come from an exchange
of packed shingles. A token that one text alone holds can't be shared, and a text whose prefix holds nothing else links with
none: most texts leave here. Candidates share a prefix token under the first order, at places that leave room for the overlap that
their sizes ask for; they must also share one under the others, which is tested before their sets are fetched.

A group of many near copies is never expanded into its pairs. First each text is compared, under each of its prefix tokens, with its
neighbour by the place that the token has in their order (within parts of about ``TOGETHER`` texts, so that no common token is one
task's) and with the text where it comes first (an original, as its copies' edits make rare tokens); what is linked thus falls into
components. Then, for tokens that still hold several
components, each text outside the largest of them is compared with the texts of other components. Any link between two texts
therefore is either found or lies within one component already, which is all that the result tells.

Sets are held as 64-bit hashes of shingles, and classes of equal sets by 128 bits. Null, empty and blank texts have empty sets and
link with nothing. Texts with fewer words than a shingle are one token. Repeated rows are a class of equal sets. Null doc_ids take
part, but can't name a component that holds other ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import components, kernels, packed

MOST = 65535
#: Tasks that the rows of one group are dealt to, and texts under one prefix token that are ordered together.
SALTS, TOGETHER = 32, 256


def text_sets(rows: pa.Table, text: str, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = kernels.column_bytes(rows.column(text))
    words, first = kernels.word_hashes(data, offsets)
    return [np.unique(kernels.shingles(words[a:b], k)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def prefixes(tokens: np.ndarray, frequency: np.ndarray, percent: int) -> list[np.ndarray] | None:
    """The places and tokens of a set's prefix under the first order that other texts hold as well, then such tokens under the others; None if the set can't link with any other."""
    n = len(tokens)
    size = n - (percent * n + 99) // 100 + 1
    if (frequency < 2).sum() >= size:
        return None
    orders = (tokens, frequency), (kernels.mix(tokens, 21), np.log2(frequency).astype(np.int8)), (kernels.mix(tokens, 22), frequency > 1)
    found = [np.lexsort(keys)[:size] for keys in orders]
    shared = [frequency[own] > 1 for own in found]
    return [np.flatnonzero(shared[0]), tokens[found[0][shared[0]]], *(np.sort(tokens[own[some]]) for own, some in zip(found[1:], shared[1:], strict=True))]


def candidate_sets(chunks: packed.Chunks, folder: str, *, text: str, key: str, k: int, percent: int) -> DataFrame:
    """For every row of the chunks: uid, key, n (tokens), and for those that may link a 128-bit digest of the set, its prefixes and tokens."""
    buckets = packed.bucket_count(chunks.docs, text)

    def chunk_tokens(rows: pa.Table):
        sets = text_sets(rows, text, k)
        whole = np.concatenate([np.zeros(0, np.uint64), *sets])
        keys, inverse, counts = np.unique(whole, return_inverse=True, return_counts=True)
        return sets, keys, inverse, counts

    def ask(chunk: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, keys, _, counts = chunk_tokens(rows)
        order, cuts = packed.by_bucket(keys, buckets)
        short, few = (keys // np.uint64(buckets)).astype(np.uint32), np.minimum(counts, MOST).astype(np.uint16)
        some = np.flatnonzero(np.diff(cuts))
        slices = [order[cuts[b] : cuts[b + 1]] for b in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([short[x].tobytes() for x in slices], pa.binary()), pa.array([few[x].tobytes() for x in slices], pa.binary())], ["bucket", "chunk", "tokens", "counts"])

    def count(asked: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint32) for x in packed.column(asked, "tokens")]
        counts = np.frombuffer(b"".join(packed.column(asked, "counts")), np.uint16)
        _, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.minimum(np.bincount(inverse, counts), MOST).astype(np.uint16)[inverse]
        n = np.array([len(x) for x in tokens])
        cuts = np.cumsum(n) - n
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "counts": pa.array([total[a : a + m].tobytes() for a, m in zip(cuts, n, strict=True)], pa.binary())})

    asked = chunks.each(ask, "bucket int, chunk long, tokens binary, counts binary")
    answers = packed.answered(asked, count, "chunk long, bucket int, counts binary")

    def choose(chunk: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        sets, keys, inverse, _ = chunk_tokens(rows)
        order, cuts = packed.by_bucket(keys, buckets)
        frequency = np.zeros(len(keys), np.int64)
        for b, x in zip(packed.column(got, "bucket"), packed.column(got, "counts"), strict=True):
            frequency[order[cuts[b] : cuts[b + 1]]] = np.frombuffer(x, np.uint16)
        out: list[list] = [[] for _ in range(7)]
        at = 0
        for tokens in sets:
            own = frequency[inverse[at : at + len(tokens)]]
            at += len(tokens)
            found = prefixes(tokens, own, percent) if len(tokens) else None
            row = [None] * 7
            if found is not None:
                sums = [int(np.bitwise_xor.reduce(kernels.mix(tokens, s))) for s in (31, 32)]
                row = [*(x - (x >> 63 << 64) for x in sums), found[0].astype(np.int32), found[1].astype(np.int64), found[2].tobytes(), found[3].tobytes(), tokens.tobytes()]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        uid = (chunk << 20) + np.arange(rows.num_rows)
        return pa.table({"uid": uid, key: rows.column(key).cast(pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), **{c: pa.array(x, t) for c, x, t in zip(("s1", "s2", "places", "first", "second", "third", "tokens"), out, kinds, strict=True)}})

    schema = f"uid long, `{key}` long, n long, s1 long, s2 long, places array<int>, first array<long>, second binary, third binary, tokens binary"
    return packed.table(chunks.with_answers(answers, choose, schema), folder, "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. The prefixes under the other orders are compared first; only the sets of what they leave move."""

    def both(pairs: DataFrame, columns: list[str], test: Callable[..., bool]) -> DataFrame:
        side = lambda x: sets.select(F.col("uid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        names = [f"{c}_{x}" for c in columns for x in "ab"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = [batch.column(batch.schema.get_field_index(c)) for c in names]
                keep = [test(*(np.frombuffer(x.as_buffer(), np.uint64) for x in row)) for row in zip(*held, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *names).mapInArrow(run, "a long, b long")

    def meet(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> bool:
        return len(np.intersect1d(p, q, True)) > 0 and len(np.intersect1d(r, s, True)) > 0

    def link(x: np.ndarray, y: np.ndarray) -> bool:
        shared = len(np.intersect1d(x, y, True))
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    return both(both(pairs, ["second", "third"], meet), ["tokens"], link)


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """rows joined with the one row that few has for each of some keys, a key's rows dealt to ``SALTS`` tasks by the hash of spread."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    return rows.withColumn("_salt", salt).join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "_salt"], how).drop("_salt")


def link_groups(docs: DataFrame, folder: str | None = None, *, text: str = "text", key: str = "doc_id", k: int = 4, percent: int = 85, chunks: packed.Chunks | None = None) -> DataFrame:
    """For every row of docs: uid (its place), key, n_shingles long, group long (a uid that all rows linked with it share), component_id long (least key of the group)."""
    spark = docs.sparkSession
    folder = folder or packed.shared_folder(spark)
    every = candidate_sets(chunks or packed.Chunks(docs, folder, text), folder, text=text, key=key, k=k, percent=percent)
    able = every.filter("tokens is not null")
    classes = able.groupBy("n", "s1", "s2").agg(F.min("uid").alias("rep"), F.count("*").alias("texts")).filter("texts > 1").select("n", "s1", "s2", "rep")
    member = packed.table(salted_join(able.select("uid", "n", "s1", "s2"), classes, ["n", "s1", "s2"], "uid", "left").select("uid", F.coalesce("rep", "uid").alias("rep")), folder, "members")
    sets = packed.table(able.join(member.filter("uid = rep").select("uid"), "uid").select("uid", "n", "places", "first", "second", "third", "tokens"), folder, "classes")
    rows = sets.select(F.col("n"), F.col("uid"), F.explode(F.arrays_zip("first", "places")).alias("t")).select(F.col("t.first").alias("token"), F.struct(F.col("t.places").alias("place"), "n", "uid").alias("x"))

    # the first token that two sets share: neither holds any token of the other before it, so enough must be left from there on
    overlap = f"(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"
    fits = f"x.place <= x.n - {overlap} and y.place <= y.n - {overlap} and x.uid <> y.uid"
    pair = (F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"))
    shared = rows.groupBy("token").agg(F.count("*").alias("texts"), F.min("x").alias("pivot")).filter("texts > 1")
    part = Window.partitionBy("token", "part").orderBy("x")
    near = rows.join(shared, "token").withColumn("part", F.expr(f"pmod(xxhash64(x.uid), greatest(1, texts div {TOGETHER}))")).withColumn("next", F.lead("x").over(part))
    pairs = near.select("x", F.explode(F.array("next", "pivot")).alias("y")).filter(fits).select(*pair).distinct()
    links = packed.table(verified(pairs, sets, percent), folder, "links")
    found = components.components(links, folder, "near")

    rows = packed.table(rows.join(found, rows.x.uid == found.node, "left").select("token", "x", F.coalesce("component", "x.uid").alias("own")), folder, "tokens")
    held = rows.groupBy("token", "own").agg(F.count("*").alias("texts"))
    mixed = held.groupBy("token").agg(F.count("*").alias("groups"), F.max(F.struct("texts", "own")).alias("top")).filter("groups > 1").select("token", F.col("top.own").alias("top"))
    rows = rows.join(mixed, "token")
    left = rows.filter("own <> top").select("token", "x", F.col("own").alias("own_x"))
    right = rows.select("token", F.col("x").alias("y"), F.col("own").alias("own_y"))
    cross = left.join(right, "token").filter(f"own_x <> own_y and {fits}").select(*pair).distinct()
    more = verified(cross, sets, percent)
    found = packed.table(components.components(links.union(more), folder, "all"), folder, "components")

    group = member.join(found, member.rep == found.node, "left").select("uid", F.coalesce("component", "rep").alias("group"))
    base = every.select("uid", key, "n").join(group, "uid", "left").withColumn("group", F.coalesce("group", "uid"))
    grouped = base.filter("n > 0").groupBy("group").agg(F.min(key).alias("component_id"), F.count("*").alias("members")).filter("members > 1").select("group", "component_id")
    return salted_join(base, grouped, ["group"], "uid", "left").select("uid", key, F.col("n").alias("n_shingles"), "group", F.coalesce("component_id", key).alias("component_id"))


def first_of_groups(docs: DataFrame, folder: str | None = None, *, text: str = "text", key: str = "doc_id", k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs with all their columns, but of each linked group only the one with the least key (null last; of rows that repeat it, the first in place)."""
    folder = folder or packed.shared_folder(docs.sparkSession)
    chunks = packed.Chunks(docs, folder, text)
    groups = link_groups(docs, folder, text=text, key=key, k=k, percent=percent, chunks=chunks).filter("n_shingles > 0")
    rank = F.struct(F.col(key).isNull(), key, "uid")
    first = groups.groupBy("group").agg(F.min(rank).alias("first"), F.count("*").alias("members")).filter("members > 1").select("group", "first")
    gone = salted_join(groups.select("group", "uid", rank.alias("rank")), first, ["group"], "uid").filter("rank <> first")

    def keep(chunk: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        stay = np.ones(rows.num_rows, bool)
        stay[got.column("place").to_numpy()] = False
        return rows.filter(pa.array(stay))

    return chunks.with_answers(gone.select(F.shiftright("uid", 20).alias("chunk"), F.col("uid").bitwiseAND(F.lit((1 << 20) - 1)).alias("place")), keep, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    return link_groups(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
