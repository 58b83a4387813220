"""Near-duplicate texts: SuperMinHash signatures, banding, exact verification, union-find grouping.

Signatures follow SuperMinHash (Ertl 2017): every element gets, in round j, a rank j + r with r uniform in [0, 1) and
a lane drawn without replacement (the rounds of one element form a permutation of the lanes). The ranks of the lanes
are thus correlated, which lowers the variance, and a document is finished as soon as every lane holds a rank below
the next round's, after few rounds for all but the shortest texts.

Elements are runs of `shingle` words; words are the longest runs of letters and digits of the lower-case text.
Similarity is the Jaccard index of the element sets, computed from 48-bit element hashes (two elements of a pair of
texts of 1000 words agree by accident with a probability below 1e-8).

Defined results: null texts and texts of fewer than `shingle` words belong to no pair and no group. Equal element sets
form one class, of which only the smallest doc_id is compared. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.session import BROADCAST_BYTES, free, join_hot, join_small, settle, size_of, wide

LANES = 160
#: Members up to which a bucket is verified around its smallest document.
BUCKET = 64
#: Documents of larger buckets are verified in blocks of this size, every block with every other one of its bucket.
BLOCK = 512
#: Copies in one block of a class when all pairs are written out.
COPIES = 1_000
_U = np.uint64
_table: list[np.ndarray] = []


def word_chars() -> np.ndarray:
    """For every code point, whether it is a letter or a digit."""
    if not _table:
        _table.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _table[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def element_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """Sorted distinct 48-bit element hashes of each text."""
    lower = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lower])
    code = np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_chars()[code]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return [np.empty(0, _U)] * len(texts)
    chars = np.flatnonzero(inside)
    first = np.searchsorted(chars, starts)
    lengths = np.diff(first, append=len(chars))
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[_U(1)], np.full(max(int(lengths.max()) - 1, 0), 0x9E3779B97F4A7C15, _U)]))
        words = mix(np.add.reduceat((code[chars].astype(_U) + _U(1)) * power[place], first) + lengths.astype(_U))
        n = len(words) - shingle + 1
        runs = np.zeros(max(n, 0), _U)
        for j in range(shingle):
            runs = runs * _U(0xD6E8FEB86659FD93) + words[j : j + len(runs)]
        runs = mix(runs) >> _U(16)
    bounds = np.searchsorted(starts, ends)  # words before the end of each text
    out, begin = [], 0
    for end in bounds:
        out.append(np.unique(runs[begin : max(begin, end - shingle + 1)]))
        begin = end
    return out


def signatures(sets: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """SuperMinHash of each non-empty set: (len(sets), lanes), 64-bit, the round in the upper and the rank in the lower bits."""
    sig = np.full((len(sets), lanes), np.iinfo(np.uint64).max, _U)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    el = np.concatenate(sets) if sets else np.empty(0, _U)
    order = None
    rows = np.arange(len(el))
    for j in range(lanes):
        with np.errstate(over="ignore"):
            h = mix(el + _U(((j + 1) * 0x9E3779B97F4A7C15) % 2**64))
        rank = (_U(j) << _U(40)) | (h >> _U(24))
        k = j + ((h & _U(0xFFFFFF)) * _U(lanes - j) >> _U(24)).astype(np.int64)
        if order is None:
            order = np.tile(np.arange(lanes, dtype=np.uint8 if lanes <= 256 else np.uint16), (len(el), 1))
        lane = order[rows, k]
        order[rows, k] = order[:, j]
        np.minimum.at(sig, (doc, lane), rank)
        open_docs = (sig >> _U(40)).max(axis=1) > j
        keep = open_docs[doc]
        if not keep.all():
            if not keep.any():
                break
            doc, el, order = doc[keep], el[keep], order[keep]
            rows = np.arange(len(el))
    return sig


def banding(threshold: float, lanes: int = LANES, miss: float = 0.005) -> tuple[int, int]:
    """(bands, rows): the most selective banding that misses a pair exactly at the threshold with at most `miss`."""
    for r in range(12, 1, -1):
        if (1 - threshold**r) ** (lanes // r) <= miss:
            return lanes // r, r
    return lanes // 2, 2


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix(sig[:, : bands * rows]).reshape(len(sig), bands, rows)
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), x.shape[:2])
        for i in range(rows):
            h = mix(h * _U(0xD6E8FEB86659FD93) + x[:, :, i])
    return h.view(np.int64)


def _pack(s: np.ndarray) -> bytes:
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    wide_ = np.zeros((len(b) // 6, 8), np.uint8)
    wide_[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide_.view("<u8").ravel()


def _sketch(shingle: int, bands: int, rows: int, lanes: int = LANES):
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("same", pa.binary()), ("keys", pa.list_(pa.int64())), ("elements", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):  # pieces of about a megabyte keep the work arrays small
                end, chars = at, 0
                while end < len(ids) and (chars < 1_000_000 or end == at):
                    chars += len(texts[end])
                    end += 1
                sets = element_sets(texts[at:end], shingle)
                use = [i for i, s in enumerate(sets) if len(s)]
                if use:
                    some = [sets[i] for i in use]
                    keys = band_keys(signatures(some, lanes), bands, rows)
                    packed = [_pack(s) for s in some]
                    offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[at + i] for i in use], pa.int64()),
                            pa.array([len(s) for s in some], pa.int32()),
                            pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in packed], pa.binary()),
                            pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                            pa.array(packed, pa.binary()),
                        ],
                        schema=kinds,
                    )
                at = end

    return run


def _alike(ids: np.ndarray, block: np.ndarray, lo: int, hi: int, packed: list[bytes], threshold: float) -> list[np.ndarray]:
    """(a, b, similarity) of the similar pairs of one group: all pairs, or those between blocks lo and hi."""
    sets = [_unpack(b) for b in packed]
    sizes = np.array([len(s) for s in sets], np.float32)
    if lo != hi:
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    else:
        left = right = np.arange(len(ids))
    el, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, count = np.unique(el, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # an element of one document only adds to no intersection
    doc, column = doc[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(left), len(right)), np.float32)
    spot = np.argsort(column, kind="stable")
    doc, column = doc[spot], column[spot]
    step = max(1, 8_000_000 // max(len(ids), 1))
    top = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, top, step):
        a, b = np.searchsorted(column, [c, c + step])
        x = np.zeros((len(ids), min(step, top - c)), np.float32)
        x[doc[a:b], column[a:b] - c] = 1
        both += x[left] @ x[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    i, j = np.nonzero(both.astype(np.float64) >= threshold * union.astype(np.float64) - 1e-9)
    sim = (both[i, j] / union[i, j]).astype(np.float64)
    i, j = left[i], right[j]
    keep = ids[i] < ids[j] if lo == hi else np.ones(len(i), bool)
    i, j = ids[i[keep]], ids[j[keep]]
    return [np.minimum(i, j), np.maximum(i, j), sim[keep]]


def _verify(threshold: float):
    """Reads rows sorted by group and yields the similar pairs of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        held: list[tuple] = []
        key = None

        def flush() -> None:
            if len(held) > 1:
                ids, blocks, packed = zip(*held)
                found.append(_alike(np.array(ids, np.int64), np.array(blocks), key[2], key[3], list(packed), threshold))
            held.clear()

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "similarity"])

        for batch in batches:
            for kind, group, lo, hi, block, doc, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, group, lo, hi) != key:
                    flush()
                    key = (kind, group, lo, hi)
                held.append((doc, block, packed))
            if len(found) > 1000:
                yield out()
                found = []
        flush()
        yield out()

    return run


def similar_pairs(documents: DataFrame, threshold: float = 0.8, shingle: int = 5, lanes: int = LANES, bucket: int = BUCKET, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs). classes: doc_id, rep, the smallest doc_id with the same elements. pairs: a < b, both
    representatives, with their similarity of at least `threshold`.

    Copies are collapsed before anything is compared, so a class that holds a third of all rows costs one row. Of
    buckets with the same members, in whatever bands, one is kept. Each bucket of up to `bucket` members links its
    members to its smallest one (members - 1 links, never all pairs); a document and what these buckets link to it form
    one group, in which any two members of such a bucket meet. Larger buckets are cut into blocks of about `block`
    documents that meet pair by pair, so no task sees more than two blocks. Each group is verified exactly. `lanes` sets
    the length of the signatures: more of them allow longer bands, hence fewer accidental links in a larger collection."""
    spark = documents.sparkSession
    bands, rows = banding(threshold, lanes)
    texts = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = settle(texts.mapInArrow(_sketch(shingle, bands, rows, lanes), "doc_id long, n int, same binary, keys array<long>, elements binary"))
    copied = settle(sketch.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    more = join_hot(sketch.select("same", "doc_id"), copied, "same", "copies", F.col("doc_id"))
    again = settle(more.where("doc_id <> rep").select("doc_id", "rep"))
    classes = join_small(sketch.select("doc_id"), again, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    single = join_small(sketch.select("doc_id", "keys"), again.select("doc_id"), "doc_id", "left_anti")
    keyed = single.select("doc_id", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("doc_id")).alias("all")).where("members > 1")
    buckets = settle(buckets.groupBy("low", "members", "all").agg(F.min("key").alias("key")).select("key", "low", "members"))
    if size_of(buckets) <= BROADCAST_BYTES and buckets.count() <= 2_000_000:
        linked = keyed.join(F.broadcast(buckets), "key")
    else:
        linked = join_hot(keyed, buckets, "key", "members", F.col("doc_id"))
    linked = settle(linked.select("key", "doc_id", "low", "members"))
    near = linked.where((F.col("members") <= bucket) & (F.col("doc_id") != F.col("low"))).select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    none = [F.lit(0).alias(c) for c in ("lo", "hi", "block")]
    groups = near.select(F.lit(0).alias("kind"), F.col("a").alias("grp"), *none, F.col("b").alias("doc_id")).unionByName(near.select(F.lit(0).alias("kind"), F.col("a").alias("grp"), *none, F.col("a").alias("doc_id")).distinct())
    large = linked.where(F.col("members") > bucket).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    large = large.select(F.lit(1).alias("kind"), F.col("key").alias("grp"), "doc_id", "block", F.explode(others).alias("p"))
    groups = settle(groups.unionByName(large.select("kind", "grp", "p.lo", "p.hi", "block", "doc_id")))
    key = ["kind", "grp", "lo", "hi"]
    ready = join_small(sketch.select("doc_id", "elements"), groups, "doc_id", most=2_000_000).select(*key, "block", "doc_id", "elements")
    ready = ready.repartition(wide(spark), *key).sortWithinPartitions(*key)
    pairs = ready.mapInArrow(_verify(threshold), "a long, b long, similarity double")
    pairs = settle(pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    classes = settle(classes)
    free(sketch, copied, again, buckets, linked, groups)
    return classes, pairs


def near_duplicate_pairs(documents: DataFrame, threshold: float = 0.8, shingle: int = 5, **more) -> DataFrame:
    """doc_id_a < doc_id_b, similarity: every pair of documents of at least the threshold, copies included. Classes of
    very many copies are cut into blocks of about COPIES members, which meet pair by pair, in keys of their own."""
    classes, pairs = similar_pairs(documents, threshold, shingle, **more)
    sized = settle(classes.groupBy("rep").agg(F.count("*").alias("members")).where("members > 1"))
    hot = join_hot(classes, sized, "rep", "members", F.col("doc_id")).select("rep", "doc_id", F.ceil(F.col("members") / COPIES).cast("int").alias("blocks"))
    hot = settle(hot.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = hot.select("rep", "block", every.alias("other"), F.col("doc_id").alias("p"))
    right = hot.select("rep", every.alias("block"), F.col("block").alias("other"), F.col("doc_id").alias("q"))
    inner = left.join(right, ["rep", "block", "other"]).where("p < q").select("p", "q", F.lit(1.0).alias("similarity"))

    def expanded(rows: DataFrame, end: str, name: str) -> DataFrame:
        """Each class at `end` replaced by its members, block by block; classes of one document are themselves."""
        blocks = sized.select(F.col("rep").alias(end), F.ceil(F.col("members") / COPIES).cast("int").alias("blocks"))
        marked = join_small(rows, blocks, end, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        own = hot.select(F.col("rep").alias(end), "block", F.col("doc_id").alias(name))
        return marked.join(own, [end, "block"], "left").withColumn(name, F.when(F.col("blocks").isNull(), F.col(end)).otherwise(F.col(name))).where(F.col(name).isNotNull()).drop(end, "block", "blocks")

    outer = expanded(expanded(pairs, "a", "p"), "b", "q").select("p", "q", "similarity")
    return inner.unionByName(outer).select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b"), "similarity")


def near_duplicate_groups(documents: DataFrame, threshold: float = 0.8, shingle: int = 5, **more) -> DataFrame:
    """One row per document that has elements: doc_id, group_id (smallest doc_id that a chain of similar pairs leads
    to), rep (smallest doc_id with the same elements), links (similar classes other than its own), group_size."""
    classes, pairs = similar_pairs(documents, threshold, shingle, **more)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    labels = connected_components(pairs.select("a", "b")).join(ends.withColumnRenamed("rep", "node"), "node")
    labels = settle(labels.select(F.col("node").alias("rep"), "component", "links"))
    rows = join_small(classes, labels, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("group_id"), "rep", F.coalesce("links", F.lit(0)).alias("links"))
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("group_size"))
    big = settle(sizes.where("group_size > 1"))
    return join_small(rows, big, "group_id", "left").select("doc_id", "group_id", "rep", "links", F.coalesce("group_size", F.lit(1)).alias("group_size"))
