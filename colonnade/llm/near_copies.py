"""Near copies by word shingles: SimHash candidates widened by MinHash bands, each decided by the exact Jaccard similarity of the shingle sets.

A text's set holds the XXH64 of its runs of size words, ASCII letters lowered and white space as one space. Candidates are all pairs whose SimHash
fingerprints the pigeonring filter finds within DISTANCE bits, and, as most pairs at a similarity of 0.8 differ in more bits than it can prune, those
that share one of BANDS bands of ROWS minima each: at 0.8 a pair shares none with probability (1 - 0.8^6)^24 = 7e-4, at 0.85 with 8e-6; nothing else
is lost, and no pair below the threshold is linked. Candidates' texts are put in clusters, so that a text travels once, and a cluster returns a spanning forest of
the links it found: pairs that are connected already are not compared. Clusters of over max_cell texts or max_bytes of text are cut
into blocks, and each pair of blocks is a cell of its own: no cell holds more than two blocks.

Defined cases: texts that are equal after lowering and white space are one node, known by 64 bits of XXH64; null and blank texts equal each other; a
text of fewer words than size is one shingle; rows with null or repeated doc_ids are grouped by their texts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm import simhash
from colonnade.llm.common import by_place, drop, materialise, only, rows_in_blocks
from colonnade.llm.graph import components
from colonnade.llm.simhash import folded, forest, shingle_hashes

BANDS, ROWS, DISTANCE = 24, 6, 3


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def key_of(text: str) -> int:
    """The same for texts that are equal after lowering ASCII letters and white space, as a signed long."""
    from xxhash import xxh64_intdigest

    key = xxh64_intdigest(b" ".join(_words(text)), 77)
    return key - (1 << 64) if key >> 63 else key


def shingle_set(text: str, size: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 values of the text's word shingles."""
    return np.unique(shingle_hashes(text, size, seed))


def _turns(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, 2**32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def bands_of(shingles: np.ndarray, turns: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """One long for each band of minima; none of an empty set."""
    from xxhash import xxh64_intdigest

    if not len(shingles):
        return []
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(least, (low[i : i + 1024] * turns[0] + turns[1]).min(axis=1), out=least)
    data = least.tobytes()
    width = len(data) // BANDS
    return np.array([xxh64_intdigest(data[b * width : (b + 1) * width], b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def signatures(documents: DataFrame, size: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, key, fp (the SimHash as a long, null without words), bands of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _turns(seed)
        for (doc_ids,), texts in rows_in_blocks(batches):
            fps, bands = [], []
            for t in texts:
                hashes = shingle_hashes(t, size, seed)
                fps.append(folded(hashes) if len(hashes) else None)
                bands.append(bands_of(np.unique(hashes), turns))
            keys = pa.array([key_of(t) for t in texts], pa.int64())
            columns = [pa.array(doc_ids, pa.int64()), keys, pa.array(fps, pa.uint64()).view(pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "key", "fp", "bands"])

    return only(documents, "doc_id", "text").mapInArrow(work, "doc_id long, key long, fp long, bands array<long>")


def keyed_texts(documents: DataFrame) -> DataFrame:
    """key, text of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in rows_in_blocks(batches):
            yield pa.record_batch([pa.array([key_of(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])

    return only(documents, "text").mapInArrow(work, "key long, text string")


def similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of one set with each of the others."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    shared = np.add.reduceat(one[at] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
    return shared / (len(one) + sizes - shared)


def links_in_cell(fps: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], own: np.ndarray, threshold: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (place, place) of the sets that are candidates, by fingerprint or band, and reach the threshold.

    own: the block that each is from, in a cell of two blocks (those of one block are compared in that block's own cell), -1 in cells of one.
    """
    n = len(sets)
    labels, sizes = np.arange(n), np.array([len(s) for s in sets])
    for p in range(n - 1):
        rest = np.arange(p + 1, n)
        rest = rest[(labels[p + 1 :] != labels[p]) & ((own[p] < 0) | (own[p + 1 :] != own[p]))]
        if len(rest):
            rest = rest[np.minimum(sizes[rest], sizes[p]) >= (threshold - 1e-9) * np.maximum(sizes[rest], sizes[p])]
            rest = rest[(bands[rest] == bands[p]).any(axis=1) | (np.bitwise_count(fps[rest] ^ fps[p]) <= DISTANCE)]
        for a in range(0, len(rest), step):
            some = rest[a : a + step]
            near = some[similar(sets[p], [sets[i] for i in some]) >= threshold]
            labels = forest(n, np.full(len(near), p), near, labels)
    linked = np.flatnonzero(labels != np.arange(n))
    return linked, labels[linked]


def cells_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each cell, of batches that are sorted by cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in names])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            now = tuple(keys[:, s].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def near_links(documents: DataFrame, signed: DataFrame, threshold: float = 0.8, size: int = 5, seed: int = 42, max_cell: int = 10_000, max_bytes: int = 30_000_000) -> DataFrame:
    """Links (u, v) of keys, in the shared folder, that connect all candidates which reach the threshold; signed: the documents' signatures."""
    n = max(1, int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = signed.groupBy("key").agg(F.first("bands").alias("bands")).select("key", F.explode("bands").alias("bucket"))
    rows = materialise(rows, "bands")
    prints = signed.where("fp is not null").groupBy("key").agg(F.first("fp").alias("fp"))
    distinct = materialise(prints.groupBy("fp").agg(F.min("key").alias("id")), "distinct-fingerprints")
    by_print = prints.join(distinct, "fp").where("key != id").select(F.col("key").alias("u"), F.col("id").alias("v")).union(simhash.near_links(distinct, DISTANCE))
    hubs = rows.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("size")).where("size > 1")
    clusters = components(rows.join(hubs, "bucket").where("key != hub").select(F.col("key").alias("u"), F.col("hub").alias("v")).union(by_print))
    drop(rows)
    drop(distinct)
    texts = keyed_texts(documents).join(clusters, F.col("key") == F.col("node"))
    texts = materialise(texts.groupBy("key").agg(F.first("component").alias("cluster"), F.first("text").alias("text")), "candidates")
    blocks = F.ceil(F.greatest(F.count("*") / max_cell, F.sum(F.octet_length("text")) / max_bytes)).cast("int")
    large = texts.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1")
    cells = texts.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).otherwise(0))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cells = cells.select("cluster", low.alias("a"), high.alias("b"), F.when(low == high, -1).otherwise(F.col("own")).alias("own"), "key", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _turns(seed)
        for t in cells_of(batches, ["cluster", "a", "b"]):
            keys = t.column("key").to_numpy()
            order = np.argsort(keys, kind="stable")
            fps, sets = np.empty(len(keys), np.uint64), []
            for i, x in enumerate(t.column("text").take(order).to_pylist()):
                hashes = shingle_hashes(x, size, seed)
                fps[i] = folded(hashes)
                sets.append(np.unique(hashes))
            u, v = links_in_cell(fps, np.array([bands_of(x, turns) for x in sets]), sets, t.column("own").to_numpy()[order], threshold)
            if len(u):
                yield pa.record_batch([pa.array(keys[order][u]), pa.array(keys[order][v])], names=["u", "v"])

    links = materialise(cells.repartition(n, "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b").mapInArrow(work, "u long, v long"), "near-links")
    drop(texts)
    return links


def classes(documents: DataFrame, signed: DataFrame, threshold: float = 0.8, size: int = 5, seed: int = 42, **cells) -> DataFrame:
    """key, component, keep (the least doc_id of the component, null if none has one) of each distinct text."""
    found = components(near_links(documents, signed, threshold, size, seed, **cells)).select(F.col("node").alias("key"), "component")
    of_keys = signed.groupBy("key").agg(F.min("doc_id").alias("id")).join(found, "key", "left").select("key", "id", F.coalesce("component", "key").alias("component"))
    of_keys = materialise(of_keys, "texts")
    return of_keys.join(of_keys.groupBy("component").agg(F.min("id").alias("keep")), "component").select("key", "component", "keep")


def dedup(documents: DataFrame, threshold: float = 0.8, size: int = 5, seed: int = 42, **cells) -> DataFrame:
    """One row of each group, with all its columns: one with the least doc_id, or any where no row of the group has a doc_id.

    Rows whose doc_id is null or repeated are told apart by their text; of those that agree in both, the one with the least n_chars, lang and source
    (where documents has them) stays.
    """
    signed = materialise(signatures(documents, size, seed), "signatures")
    of_keys = materialise(classes(documents, signed, threshold, size, seed, **cells), "classes")
    names, (documents, at) = documents.columns, by_place(documents)
    ids = documents[at["doc_id"]]
    odd = signed.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("odd_id"))
    odd = materialise(odd, "repeated-ids")
    gone = signed.select("doc_id", "key").join(of_keys, "key").where("keep < doc_id").select(F.col("doc_id").alias("gone_id"))
    plain = documents.where(ids.isNotNull()).join(gone.union(odd).distinct(), ids == F.col("gone_id"), "left_anti")
    if odd.isEmpty():
        return plain.toDF(*names)
    rows = documents.join(odd, ids.eqNullSafe(odd["odd_id"]), "left_semi")
    schema = T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())])
    place = rows.columns.index(at["text"])

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([key_of(t or "") for t in b.column(place).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], names=schema.names)

    keyed = rows.mapInArrow(with_key, schema)
    order = F.struct(*(F.col(at[c]) for c in ("text", "n_chars", "lang", "source") if c in at))
    keyed = keyed.select("key", F.col(at["doc_id"]).alias("id"), F.struct(*rows.columns).alias("row"), order.alias("order"))
    keyed = keyed.join(of_keys, "key").where("keep is null or id = keep")
    one = keyed.groupBy("component").agg(F.min_by("row", "order").alias("row"))
    return plain.unionByName(one.select("row.*")).toDF(*names)
