"""Near-duplicates by SimHash fingerprints, with candidates from a pigeonring filter.

The 64 bits are four segments in a ring. If two fingerprints differ in at most t bits, then from some segment on, every chain of
l consecutive segments differs in at most l * t / 4 bits. With t = 3 the budgets are 0, 1, 2 and 3: the first segment is equal (a bucket), the
second differs in one bit at most (17 probes of the sorted bucket), the first three in two; the full distance decides.
Only distinct fingerprints are compared, and a cell of the search returns a spanning forest of the links it found, so a group of n copies
or near copies gives no more than n rows. Buckets of over max_cell fingerprints are cut into blocks, and each pair of
blocks is a cell of its own. A task sorts its cells (Spark spills them) and holds a bounded number of rows, in whole cells, at a time.

Defined cases: null and blank texts have fingerprint zero, linked like any other; a document of fewer shingle words
than size is one shingle; repeated rows stay, with the same result; a row with a null doc_id keeps its fingerprint, has a null
component_id and links nothing; a very long text is hashed whole, 16,384 shingles at a time; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import by_place, materialise, only, rows_in_blocks
from colonnade.llm.graph import components

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS


def shingle_hashes(text: str, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each of the text's word shingles, repeats included; of the whole sequence if it has fewer words; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - size + 1].tolist()
    return np.fromiter((xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def folded(hashes: np.ndarray) -> int:
    """The SimHash of these values: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[i : i + 16384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles."""
    return folded(shingle_hashes(text, size, seed))


def fingerprints(documents: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc_ids,), texts in rows_in_blocks(batches):
            fps = np.array([fingerprint(t, size, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return only(documents, "doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def forest(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Least node of each node's component, for links i-j among n nodes; labels: of links seen before."""
    labels = np.arange(n) if labels is None else labels
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(labels, high, low)
        while not np.array_equal(nxt := labels[labels], labels):
            labels = nxt
    return labels


def _pairs(starts: np.ndarray, stops: np.ndarray, block: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (row, k) with starts[row] <= k < stops[row], in blocks of about that many."""
    sizes = np.maximum(stops - starts, 0)
    total = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        base = total[row - 1] if row else 0
        upto = max(row + 1, int(np.searchsorted(total, base + block, "right")))
        part = sizes[row:upto]
        if part.sum():
            i = np.repeat(np.arange(row, upto), part)
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part) + starts[i]
        row = upto


def links_in_cells(cell: np.ndarray, rotated: np.ndarray, ids: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (id, id) of the fingerprints that lie in the same cell.

    cell: number of each row's cell; rotated: the fingerprint turned so that the bucket's segment comes first; own: the block
    that the row is from, in a cell of two blocks (rows of one block are compared in that block's own cell), -1 in cells of one.
    """
    budget = [(k + 1) * distance // SEGMENTS for k in range(SEGMENTS)]
    second = rotated >> np.uint64(BITS - 2 * WIDTH) & np.uint64(2**WIDTH - 1)
    keys = np.unique(cell, return_inverse=True)[1].astype(np.uint64) << np.uint64(WIDTH) | second
    order = np.argsort(keys, kind="stable")
    keys, rotated, ids, own = keys[order], rotated[order], ids[order], own[order]
    labels = np.arange(len(keys))
    masks = [0] if budget[1] == 0 else [0, *(1 << b for b in range(WIDTH))]
    if budget[1] > 1 or budget[0] > 0:
        raise ValueError("distance is at most 3")
    for mask in masks:
        probe = keys ^ np.uint64(mask)
        for i, j in _pairs(np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")):
            keep = (i < j) & ((own[i] < 0) | (own[i] != own[j]))
            i, j = i[keep], j[keep]
            x = rotated[i] ^ rotated[j]
            near = np.bitwise_count(x >> np.uint64(BITS - 3 * WIDTH)) <= budget[2]
            near &= np.bitwise_count(x) <= budget[3]
            labels = forest(len(keys), i[near], j[near], labels)
    linked = np.flatnonzero(labels != np.arange(len(keys)))
    return ids[linked], ids[labels[linked]]


def whole_cells(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[pa.Table]:
    """Batches sorted by cell, as tables of whole cells: about that many rows each, and one cell more at most."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n + batch.num_rows > rows and held:
            keys = np.stack([np.concatenate([held[-1].column(c).to_numpy()[-1:], batch.column(c).to_numpy()]) for c in names])
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            if len(turns):
                cut = int(turns[-1])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def near_links(distinct: DataFrame, distance: int = 3, max_cell: int = 20_000) -> DataFrame:
    """Links (u, v) that connect what lies within distance, for rows (fp long, id long) with distinct fp.

    Not every pair within distance: a spanning forest of those in each cell, so that all that are linked stay connected.
    """
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    turned = [F.col("fp") if k == 0 else F.shiftleft("fp", WIDTH * k).bitwiseOR(F.shiftrightunsigned("fp", BITS - WIDTH * k)) for k in range(SEGMENTS)]
    rows = distinct.select("id", F.posexplode(F.array(*turned)).alias("k", "rotated"))
    rows = rows.select("id", "rotated", (F.col("k") * 2**WIDTH + F.shiftrightunsigned("rotated", BITS - WIDTH).cast("int")).alias("bucket"))
    large = rows.groupBy("bucket").count().where(F.col("count") > max_cell).select("bucket", F.ceil(F.col("count") / max_cell).cast("int").alias("blocks"))
    rows = rows.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(0))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("bucket", low.alias("a"), high.alias("b"), F.when(low == high, -1).otherwise(F.col("own")).alias("own"), "rotated", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_cells(batches, ["bucket", "a", "b"], 10 * max_cell):
            c = {n: held.column(n).to_numpy() for n in held.column_names}
            cells = np.cumsum(np.concatenate([[0], (np.diff(np.stack([c["bucket"], c["a"], c["b"]])) != 0).any(axis=0)]))
            u, v = links_in_cells(cells, c["rotated"].view(np.uint64), c["id"], c["own"], distance)
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.repartition(n, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(work, "u long, v long")


def simhash_duplicates(documents: DataFrame, distance: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links of at most distance bits)."""
    of_docs = materialise(fingerprints(documents, size, seed), "fingerprints")
    distinct = of_docs.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    distinct = materialise(distinct, "distinct-fingerprints")
    found = components(near_links(distinct, distance)).withColumnRenamed("node", "id")
    classes = distinct.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    out = of_docs.join(classes, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def dedup(documents: DataFrame, distance: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """The documents with all their columns: of each group the rows with the least doc_id, and rows with a null doc_id."""
    classes = simhash_duplicates(documents, distance, size, seed)
    gone = classes.where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    plain, at = by_place(documents)
    return plain.join(gone, plain[at["doc_id"]] == gone["gone_id"], "left_anti").toDF(*documents.columns)
