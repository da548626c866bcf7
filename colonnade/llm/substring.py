"""Substring dedup against a log-structured index of window fingerprints.

A window is 13 consecutive words of a document. The index holds, in sorted immutable runs, the fingerprint of every window seen
and the least doc_id that it starts in. Documents come in batches of ascending doc_id. Each batch is dealt into blocks; a block sorts
its own windows and sends each distinct one once, with its least doc_id there, packed, to the bucket of its hash range. The
bucket merge-joins what has come with its part of the runs, verifies a match of hashes by a second hash, writes what is new as its part of a new
run, and answers each block with the windows that start in a smaller doc_id elsewhere. Runs of a level are compacted into one
of the next as soon as there are fan_in of them. Last, the blocks mark the words that such windows cover.
A window found in a third of all documents is one entry for each block, not for each document.

A fingerprint is 64 bits of one hash and, to verify a match of those, 32 of another, both over the 64-bit hashes of the words: two
different windows are taken for one with a chance of 2^-96 a pair (at 10^13 windows, 6e-4 for the whole corpus).

Defined cases: null and blank texts have no words, and a text of under 13 words no window: they stay whole. Rows of one doc_id never mark
each other. A row with a null doc_id stays whole and marks nothing. A very long text is a block of its own at worst. An empty table gives no rows.
Other columns, whatever their names, are ignored by report, and kept by dedup. Blocks and buckets are sized by bytes of text, not by the
number of shuffle partitions; documents at or below an index's greatest doc_id are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import WORD_PATTERN, _shuffle_cleanup, by_place, drop, new_path, only

WINDOW = 13
_ODD = np.random.default_rng(13).integers(0, 2**63, (2, 64), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Main (64 bits) and second hash (32 bits) of each window of the words."""
    from xxhash import xxh3_64_intdigest

    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    main, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(window):
        part = h[k : k + n]
        main += part * _ODD[0, k]
        second += part * _ODD[1, k]
    main ^= main >> np.uint64(31)
    main *= np.uint64(0xBF58476D1CE4E5B9)
    main ^= main >> np.uint64(29)
    return main, (second >> np.uint64(32)).astype(np.uint32)


def first_of_each(main: np.ndarray, second: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, each with its least document."""
    order = np.argsort(main, kind="stable")
    main, second, docs = main[order], second[order], docs[order]
    if len(main) > 1 and ((main[1:] == main[:-1]) & (second[1:] != second[:-1])).any():
        order = np.lexsort((second, main))
        main, second, docs = main[order], second[order], docs[order]
    new = np.ones(len(main), bool)
    new[1:] = (main[1:] != main[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    return main[at], second[at], np.minimum.reduceat(docs, at) if len(at) else docs


def find(main: np.ndarray, second: np.ndarray, in_main: np.ndarray, in_second: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in a sorted list of distinct ones, -1 where it is not there."""
    at = np.searchsorted(in_main, main, "left")
    out = np.full(len(main), -1, np.int64)
    left = np.arange(len(main))
    while len(left):
        k = at[left]
        left = left[k < len(in_main)]
        k = at[left]
        same = in_main[k] == main[left]
        left, k = left[same], k[same]
        hit = in_second[k] == second[left]
        out[left[hit]] = k[hit]
        left = left[~hit]
        at[left] += 1
    return out


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unplanes(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


#: Bytes of text that a block has about, and whose windows a bucket gets from each batch.
BLOCK_BYTES = 24_000_000
PACKED = "n int, main binary, second binary, docs binary"
_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def pack(main: np.ndarray, second: np.ndarray, docs: np.ndarray) -> tuple:
    """Sorted fingerprints as differences, byte by byte."""
    return len(main), _planes(np.diff(main, prepend=np.uint64(0))), _planes(second), _planes(docs.astype(np.int64))


def unpack(n: int, main: bytes, second: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_unplanes(main, n, np.uint64), dtype=np.uint64), _unplanes(second, n, np.uint32), _unplanes(docs, n, np.int64)


@cache
def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _read_run(path: str, bucket: int) -> list[tuple]:
    """Packed parts of a bucket in a run."""
    fs, root = _fs(path)
    folder = f"{root}/kind=run/bucket={bucket}"
    if fs.get_file_info(folder).type == pafs.FileType.NotFound:
        return []
    out = []
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        if info.base_name.endswith(".parquet"):
            t = pq.ParquetFile(fs.open_input_file(info.path)).read(columns=["n", "main", "second", "docs"])
            out += zip(*(t.column(c).to_pylist() for c in ("n", "main", "second", "docs")))
    return out


class WindowIndex:
    """Runs of window fingerprints in the shared folder, by level. buckets is fixed when the index is made."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, window: int = WINDOW, fan_in: int = 2):
        self.spark, self.folder, self.buckets, self.window, self.fan_in = spark, folder, buckets, window, fan_in
        self.levels: list[list[str]] = [[]]
        self.made = 0
        self.greatest: int | None = None

    def state(self) -> dict:
        """What a later session needs to open the index again."""
        return {k: getattr(self, k) for k in ("folder", "buckets", "window", "fan_in", "levels", "made", "greatest")}

    @staticmethod
    def restore(spark: SparkSession, state: dict) -> WindowIndex:
        out = WindowIndex(spark, state["folder"], state["buckets"], state["window"], state["fan_in"])
        out.levels, out.made, out.greatest = [list(x) for x in state["levels"]], state["made"], state["greatest"]
        return out

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _new(self, what: str) -> str:
        self.made += 1
        return f"{self.folder}/{what}-{self.made:04d}"

    def add(self, blocks: DataFrame, low: int | None, high: int | None, parts: int) -> str:
        """Takes a batch (block long, doc_id long, text) with doc_ids from low to high; returns the path of run and answers.

        parts: tasks that the batch's blocks are dealt to. low must be above all earlier batches.
        """
        if low is not None and self.greatest is not None and low <= self.greatest:
            raise ValueError(f"doc_id {low} is not above the index's greatest, {self.greatest}")
        self.greatest = self.greatest if high is None else high
        window, buckets, runs, path = self.window, self.buckets, self.runs(), self._new("run")

        def send(t: pa.Table) -> pa.Table:
            block = t.column("block")[0].as_py()
            each = [(window_hashes((x or "").encode().split(), window), d) for x, d in zip(t.column("text").to_pylist(), t.column("doc_id").to_pylist())]
            docs = np.repeat(np.array([d for _, d in each], np.int64), [len(h[0]) for h, _ in each])
            main, second, docs = first_of_each(np.concatenate([h[0] for h, _ in each]), np.concatenate([h[1] for h, _ in each]), docs)
            cuts = np.searchsorted((main >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
            rows = [(b, block, *pack(main[s:e], second[s:e], docs[s:e])) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
            columns = list(zip(*rows)) if rows else [()] * 6
            return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int64(), *_TYPES])], names=["bucket", "block", "n", "main", "second", "docs"])

        def merge(t: pa.Table) -> pa.Table:
            bucket = t.column("bucket")[0].as_py()
            sent = [unpack(*r) for r in zip(*(t.column(c).to_pylist() for c in ("n", "main", "second", "docs")))]
            main, second, docs = (np.concatenate([s[i] for s in sent]) for i in range(3))
            d_main, d_second, d_first = first_of_each(main, second, docs)
            is_new = np.ones(len(d_main), bool)
            for run in runs:
                for part in _read_run(run, bucket):
                    r_main, r_second, r_docs = unpack(*part)
                    at = find(d_main, d_second, r_main, r_second)
                    hit = at >= 0
                    d_first[hit] = np.minimum(d_first[hit], r_docs[at[hit]])
                    is_new &= ~hit
            rows = [("run", bucket, -1, *pack(d_main[is_new], d_second[is_new], d_first[is_new]))]
            place = find(main, second, d_main, d_second)
            again = d_first[place] < docs
            start = 0
            for block, s in zip(t.column("block").to_pylist(), sent):
                k = start + np.flatnonzero(again[start : start + len(s[0])])
                start += len(s[0])
                if len(k):
                    rows.append(("answer", bucket, block, *pack(main[k], second[k], docs[k][:0])))
            return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), [pa.string(), pa.int32(), pa.int64(), *_TYPES])], names=["kind", "bucket", "block", "n", "main", "second", "docs"])

        sent = blocks.repartition(parts, "block").groupBy("block").applyInArrow(send, f"bucket int, block long, {PACKED}")
        merged = sent.repartition(max(parts, buckets), "bucket").groupBy("bucket").applyInArrow(merge, f"kind string, bucket int, block long, {PACKED}")
        with _shuffle_cleanup(self.spark):
            merged.write.partitionBy("kind", "bucket").parquet(path)
        self.levels[0].append(path)
        return path

    def compact(self) -> None:
        """Merges the runs of each level that has fan_in of them into one of the next level."""
        for k in range(64):
            if k >= len(self.levels) or len(self.levels[k]) < self.fan_in:
                continue
            old, path = self.levels[k], self._new("level")

            def merge(batches, old=old):
                for batch in batches:
                    for bucket in batch.column(0).to_pylist():
                        parts = [unpack(*p) for run in old for p in _read_run(run, bucket)]
                        if parts:
                            row = ("run", bucket, -1, *pack(*first_of_each(*(np.concatenate([p[i] for p in parts]) for i in range(3)))))
                            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, [pa.string(), pa.int32(), pa.int64(), *_TYPES])], names=["kind", "bucket", "block", "n", "main", "second", "docs"])

            buckets = self.spark.range(0, self.buckets, 1, max(1, min(self.buckets, 4 * self.spark.sparkContext.defaultParallelism)))
            buckets.mapInArrow(merge, f"kind string, bucket int, block long, {PACKED}").write.partitionBy("kind", "bucket").parquet(path)
            self.levels[k] = []
            if len(self.levels) == k + 1:
                self.levels.append([])
            self.levels[k + 1].append(path)
            for run in old:
                drop(f"{run}/kind=run", self.spark)

    def remove(self) -> None:
        for run in self.runs():
            drop(f"{run}/kind=run", self.spark)


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in the windows with these starts."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def cut(text: str, gone: np.ndarray) -> str:
    """The text without those words and without the white space after them; what stays keeps its own white space."""
    out, start = [], 0
    spans = [m.span() for m in re.finditer(WORD_PATTERN, text)]
    for k, (s, _) in enumerate(spans):
        if gone[k]:
            out.append(text[start:s])
            start = spans[k + 1][0] if k + 1 < len(spans) else len(text)
    return "".join([*out, text[start:]])


def _marked(documents: DataFrame, given: list[str], made: str, result: Callable, batches: int, window: int, index: WindowIndex | None) -> DataFrame:
    """Runs the batches through an index, then result(text, words, gone) in the blocks; rows of given columns, then made.

    An index that is given is kept, with these documents added; its window counts. Else one is made and removed.
    """
    spark = documents.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / batches for k in range(1, batches)]
    facts = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.octet_length("text")).alias("bytes")]
    facts += [F.percentile_approx("doc_id", shares, 1000).alias("cuts")] if shares else []
    facts = documents.agg(*facts).first()
    low, high = facts["low"], facts["high"]
    cuts = sorted(set(facts["cuts"] or []) - {high}) if shares else []
    n = max(n, -(-(facts["bytes"] or 0) // (BLOCK_BYTES * (len(cuts) + 1))))
    batch = sum((F.when(F.col("doc_id") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(facts["bytes"] or 0) // BLOCK_BYTES))
    # rows of one doc_id are told apart by their texts; rows without a doc_id take no part in the index, and any block will do for them
    number = lambda spread: batch.cast("long") * n + F.pmod(spread, F.lit(n))
    blocks = documents.withColumn("block", number(F.xxhash64("doc_id", "text")))
    every = documents.withColumn("block", F.when(F.col("doc_id").isNull(), number(F.xxhash64(F.monotonically_increasing_id()))).otherwise(number(F.xxhash64("doc_id", "text"))))
    keep, answers = index is not None, []
    index = index or WindowIndex(spark, new_path(spark, "windows"), n, window)
    window = index.window
    edges = [low, *(c + 1 for c in cuts)], [*cuts, high]
    for k, (first, last) in enumerate(zip(*edges)):
        within = blocks.where("doc_id is not null")
        within = within.where(F.col("doc_id") >= F.lit(first)) if k else within
        within = within.where(F.col("doc_id") <= F.lit(last)) if k < len(cuts) else within
        answers.append(index.add(within.select("block", "doc_id", "text"), first, last, n))
        if keep or k < len(cuts):
            index.compact()
    if not keep:
        index.remove()
    schema = f"bucket int, block long, {PACKED}, kind string"
    told = None
    for path in answers:
        one = spark.read.schema(schema).option("basePath", path).parquet(path).where("kind = 'answer'").select("block", "n", "main", "second")
        told = one if told is None else told.union(one)

    order = ["block", "doc_id", "text", *given]
    final = every.select("block", "doc_id", "text", *(F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(given)))
    kinds = [final.schema[f"g{i}"].dataType.simpleString() for i in range(len(given))]

    def mark(t: pa.Table, a: pa.Table) -> pa.Table:
        texts, docs = t.column("text").to_pylist(), t.column("doc_id").to_pylist()
        each = [(x or "").encode().split() for x in texts]
        hashes = [window_hashes(w, window) if d is not None else window_hashes([], window) for w, d in zip(each, docs)]
        of = np.repeat(np.array([d or 0 for d in docs], np.int64), [len(h[0]) for h in hashes])
        main, second = (np.concatenate([h[i] for h in hashes]) if hashes else np.empty(0, (np.uint64, np.uint32)[i]) for i in range(2))
        d_main, d_second, d_first = first_of_each(main, second, of)
        told = [(np.cumsum(_unplanes(m, n, np.uint64), dtype=np.uint64), _unplanes(s, n, np.uint32)) for n, m, s in zip(*(a.column(c).to_pylist() for c in ("n", "main", "second")))]
        if told:
            at = find(np.concatenate([x[0] for x in told]), np.concatenate([x[1] for x in told]), d_main, d_second)
            d_first[at[at >= 0]] = np.iinfo(np.int64).min
        again = d_first[find(main, second, d_main, d_second)] < of
        rows, start = [], 0
        for text, words, h in zip(texts, each, hashes):
            gone = covered(np.flatnonzero(again[start : start + len(h[0])]), len(words), window)
            start += len(h[0])
            rows.append(result(text, words, gone))
        out = [t.column(f"g{i}") for i in range(len(given))]
        types = {"long": pa.int64(), "string": pa.string()}
        fields = [f.split() for f in made.split(", ")]
        out += [pa.array([r[i] for r in rows], types[f[1]]) for i, f in enumerate(fields)]
        return pa.table(out, names=[f"g{i}" for i in range(len(given))] + [f[0] for f in fields])

    schema = ", ".join([f"g{i} {k}" for i, k in enumerate(kinds)] + [made])
    return final.repartition(parts, "block").groupBy("block").cogroup(told.repartition(parts, "block").groupBy("block")).applyInArrow(mark, schema)


def _digest(text, words: list[bytes], gone: np.ndarray) -> tuple:
    kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def report(documents: DataFrame, window: int = WINDOW, batches: int = 4, index: WindowIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of each document (doc_id, text).

    With an index of earlier documents, all of lower doc_id, their windows count too, and these documents' are added.
    """
    out = _marked(only(documents, "doc_id", "text"), ["doc_id"], "n_words long, n_removed long, kept_sha256 string", _digest, batches, window, index)
    return out.withColumnRenamed("g0", "doc_id")


def _cut(text, words: list[bytes], gone: np.ndarray) -> tuple:
    return (cut(text, gone) if gone.any() else text,)


def dedup(documents: DataFrame, window: int = WINDOW, batches: int = 4, index: WindowIndex | None = None) -> DataFrame:
    """The documents with all their columns; text loses the words that the report counts, and n_chars, where there is one, is set anew."""
    names, (plain, at) = documents.columns, by_place(documents)
    rest = [c for c in plain.columns if c != at["text"]]
    inner = plain.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), *rest)
    out = _marked(inner, rest, "kept string", _cut, batches, window, index)
    columns = {c: F.col(f"g{i}") for i, c in enumerate(rest)} | {at["text"]: F.col("kept")}
    if "n_chars" in at:
        columns[at["n_chars"]] = F.length("kept").cast(plain.schema[at["n_chars"]].dataType)
    return out.select(*(columns[c].alias(c) for c in plain.columns)).toDF(*names)


REPORT_SQL = r"""
with texts as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from texts where len(w) >= 13),
windows as (select r, doc_id, i, min(doc_id) over (partition by array_to_string(list_slice(w, i, i + 12), ' ')) as first from starts),
gone as (select distinct r, i + k as i from windows, range(13) as s(k) where first < doc_id),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from texts),
kept as (select r, count(*) as n, string_agg(word, ' ' order by i) as t from words anti join gone using (r, i) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from texts left join kept using (r)
"""
