"""Scores of documents by a log-bilinear model, trained in numpy with noise-contrastive estimation.

Tokens are the lower-cased words of a text and one end. All counts are over all training documents: blocks of documents send each distinct
word, and each distinct pair of neighbouring tokens, once, by hash, to the bucket of its range; buckets sum and answer in the order they were asked.
What is gathered so grows with the corpus.

The model gives token w after token c the score r_c . q_w + b_w + d_cw. The first part is over symbols: the end, the head words (the most frequent),
and tail classes (a hash of a word's last bytes). Training maximises the noise-contrastive objective with the unigram distribution as
noise: counts of all pairs of symbols in the training documents stand for the data, and the expectation over the noise is taken in full,
in blocks of matrix products. Scoring normalises each context by a product over all symbols, and a tail word takes its class's probability times
(count + 0.1) / (count of the class + 0.1 (words of the class + 1)); call what comes of it p0(w | c). The second part is a weight of each pair of words
that occurs, trained against p0 as the noise with `prior` observations drawn from p0 beside the data of each context. A free weight has its
noise-contrastive optimum in closed form, log((n_cw + prior p0) / ((n_c + prior) p0)), which is taken instead of steps towards it; with n_cw = 0 for
pairs that do not occur the model is normalised: p(w | c) = p0 exp(d_cw) sums to one over all words.

Hashes are 64 bits: two words, or two pairs, are taken for one with a chance of 2^-64 a pair. Counts are 64 bits. Blocks are sized by bytes of text.
Defined cases: null and blank texts are one end; a null doc_id hashes as an empty text (held out); repeated rows each count; a very long text is
a block of its own at worst; a corpus without training documents gives every token a count of 0 and the model's uniform start; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import _shuffle_cleanup, drop, materialise, new_path, only, rows_in_blocks

END = np.uint64(0)  # in place of a word's hash
#: Bytes of text that a block has about, and that a bucket answers for: messages between them number their product at most, whatever the partitions.
BLOCK_BYTES, BUCKET_BYTES = 6_000_000, 24_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    h[h == END] = np.uint64(1)
    return h


def tail_class(words: list[bytes], classes: int) -> np.ndarray:
    """A class for each word, from its last three bytes."""
    return np.fromiter((zlib.crc32(w[-3:]) for w in words), np.uint32, len(words)).astype(np.int64) % classes


def is_training(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def tokens(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts in a row, and how many each text has."""
    each = [t.encode().lower().split() for t in texts]
    return [w for ws in each for w in ws], np.array([len(ws) for ws in each], np.int64)


class Symbols:
    """Numbers of the model's symbols: 0 is the end, then the tail classes, then the head words."""

    def __init__(self, head: np.ndarray, classes: int):
        self.keys = np.sort(np.asarray(head, np.uint64))
        self.classes, self.size = classes, 1 + classes + len(head)

    def of(self, hashes: np.ndarray, class_of: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return 1 + class_of
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, 1 + self.classes + at, 1 + class_of)


def train(pairs: np.ndarray, dim: int = 32, noise: float = 10.0, steps: int = 120, rate: float = 0.05, seed: int = 11, block: int = 512) -> dict[str, np.ndarray]:
    """r, q, b from the counts of pairs (context, symbol)."""
    rng = np.random.default_rng(seed)
    n = len(pairs)
    total = max(float(pairs.sum()), 1.0)
    unigram = ((pairs.sum(axis=0) + 0.1) / (pairs.sum() + 0.1 * n)).astype(np.float32)
    contexts = pairs.sum(axis=1).astype(np.float32)
    shift = np.log(noise * unigram)
    p = {"r": rng.normal(0, 0.1, (n, dim)).astype(np.float32), "q": rng.normal(0, 0.1, (n, dim)).astype(np.float32), "b": np.log(unigram)}
    # a context seen often would drown the others: each is weighted by the root of its count
    weight = 1 / np.sqrt(np.maximum(contexts, 1))
    weight *= total / max(float((contexts * weight).sum()), 1e-9)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        g = {k: np.zeros_like(x) for k, x in p.items()}
        for a in range(0, n, block):
            r = p["r"][a : a + block]
            delta = r @ p["q"].T + p["b"] - shift
            data = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
            up = pairs[a : a + block] * (1 - data) - noise * contexts[a : a + block, None] * unigram * data
            up *= (weight[a : a + block] / total)[:, None]
            g["r"][a : a + block] = up @ p["q"]
            g["q"] += up.T @ r
            g["b"] += up.sum(axis=0)
        for k in p:
            grad = g[k] * n - (1e-4 * p[k] if k != "b" else 0)
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            p[k] = (p[k] + rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def log10_table(p: dict[str, np.ndarray], block: int = 512) -> np.ndarray:
    """log10 probability of each symbol after each context, normalised."""
    out = np.empty((len(p["r"]), len(p["q"])), np.float32)
    for a in range(0, len(out), block):
        s = (p["r"][a : a + block] @ p["q"].T + p["b"]).astype(np.float64)
        s -= s.max(axis=1, keepdims=True)
        out[a : a + block] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)
    return out


_TABLES: dict[str, np.ndarray] = {}


def _table(key: str, model: dict) -> np.ndarray:
    """The model's table, made once in each worker."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = log10_table(model["p"])
    return _TABLES[key]


def pair_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """64 bits of each pair of token hashes."""
    h = before * _ODD[0] + (tokens ^ (tokens >> np.uint64(32))) * _ODD[1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Block:
    """Of a block of texts: distinct words and distinct pairs in order, the place of each token in them, and their counts in training texts."""

    def __init__(self, texts: list[str], docs: list, classes: int):
        words, self.sizes = tokens(texts)
        h = word_hashes(words)
        self.keys, first, self.place = np.unique(h, return_index=True, return_inverse=True)
        self.class_of = tail_class([words[i] for i in first.tolist()], classes)
        self.training = np.array([is_training(d) for d in docs], bool)
        self.counts = np.bincount(self.place, np.repeat(self.training, self.sizes), len(self.keys)).astype(np.int64)
        #: The texts with their ends, in a row: where the words stand in it, and where each text begins.
        self.at = np.arange(len(h)) + np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.stops = np.cumsum(self.sizes + 1)
        self.starts = self.stops - self.sizes - 1
        line = self.line(h, END)
        self.pairs, self.pair_place = np.unique(pair_hashes(self.shifted(line), line), return_inverse=True)
        self.pair_counts = np.bincount(self.pair_place, np.repeat(self.training, self.sizes + 1), len(self.pairs)).astype(np.int64)

    def line(self, of_words: np.ndarray, of_end) -> np.ndarray:
        """Values of all tokens in a row, from those of the words and that of the end."""
        out = np.full(len(of_words) + len(self.sizes), of_end, of_words.dtype)
        out[self.at] = of_words
        return out

    @staticmethod
    def shifted(line: np.ndarray) -> np.ndarray:
        """The value of the token before; before a text stands the end of another, or nothing, which counts as an end."""
        return np.concatenate([line[-1:], line[:-1]])


def packed(x: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, compressed."""
    x = np.ascontiguousarray(x)
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.empty(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


def _cuts(keys: np.ndarray, buckets: int) -> list[int]:
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1)).tolist()


def summed(asked: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, where each is first asked, their sums, and the sums in the order that each block asked."""
    keys, first, place = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, np.concatenate(counts).astype(np.int64))
    return keys, first, sums, np.split(sums[place], np.cumsum([len(x) for x in asked])[:-1])


def _summary(keys, counts, class_of, words, distinct, head_words: int) -> bytes:
    """The most frequent keys with counts and classes, and of each class its words and distinct words."""
    best = np.lexsort((keys, -counts))[:head_words]
    best = best[counts[best] > 0]
    return b"".join(x.tobytes() for x in (keys[best].astype(np.uint64), counts[best].astype(np.int64), class_of[best].astype(np.int64), words.astype(np.int64), distinct.astype(np.int64)))


def _parsed(data: bytes, classes: int) -> list[np.ndarray]:
    x = np.frombuffer(data, np.int64)
    n = (len(x) - 2 * classes) // 3
    return [x[:n].view(np.uint64), x[n : 2 * n], x[2 * n : 3 * n], x[3 * n : 3 * n + classes], x[3 * n + classes :]]


def _merged(parts: list[bytes], classes: int, head_words: int) -> bytes:
    """One summary of several over different keys."""
    each = [_parsed(p, classes) for p in parts] or [_parsed(bytes(16 * classes), classes)]
    return _summary(*(np.concatenate([e[i] for e in each]) for i in range(3)), sum(e[3] for e in each), sum(e[4] for e in each), head_words)


def language_scores(documents: DataFrame, head_words: int = 2048, classes: int = 256, prior: float = 24.0, **training) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document (doc_id, text)."""
    spark = documents.sparkSession
    least = max(2, spark.sparkContext.defaultParallelism)
    docs = only(documents, "doc_id", "text")
    in_training = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) != 0
    size, ends = docs.agg(F.sum(F.octet_length("text")), F.count(F.when(in_training, 1))).first()
    n_blocks, buckets = (max(least, -(-(size or 0) // b)) for b in (BLOCK_BYTES, BUCKET_BYTES))
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).repartition(n_blocks, "block")
    counted = new_path(spark, "word-counts")

    def send(t: pa.Table) -> pa.Table:
        b = Block([x or "" for x in t.column("text").to_pylist()], t.column("doc_id").to_pylist(), classes)
        rows = []
        for pairs, keys, counts in ((False, b.keys, b.counts), (True, b.pairs, b.pair_counts)):
            cuts = _cuts(keys, buckets)
            for bucket, (s, e) in enumerate(zip(cuts, cuts[1:])):
                if e > s:
                    class_of = b"" if pairs else packed(b.class_of[s:e].astype("<u2"))
                    rows.append((2 * bucket + pairs, e - s, packed(np.diff(keys[s:e], prepend=np.uint64(0))), packed(counts[s:e]), class_of))
        columns = [list(c) for c in zip(*rows)] or [[]] * 5
        arrays = [pa.array(columns[0], pa.int32()), pa.array([t.column("block")[0].as_py()] * len(rows), pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])]
        return pa.table(arrays, names=["bucket", "block", "n", "keys", "counts", "classes"])

    def total(t: pa.Table) -> pa.Table:
        bucket, sizes = t.column("bucket")[0].as_py(), t.column("n").to_pylist()
        asked = [np.cumsum(unpacked(x, k, np.uint64), dtype=np.uint64) for x, k in zip(t.column("keys").to_pylist(), sizes)]
        keys, first, sums, answers = summed(asked, [unpacked(x, k, np.int64) for x, k in zip(t.column("counts").to_pylist(), sizes)])
        rows = [("answer", block, bucket, k, packed(x)) for block, k, x in zip(t.column("block").to_pylist(), sizes, answers)]
        if bucket % 2 == 0:
            class_of = np.concatenate([unpacked(x, k, "<u2") for x, k in zip(t.column("classes").to_pylist(), sizes)])[first].astype(np.int64)
            words, distinct = np.zeros(classes, np.int64), np.bincount(class_of, sums > 0, classes).astype(np.int64)
            np.add.at(words, class_of, sums)
            rows.append(("summary", bucket, 0, 0, _summary(keys, sums, class_of, words, distinct, head_words)))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["kind", "a", "b", "n", "data"])

    sent = blocks.groupBy("block").applyInArrow(send, "bucket int, block long, n int, keys binary, counts binary, classes binary")
    with _shuffle_cleanup(spark):
        sent.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(total, "kind string, a long, b long, n long, data binary").write.partitionBy("kind").parquet(counted)
    told = spark.read.schema("a long, b long, n long, data binary, kind string").parquet(counted)

    def merge(t: pa.Table) -> pa.Table:
        return pa.table([pa.array([_merged(t.column("data").to_pylist(), classes, head_words)], pa.binary())], names=["data"])

    # summaries are of bounded size, and the driver gets 16 of them, however many buckets there are
    summaries = told.where("kind = 'summary'").select((F.col("a") / 2 % 16).cast("int").alias("part"), "data").groupBy("part").applyInArrow(merge, "data binary").collect()
    head, counts, class_of, words, distinct = _parsed(_merged([r.data for r in summaries], classes, head_words), classes)
    n_tokens, n_distinct = int(words.sum()) + ends, int(distinct.sum()) + (ends > 0)
    in_class = np.stack([words, distinct]).astype(np.float64)
    np.subtract.at(in_class[0], class_of, counts)
    np.subtract.at(in_class[1], class_of, 1)
    in_class = np.maximum(in_class, 0)
    symbols = Symbols(head, classes)
    sym_shared = spark.sparkContext.broadcast(symbols)
    size = symbols.size
    rows_each = max(1, -(-size // 32))

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n_held = sym_shared.value, [], 0

        def flush():
            codes, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
            cuts = np.searchsorted(codes, np.arange(33) * rows_each * size).tolist()
            rows = [(k, (codes[s:e] - k * rows_each * size).astype("<u4").tobytes(), counts[s:e].astype("<u4").tobytes()) for k, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
            columns = [list(c) for c in zip(*rows)] or [[]] * 3
            return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["part", "codes", "counts"])

        for (ids,), texts in rows_in_blocks(batches, 4_000_000):
            words, sizes = tokens([x for d, x in zip(ids, texts) if is_training(d)])
            if not len(sizes):
                continue
            h = word_hashes(words)
            keys, first, place = np.unique(h, return_index=True, return_inverse=True)
            of = known.of(keys, tail_class([words[i] for i in first.tolist()], classes))[place]
            line = np.zeros(len(of) + len(sizes), np.int64)
            line[np.arange(len(of)) + np.repeat(np.arange(len(sizes)), sizes)] = of
            before = np.concatenate([[0], line[:-1]])
            held.append((before % 32 * rows_each + before // 32) * size + line)  # contexts are dealt over the parts in turn
            n_held += len(line)
            if n_held > 8_000_000:
                yield flush()
                held, n_held = [], 0
        yield flush()

    def add(t: pa.Table) -> pa.Table:
        out = np.zeros(rows_each * size, np.float64)
        for codes, counts in zip(t.column("codes").to_pylist(), t.column("counts").to_pylist()):
            out[np.frombuffer(codes, "<u4")] += np.frombuffer(counts, "<u4")
        return pa.table([pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([out.astype("<f4").tobytes()], pa.binary())], names=["part", "counts"])

    sums = materialise(docs.mapInArrow(pair_counts, "part int, codes binary, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary"), "pair-counts")
    pairs = np.zeros((32 * rows_each, size), np.float32)
    for part, data in sums.collect():  # 32 rows, of size^2 numbers in all
        pairs[part * rows_each : (part + 1) * rows_each] = np.frombuffer(data, "<f4").reshape(rows_each, size)
    context = np.arange(size)
    pairs = pairs[context % 32 * rows_each + context // 32]
    model = {"p": train(pairs, **training), "symbols": symbols, "in_class": in_class}
    del pairs
    drop(sums)
    shared, key = spark.sparkContext.broadcast(model), counted

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)

    def score(t: pa.Table, a: pa.Table) -> pa.Table:
        known, tail = shared.value["symbols"], shared.value["in_class"]
        table = _table(key, shared.value)
        ids, texts = t.column("doc_id").to_pylist(), [x or "" for x in t.column("text").to_pylist()]
        if not ids:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        b = Block(texts, ids, classes)
        answers = sorted(zip(a.column("b").to_pylist(), a.column("n").to_pylist(), a.column("data").to_pylist()))
        counts, pair_counts = (np.concatenate([np.empty(0, np.int64), *(unpacked(x, k, np.int64) for bucket, k, x in answers if bucket % 2 == odd)]).astype(np.float64) for odd in (0, 1))
        floor = n_tokens + 0.1 * (n_distinct + 1)
        seen = b.line(counts[b.place], float(ends))
        of = known.of(b.keys, b.class_of)
        within = np.where(of <= classes, np.log10((counts + 0.1) / (tail[0][b.class_of] + 0.1 * (tail[1][b.class_of] + 1))), 0.0)
        line = b.line(of[b.place], 0)
        smooth = 10 ** (table[b.shifted(line), line].astype(np.float64) + b.line(within[b.place], 0.0))
        logs = np.log10((pair_counts[b.pair_place] + prior * smooth) / (b.shifted(seen) + prior))
        bases = np.log10((seen + 0.1) / floor)
        columns = [ids, ~b.training, b.sizes + 1, np.add.reduceat((seen > 0).astype(np.int64), b.starts), np.full(len(ids), n_tokens), np.add.reduceat(bases, b.starts), np.add.reduceat(logs, b.starts)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    answers = told.where("kind = 'answer'").select(F.col("a").alias("block"), "b", "n", "data").repartition(n_blocks, "block")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
