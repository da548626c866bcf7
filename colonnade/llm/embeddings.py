"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample; then every vector is assigned to the cell of its best centroid, and written once, to blocks of at
most block vectors in the order of labels and cells. A pair of blocks is compared by products of 1,024 vectors with those of the other block that may be near
one of them. Two facts say which: no vector within reach of a cell's vector is farther from its centroid than the cell's radius and the reach; and if a pair
within reach lies in cells h and c, both lie no farther than the reach behind the boundary: y.(c - h) <= reach |c - h|. With the chord of the
threshold's angle as reach, the default, no link is ever lost, whatever the number of cells or the intrinsic dimension; margin is half the reach, and a smaller one may lose links.
Vectors that a ball of the chord's diameter holds link without a product. Past max_cells cells there are two levels, coarse cells and cells within each.
Cells number one for each cell_size vectors, up to max_cells squared / 16 (65,536).

Vectors travel once, to be written in order, and are read from there by the tasks that compare them: disk follows the rows, whatever the number of cells that
a vector is near. What a group of pairs of blocks returns are counts and a spanning forest, never its pairs. Centroids are broadcast, 65,536 of them at most.
Equal vectors are one vector with a count.

Defined cases: a vector that is null, zero, or holds null or non-finite numbers, or whose label or vec_id is null,
links with nothing and is kept (component_id is its vec_id); vectors of another length are compared among themselves, each length with cells of its
own; rows that repeat a vector with other ids link; very long vectors are read whole; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import drop, materialise, new_path, only
from colonnade.llm.graph import components
from colonnade.llm.simhash import forest

#: Bytes of a block's vectors in double precision, at most; rounding of distances; blocks to a side of a group of pairs.
BLOCK_BYTES, SLACK, SIDE = 32_000_000, 1e-6, 8


def fit_cells(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors. An empty cell takes the vector worst served."""
    if k <= 1:
        total = sample.sum(axis=0, keepdims=True)
        return total / max(float(np.linalg.norm(total)), 1e-30)
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        home, best = np.empty(len(sample), np.int64), np.empty(len(sample))
        for a in range(0, len(sample), 4096):
            scores = sample[a : a + 4096] @ centres.T
            home[a : a + 4096], best[a : a + 4096] = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        for c in np.flatnonzero(np.bincount(home, minlength=len(centres)) == 0):
            worst = int(best.argmin())
            sums[c], best[worst] = sample[worst], 1.0
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


class Cells:
    """Two levels of centroids: coarse, and for each coarse cell its own. Cells that are near have numbers that are near."""

    def __init__(self, coarse: np.ndarray, fine: list[np.ndarray]):
        self.coarse, self.fine = coarse.astype(np.float64), [f.astype(np.float64) for f in fine]
        self.width = max(len(f) for f in fine)

    @staticmethod
    def fit(sample: np.ndarray, k: int, max_cells: int, seed: int) -> Cells:
        k1 = k if k <= max_cells else math.ceil(math.sqrt(k))
        coarse = fit_cells(sample, k1, seed=seed)
        over = fit_cells(coarse, math.isqrt(len(coarse)), seed=seed)
        coarse = coarse[np.argsort((coarse @ over.T).argmax(axis=1), kind="stable")]
        if k <= max_cells:
            return Cells(coarse, [coarse[c : c + 1] for c in range(len(coarse))])
        home = np.concatenate([(sample[a : a + 4096] @ coarse.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        members = [sample[home == c] for c in range(len(coarse))]
        share = len(sample) / k
        return Cells(coarse, [fit_cells(m, max(1, round(len(m) / share)), seed=seed) if len(m) else coarse[c : c + 1] for c, m in enumerate(members)])

    def home(self, x: np.ndarray) -> np.ndarray:
        """Number of the cell of each unit vector: the best within the best coarse cell."""
        top = (x @ self.coarse.T).argmax(axis=1)
        low = np.zeros(len(x), np.int64)
        for c in np.unique(top):
            if len(self.fine[c]) > 1:
                at = np.flatnonzero(top == c)
                low[at] = (x[at] @ self.fine[c].T).argmax(axis=1)
        return top * self.width + low

    def centres(self, cells: np.ndarray) -> np.ndarray:
        return np.stack([self.fine[c // self.width][c % self.width] for c in cells.tolist()])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each x from each y."""
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)))


def radii(x: np.ndarray, home: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of unit vectors, and how far from its centroid each cell's vectors lie at most."""
    distinct, at = np.unique(home, return_inverse=True)
    gap = x - cells.centres(distinct)[at]
    out = np.zeros(len(distinct))
    np.maximum.at(out, at, np.sqrt((gap * gap).sum(axis=1)))
    return distinct, out


def may_be_near(y: np.ndarray, home: np.ndarray, cells: Cells, others: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Which unit vectors y can be within reach of a vector in one of the other cells, which lie within radius of their centroids."""
    own, at = np.unique(home, return_inverse=True)
    theirs, mine = cells.centres(others), cells.centres(own)
    near = distances(y, theirs) <= radius + reach + SLACK
    for within in (False, True):  # the boundary between coarse cells, and between cells of one coarse cell
        level = ((others // cells.width)[None] == (own // cells.width)[:, None]) == within
        if not level.any():
            continue
        h, c = (theirs, mine) if within else (cells.coarse[others // cells.width], cells.coarse[own // cells.width])
        behind = (y * c[at]).sum(axis=1)[:, None] - y @ h.T
        near &= ~level[at] | (behind <= (reach * distances(c, h) + SLACK)[at])
    return near.any(axis=1)


class Links:
    """Counts of links of so many vectors, and a least place that each is connected to."""

    def __init__(self, n: int):
        self.n, self.labels = np.zeros(n, np.int64), np.arange(n)

    def compare(self, a: Block, b: Block, at: int, to: int, cells: Cells, reach: float, threshold: float, step: int = 1024) -> None:
        """Finds the links between two blocks, or, if they are one, those within it; at, to: their places."""
        one, chord = a is b, math.sqrt(max(0.0, 2 - 2 * threshold))
        mixed = a.label[0] != a.label[-1] or b.label[0] != b.label[-1] or a.label[0] != b.label[0]
        for s in range(0, len(a.ids), step):
            rows, after = np.arange(s, min(s + step, len(a.ids))), s if one else 0
            cols = after + np.flatnonzero(may_be_near(b.x[after:], b.home[after:], cells, *radii(a.x[rows], a.home[rows], cells), reach))
            if mixed:
                cols = cols[np.isin(b.label[cols], a.label[rows])]
            if not len(cols):
                continue
            rows = rows[may_be_near(a.x[rows], a.home[rows], cells, *radii(b.x[cols], b.home[cols], cells), reach)]
            if not len(rows):
                continue
            if not mixed and threshold > -1:
                middle = a.x[rows].mean(axis=0, keepdims=True)
                ball = distances(a.x[rows], middle).max() + distances(b.x[cols], middle)[:, 0] <= chord - SLACK
                if one:
                    ball &= cols > rows[-1]
                if ball.any():  # all of these link
                    sure, cols = cols[ball], cols[~ball]
                    self.n[at + rows] += b.counts[sure].sum()
                    self.n[to + sure] += a.counts[rows].sum()
                    self.labels = forest(len(self.n), np.append(at + rows, to + sure), np.full(len(rows) + len(sure), to + sure[0]), self.labels)
            for t in range(0, len(cols), 4 * step):
                some = cols[t : t + 4 * step]
                near = a.x[rows] @ b.x[some].T >= threshold
                if one:
                    near &= rows[:, None] < some[None]
                if mixed:
                    near &= a.label[rows][:, None] == b.label[some][None]
                self._add(near, at + rows, to + some, a.counts[rows], b.counts[some])

    def _add(self, near: np.ndarray, i: np.ndarray, j: np.ndarray, of_i: np.ndarray, of_j: np.ndarray) -> None:
        found = int(near.sum())
        if found <= 4 * (len(i) + len(j)):
            r, c = np.nonzero(near)
            np.add.at(self.n, i[r], of_j[c])
            np.add.at(self.n, j[c], of_i[r])
            self.labels = forest(len(self.n), i[r], j[c], self.labels)
            return
        self.n[i] += near.sum(axis=1) if (of_j == 1).all() else (near @ of_j)
        self.n[j] += near.sum(axis=0) if (of_i == 1).all() else (of_i @ near)
        while True:
            apart = near & (self.labels[i][:, None] != self.labels[j][None])
            first = apart.argmax(axis=1)
            rows = np.flatnonzero(apart[np.arange(len(i)), first])
            if not len(rows):
                return
            self.labels = forest(len(self.n), i[rows], j[first[rows]], self.labels)


def unit(x: np.ndarray, dim: int) -> np.ndarray:
    x = x.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows, or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


class Block:
    """Vectors of a written block. label: numbers that stand for its labels, the same ones in each block of a group."""

    def __init__(self, folder: str, file: str, batch: int, cells: Cells, numbers: dict):
        held = _open(folder, file).get_batch(batch)
        self.ids, self.counts, self.home = (held.column(c).to_numpy() for c in ("id", "copies", "cell"))
        self.x = unit(_flat(held.column("embedding")), cells.coarse.shape[1])
        labels = held.column("label").dictionary_encode()
        self.label = np.array([numbers.setdefault(v, len(numbers)) for v in labels.dictionary.to_pylist()], np.int64)[labels.indices.to_numpy()]


def _open(folder: str, file: str) -> pa.ipc.RecordBatchFileReader:
    fs, root = pafs.FileSystem.from_uri(folder)
    name = f"{root}/{file}"
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name))


def write_blocks(batches: Iterator[pa.RecordBatch], folder: str, rows: int, cells: Cells) -> Iterator[pa.RecordBatch]:
    """Writes vectors (label, shelf, cell, id, copies, embedding), which come in this order, as blocks; returns, for each block and label, its cells and their radii.

    A shelf from 0 on has blocks of its own; a label that is all on shelf -1 shares its block with others.
    """
    from pyspark import TaskContext

    task = TaskContext.get()
    name = f"{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
    held: list[pa.RecordBatch] = []
    out = writer = before = None
    n = done = 0

    def flush() -> pa.RecordBatch:
        nonlocal out, writer, n, done
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if writer is None:
            fs, root = pafs.FileSystem.from_uri(folder)
            fs.create_dir(root, recursive=True)
            out = fs.open_output_stream(f"{root}/{name}")
            writer = pa.ipc.new_file(out, part.schema)
        writer.write_batch(part)
        x, home = unit(_flat(part.column("embedding")), cells.coarse.shape[1]), part.column("cell").to_numpy()
        code = part.column("label").dictionary_encode()
        starts = np.flatnonzero(np.diff(code.indices.to_numpy(), prepend=-1))
        found = [radii(x[s:e], home[s:e], cells) for s, e in zip(starts, np.append(starts[1:], len(x)))]
        number, shelf = (task.partitionId() << 32) + done, part.column("shelf")[0].as_py()
        held.clear()
        n, done = 0, done + 1
        columns = [
            pa.array([number] * len(starts), pa.int64()), pa.array([name] * len(starts)), pa.array([done - 1] * len(starts), pa.int32()), pa.array([part.num_rows] * len(starts), pa.int64()),
            pa.array([shelf] * len(starts), pa.int32()), pa.array([i == 0 for i in range(len(starts))]), part.column("label").take(pa.array(starts)),
            pa.array([c.tolist() for c, _ in found], pa.list_(pa.int64())), pa.array([r.tolist() for _, r in found], pa.list_(pa.float64())),
        ]
        return pa.record_batch(columns, names=["block", "file", "batch", "n", "shelf", "head", "label", "cells", "radii"])

    for b in batches:
        labels, shelves = b.column("label").dictionary_encode(), b.column("shelf").to_numpy()
        code = labels.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(shelves) != 0)) + 1
        cuts = [0, *cuts[(shelves[cuts] >= 0) | (shelves[cuts - 1] >= 0)].tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            key = (b.column("label")[s].as_py(), int(shelves[s]))
            if held and key != before and (key[1] >= 0 or before[1] >= 0):
                yield flush()
            while s < e:
                take = min(e - s, rows - n)
                held.append(b.slice(s, take))
                n, s = n + take, s + take
                if n == rows:
                    yield flush()
            before = (b.column("label")[e - 1].as_py(), int(shelves[e - 1]))
    if held:
        yield flush()
    if writer is not None:
        writer.close()
        out.close()


def shelves(labels: list, home: np.ndarray, share: float, rows: int) -> dict:
    """For each label of more than so many rows, the cells at which another shelf begins; labels and home: of a sample, of which a share of all is in."""
    of: dict = {}
    for label, cell in zip(labels, home.tolist()):
        of.setdefault(label, []).append(cell)
    every = max(1, round(rows * share))
    return {label: np.sort(found)[every::every] for label, found in of.items() if len(found) > every}


def near_vectors(table: DataFrame, threshold: float = 0.93, cell_size: int = 1000, max_cells: int = 1024, sample_rows: int = 20_000, block: int = 4096, margin: float | None = None, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row (vec_id, embedding, label).

    sample_rows bounds what the centroids are fitted on, up to 20 cells for each 100 of them; beyond, four vectors a cell are sampled (262,144 at most).
    """
    rows = only(table, "vec_id", "embedding", "label")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    fit = F.coalesce(fit, F.lit(False))
    lengths = [r[0] for r in rows.where(fit).groupBy(F.size("embedding").alias("dim")).count().where("count > 1").collect()]
    lone = rows.where(~fit | ~F.size("embedding").isin(lengths)) if lengths else rows
    out = lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if margin is None:
        margin = math.sqrt(max(0.0, (1 - threshold) / 2)) + 1e-9
    for dim in sorted(lengths):
        out = _of_length(rows.where(fit & (F.size("embedding") == dim)), dim, threshold, cell_size, max_cells, sample_rows, block, margin, seed).unionByName(out)
    return out


def _of_length(rows: DataFrame, dim: int, threshold: float, cell_size: int, max_cells: int, sample_rows: int, block: int, margin: float, seed: int) -> DataFrame:
    """near_vectors of rows that are all fit, and of one length."""
    spark = rows.sparkSession
    distinct = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    distinct = materialise(distinct, "vectors")
    total = distinct.count()
    k = max(1, min(max_cells**2 // 16, math.ceil(total / cell_size)))
    sample_rows = max(sample_rows, min(4 * k, max_cells**2 // 4))
    share = sample_rows / max(total, 1)
    picked = distinct.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(2**53)) < share).select("id", "label", "embedding").limit(2 * sample_rows).toArrow()
    picked = picked.take(pc.sort_indices(picked, [("id", "ascending")])).combine_chunks()
    sample = unit(_flat(picked.column("embedding").combine_chunks()), dim) if picked.num_rows else np.empty((0, dim))
    cells = Cells.fit(sample.astype(np.float32), k, max_cells, seed) if len(sample) else Cells(np.eye(1, dim), [np.eye(1, dim)])
    block = max(1, min(block, BLOCK_BYTES // (8 * dim)))
    home = np.concatenate([cells.home(sample[a : a + 4096]) for a in range(0, len(sample), 4096)]) if len(sample) else np.empty(0, np.int64)
    shared = spark.sparkContext.broadcast((cells, shelves(picked.column("label").to_pylist(), home, len(sample) / max(total, 1), block)))
    label, element = rows.schema["label"].dataType.simpleString(), rows.schema["embedding"].dataType.elementType.simpleString()
    folder = new_path(spark, "blocks")

    def place(batches):
        cells, cuts = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                home = cells.home(unit(_flat(part.column("embedding")), dim))
                code, ids = part.column("label").dictionary_encode(), part.column("id").to_numpy()
                shelf = np.full(len(home), -1, np.int32)
                for i, name in enumerate(code.dictionary.to_pylist()):
                    if name in cuts:
                        at = np.flatnonzero(code.indices.to_numpy() == i)
                        low, high = (np.searchsorted(cuts[name], home[at], side) for side in ("left", "right"))
                        spread = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                        shelf[at] = low + (spread % (high - low + 1).astype(np.uint64)).astype(np.int64)  # a cell of several shelves is dealt out among them
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(shelf), pa.array(home), *(part.column(c) for c in ("id", "copies", "embedding"))], names=["label", "shelf", "cell", "id", "copies", "embedding"])

    placed = distinct.select("label", "id", "copies", "embedding").mapInArrow(place, f"label {label}, shelf int, cell long, id long, copies long, embedding array<{element}>")
    placed = placed.repartition("label", "shelf").sortWithinPartitions("label", "shelf", "cell", "id")
    written = placed.mapInArrow(lambda batches: write_blocks(batches, folder, block, shared.value[0]), f"block long, file string, batch int, n long, shelf int, head boolean, label {label}, cells array<long>, radii array<double>")
    written = materialise(written, "blocks-index")
    # Few and small rows stand for much work: they are dealt out by number, lest adaptive execution put them in one task.
    tasks = max(SIDE, int(spark.conf.get("spark.sql.shuffle.partitions")))
    several = written.groupBy("label").count().where("count > 1").select("label")
    side = lambda s: written.join(several, "label", "left_semi").select("label", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "file", "batch", "n", "shelf", "cells", "radii")))
    left = side("a").withColumn("deal", F.pmod(F.xxhash64("block_a"), F.lit(2 * SIDE)).cast("int"))
    right = side("b").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(2 * SIDE - 1))))
    left, right = (x.repartition(tasks, "label", "deal") for x in (left, right))

    def meet(batches):
        for b in batches:
            keep = []
            for cells_a, radii_a, cells_b, radii_b in zip(*(b.column(c).to_pylist() for c in ("cells_a", "radii_a", "cells_b", "radii_b"))):
                gaps = distances(*(shared.value[0].centres(np.array(c)) for c in (cells_a, cells_b)))
                keep.append(bool((gaps <= np.add.outer(radii_a, radii_b) + 2 * margin + SLACK).any()))
            yield b.select(pair).filter(pa.array(keep, pa.bool_()))

    pair = ["label", *(f"{c}_{s}" for s in "ab" for c in ("block", "file", "batch", "n", "shelf"))]
    kinds = ", ".join([f"label {label}", *(f"block_{s} long, file_{s} string, batch_{s} int, n_{s} long, shelf_{s} int" for s in "ab")])
    two = left.hint("merge").join(right, ["label", "deal"]).where("block_a < block_b").mapInArrow(meet, kinds)
    own = written.where("head").select("label", *(F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("block", "file", "batch", "n", "shelf")))
    pairs = two.union(own.select(*pair)).withColumns({f"group_{s}": F.floor(F.col(f"shelf_{s}") / SIDE) for s in "ab"})
    pairs = pairs.withColumns({"low": F.least("group_a", "group_b"), "high": F.greatest("group_a", "group_b")})

    def work(t: pa.Table) -> pa.Table:
        cells, numbers = shared.value[0], {}
        todo = sorted(set(zip(*(t.column(c).to_pylist() for c in ("block_a", "file_a", "batch_a", "n_a", "block_b", "file_b", "batch_b", "n_b")))))
        sizes = {r[i]: r[i + 3] for r in todo for i in (0, 4)}
        at = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist()))
        ids, links = np.zeros(sum(sizes.values()), np.int64), Links(sum(sizes.values()))
        a, last = None, None
        for block_a, file_a, batch_a, _, block_b, file_b, batch_b, _ in todo:
            if last != block_a:
                a, last = Block(folder, file_a, batch_a, cells, numbers), block_a
            b = a if block_b == block_a else Block(folder, file_b, batch_b, cells, numbers)
            for x, place in ((a, at[block_a]), (b, at[block_b])):
                ids[place : place + len(x.ids)] = x.ids
            links.compare(a, b, at[block_a], at[block_b], cells, 2 * margin, threshold)
        some = (links.n > 0) | (links.labels != np.arange(len(ids)))
        return pa.table([pa.array(ids[some]), pa.array(links.n[some]), pa.array(ids[links.labels[some]])], names=["id", "links", "root"])

    found = materialise(pairs.repartition(tasks, "label", "low", "high").groupBy("label", "low", "high").applyInArrow(work, "id long, links long, root long"), "vector-links")
    drop(written)
    drop(folder, spark)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "id")
    code = F.xxhash64("label", "embedding").alias("code")  # of equal vectors equal, and almost always of these alone
    keys = materialise(distinct.select(code, "id", "copies"), "vector-codes")
    clash = [r[0] for r in keys.groupBy("code").count().where("count > 1").select("code").collect()]
    if clash:
        shared_codes = spark.createDataFrame([(c,) for c in clash], "code long")
        same = distinct.select(code, F.col("label").alias("l"), F.col("embedding").alias("e"), F.col("id").alias("i")).join(F.broadcast(shared_codes), "code", "left_semi")
        unsure = rows.select(code, "vec_id", "label", "embedding").join(F.broadcast(shared_codes), "code", "left_semi")
        unsure = unsure.join(same.drop("code"), (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", F.col("i").alias("id"))
        unsure = materialise(unsure, "vectors-of-a-code")
        alone = keys.join(F.broadcast(shared_codes), "code", "left_anti").select("code", "id")
        members = rows.select(code, "vec_id").join(alone, "code").select("vec_id", "id").unionByName(unsure)
    else:
        members = rows.select(code, "vec_id").join(keys.select("code", "id"), "code").select("vec_id", "id")
    drop(distinct)
    state = keys.join(links, "id", "left").join(classes, "id", "left")
    state = state.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    linked = members.join(state, "id")
    return linked.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), (F.col("vec_id") == F.col("c")).alias("kept"))
