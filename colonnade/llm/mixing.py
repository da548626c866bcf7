"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Targets: sources, by code point with null last, weigh 3, 1, 2, repeating, and share a budget of words; a target stops at max_repeats times its
source's size, and what is over goes to the others by weight until none is above (water filling, in closed form over the sources).

Rounding: each document of a source is due target / size copies: the whole part is taken, and the fractions are rounded against each
other. Two documents of fractions p, q and sizes a, b meet; mass moves from one to the other so that a p + b q stays, the
direction being drawn so that each expectation stays, until one of the two is 0 or 1. The document that is left meets the next. So
the words of a source stay at its target until one document is left, and it alone is drawn on its own: the sum is within the size of
one document of the target. The meetings form a tree: documents are dealt into chunks of about fan_in by a hash of their id, each chunk
folds to one residual, fan_in chunks fold to one again, and so on. No task holds more than a few chunks, however large the source.
Draws are hashes of the seed and of a row's key: reruns agree, however the table is split. The key is the doc_id and the text's hash; rows that agree
in both are numbered, by task and then within it, so that any number of them spreads over the chunks.

Defined cases: null and blank texts have size 0 and are taken 0 times; a null source is a source; rows of one doc_id, and rows with a null doc_id,
are each rounded as documents of their own; a very long text is one document of its size; a corpus without words has targets of 0; an empty
table gives no rows; other columns, whatever their names, are ignored by mixture and kept by mix_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.common import by_place, materialise, only, words_column

WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, share: float = 1.5, max_repeats: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """source, n, source_size, target of each source, from rows (source, size). Windows run over one row for each source."""
    sources = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), rank % len(weights) + 1))
    sources = sources.withColumn("most", max_repeats * F.col("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(every) - before) / left
    sources = sources.withColumn("level", level).withColumn("stops", F.col("most") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)  # past the first that does not stop, levels fall
    return sources.select("source", "n", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def _draw(seed: int, *by) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11) / F.lit(float(2**53))


def _meet(seed: int):
    """Fold step: the residual p of the accumulator meets document x; what becomes whole goes to out."""

    def step(acc: Column, x: Column) -> Column:
        p = acc["p"]
        a, b = p["size"], x["size"]
        up = F.least(1 - p["p"], x["p"] * b / a)
        down = F.least(p["p"], (1 - x["p"]) * b / a)
        rises = _draw(seed, p["key"], x["key"]) * (up + down) < down
        moved = F.struct(p.alias("p"), x.alias("x"), up.alias("up"), down.alias("down"), rises.alias("rises"))

        def settle(m: Column) -> Column:
            p, x = m["p"], m["x"]
            p_whole = F.when(m["rises"], 1 - p["p"] <= x["p"] * x["size"] / p["size"]).otherwise(p["p"] <= (1 - x["p"]) * x["size"] / p["size"])
            p_new = F.when(p_whole, F.when(m["rises"], 1.0).otherwise(0.0)).otherwise(F.when(m["rises"], p["p"] + m["up"]).otherwise(p["p"] - m["down"]))
            x_new = F.when(~p_whole, F.when(m["rises"], 0.0).otherwise(1.0)).otherwise(
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(m["rises"], x["p"] - m["up"] * p["size"] / x["size"]).otherwise(x["p"] + m["down"] * p["size"] / x["size"])))
            )
            p2, x2 = p.withField("p", p_new), x.withField("p", x_new)
            return F.struct(
                F.when(p_whole, x2).otherwise(p2).alias("p"),
                F.concat(acc["out"], F.array(F.when(p_whole, p2).otherwise(x2))).alias("out"),
            )

        met = F.element_at(F.transform(F.array(moved), settle), 1)
        return F.when(p.isNull(), F.struct(x.alias("p"), acc["out"].alias("out"))).otherwise(met)

    return step


def rounded(rows: DataFrame, fan_in: int = 64, seed: int = 7) -> DataFrame:
    """rows (key, source, n, size > 0, p) with p rounded to 0.0 or 1.0, by a reduction tree within each source. n: rows of the source."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / fan_in)).cast("long")
    item = F.struct(*rows.columns)
    level = rows.select(item.alias("x"), "source", F.pmod(F.xxhash64(F.lit(seed), "key"), chunks).alias("chunk"), chunks.alias("chunks"))
    kind = level.schema["x"].dataType.simpleString()
    done, depth = None, 0
    while True:
        order = F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + depth), F.col("x")["key"]).alias("h"), F.col("x").alias("x"))))
        folded = level.groupBy("source", "chunk", "chunks").agg(order.alias("xs"))
        start = F.struct(F.lit(None).cast(kind).alias("p"), F.array().cast(f"array<{kind}>").alias("out"))
        folded = folded.select("source", "chunk", "chunks", F.aggregate(F.transform("xs", lambda s: s["x"]), start, _meet(seed + depth)).alias("f"))
        folded = materialise(folded.select("source", "chunk", "chunks", "f.*"), "rounding")
        whole = folded.select(F.explode("out").alias("x"))
        done = whole if done is None else done.union(whole)
        most = folded.agg(F.max("chunks")).first()[0]
        if most is None or most <= 1:
            last = folded.select(F.col("p").withField("p", F.when(_draw(seed - 1, F.col("p")["key"]) < F.col("p")["p"], 1.0).otherwise(0.0)).alias("x"))
            return done.union(last).select("x.*")
        level = folded.select(F.col("p").alias("x"), "source", F.floor(F.col("chunk") / fan_in).alias("chunk"), F.ceil(F.col("chunks") / fan_in).cast("long").alias("chunks"))
        depth += 1


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (row, key, ...) with keys that differ: rows of one key are numbered from 0. A key's rows are sorted by task, never all in one."""
    again = materialise(rows.groupBy("key").count().where("count > 1").select("key"), "repeated-keys")
    if again.isEmpty():
        return rows
    same = rows.select("row", "key", F.shiftright("row", 33).alias("task")).join(again, "key", "left_semi")
    same = same.withColumn("nth", F.row_number().over(Window.partitionBy("key", "task").orderBy("row")) - 1)
    sizes = same.groupBy("key", "task").count()
    before = F.sum("count").over(Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    same = same.join(sizes.select("key", "task", F.coalesce(before, F.lit(0)).alias("before")), ["key", "task"]).select("row", (F.col("nth") + F.col("before")).alias("nth"))
    return rows.join(same, "row", "left").withColumn("key", F.concat_ws("#", "key", "nth")).drop("nth")


def _rows(plain: DataFrame, at: dict[str, str], *more) -> DataFrame:
    """row, key, source, size and more of a table with columns by place, written out so that row stays what it is."""
    text = F.col(at["text"])
    key = F.concat(F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")), F.lit("|"), F.hex(F.xxhash64(text)))
    made = [F.monotonically_increasing_id().alias("row"), key.alias("key"), F.col(at["source"]).alias("source"), F.size(words_column(text)).cast("long").alias("size")]
    return materialise(plain.select(*made, *more), "mix")


def _mixed(rows: DataFrame, share: float, max_repeats: float, seed: int) -> DataFrame:
    """copies, target and source_size for rows (row, key, source, size, ...)."""
    each = targets(rows, share, max_repeats).withColumnRenamed("source", "of_source")
    rows = _numbered(rows).join(each, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    due = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(due).cast("long")).withColumn("p", due - F.floor(due))
    settled = F.col("p") == 0
    rounded_rows = rounded(rows.where(~settled), seed=seed)
    out = rows.where(settled).unionByName(rounded_rows)
    return out.withColumn("copies", F.col("whole") + F.col("p").cast("long"))


def mixture(documents: DataFrame, share: float = 1.5, max_repeats: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words that the mix takes) of each document (doc_id, text, source)."""
    plain, at = by_place(only(documents, "doc_id", "text", "source"))
    out = _mixed(_rows(plain, at, F.col(at["doc_id"]).alias("doc_id")), share, max_repeats, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(documents: DataFrame, share: float = 1.5, max_repeats: float = 2.0, seed: int = 7) -> DataFrame:
    """The documents with all their columns, each row as often as the mix takes it."""
    plain, at = by_place(documents)
    rows = _rows(plain, at, F.struct(*plain.columns).alias("given"))
    copies = _mixed(rows.drop("given"), share, max_repeats, seed).where("copies > 0").select("row", "copies")
    taken = rows.select("row", "given").join(copies, "row").select("given", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("given.*").toDF(*documents.columns)
