"""The pipeline's near-dedup stage against the exact Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import near_copies, simhash
from colonnade.llm.simhash import forest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return [rng.choice(["ka", "lo", "mi", "ru", "so", "ta", "ne", "vi"]) + rng.choice("abcdefgh") for _ in range(n)]


def windows(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_of(texts):
    sets = [windows(t) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    i, j = np.array(pairs, np.int64).reshape(-1, 2).T
    labels = forest(len(sets), i, j)
    return np.flatnonzero(labels == np.arange(len(sets))).tolist()


@pytest.fixture(scope="module")
def texts():
    """Groups of copies with 0 to 12 of 150 words changed (on both sides of 0.8), and unrelated, short, equal, blank and null texts."""
    rng = random.Random(3)
    out = []
    for _ in range(25):
        base = prose(rng, 150)
        for k in (0, 1, 2, 3, 4, 8, 12):
            words = list(base)
            for i in rng.sample(range(150), k):
                words[i] = f"new{rng.random()}"
            out.append(" ".join(words))
    out += [" ".join(prose(rng, rng.randrange(1, 90))) for _ in range(60)]
    return [*out, "One two", "one\n TWO ", "a b c d e", "A b c d e", "a b c d e f", "", " \n", None]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_stage_removes_near_copies_of_five_word_shingles(spark, texts):
    df = frame(spark, texts)
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == kept_of(texts)


def test_blocks_of_large_clusters_give_the_same(spark, texts):
    rng = random.Random(8)
    base = prose(rng, 400)
    many = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(0, 400, 5)] + texts[:40]
    want = kept_of(many)
    for cut in ({"max_cell": 9}, {"max_bytes": 20_000}):
        assert sorted(r.doc_id for r in near_copies.dedup(frame(spark, many), **cut).collect()) == want


def test_bands_find_what_they_promise():
    rng, turns = np.random.default_rng(6), near_copies._turns(42)
    found = 0
    for _ in range(600):
        common, rest = rng.integers(0, 2**64, 80, dtype=np.uint64), rng.integers(0, 2**64, 20, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, part])) for part in (rest[:10], rest[10:]))
        found += any(x == y for x, y in zip(near_copies.bands_of(a, turns), near_copies.bands_of(b, turns)))
    assert found >= 596


def test_fingerprints_alone_make_candidates(spark):
    rng = random.Random(4)
    base = prose(rng, 250)
    texts = [" ".join(base), *(" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(5, 250, 16)), " ".join(prose(rng, 250)), "", None]
    fps = [simhash.fingerprint(t, 5) if t else None for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if fps[i] and fps[j] and (fps[i] ^ fps[j]).bit_count() <= 3 and jaccard(windows(texts[i]), windows(texts[j])) >= 0.8]
    assert 0 < len(pairs) < 17 * 16 / 2
    df = frame(spark, texts)
    signed = near_copies.signatures(df).withColumn("bands", F.array().cast("array<long>"))
    near = near_copies.near_links(df, signed).collect()
    at = {near_copies.key_of(t or ""): i for i, t in enumerate(texts)}
    ends = [np.array([(at[r.u], at[r.v]) for r in near]).T, np.array(pairs).T]
    found, want = (forest(len(texts), *e) for e in ends)
    linked = lambda labels: {tuple(np.flatnonzero(labels == x)) for x in set(labels)}
    reached = {i for pair in pairs for i in pair}
    assert all(any(set(w) <= set(f) for f in linked(found)) for w in linked(want))
    assert all(set(f) <= reached for f in linked(found) if len(f) > 1)


def test_null_and_repeated_ids_leave_one_row_of_each_text(spark, texts):
    a, b, c, d = texts[0], texts[1], texts[7], texts[14]
    rows = [(1, a, "x"), (1, a, "y"), (1, c, "z"), (2, b, "z"), (None, a, "z"), (None, d, "q"), (None, d.upper(), "p"), (3, texts[21], "r"), (4, texts[21], "r")]
    rows += [(5, None, None), (None, None, None), (None, texts[28], "n"), (None, texts[28], "n")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or ""), {"k": n}) for n, (i, t, s) in enumerate(rows)], SCHEMA + ", other map<string,int>")
    out = near_copies.dedup(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in out.collect()), key=str) == sorted([(1, a), (1, c), (None, d), (3, texts[21]), (5, ""), (None, texts[28])], key=str)


def test_empty_table(spark):
    assert near_copies.dedup(frame(spark, [])).count() == 0
