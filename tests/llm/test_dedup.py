"""Near-duplicates, repeated passages, quality rules and the mix, against brute force on small tables."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.llm import graph, mixing, near_copies, quality, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def prose(rng, n):
    return " ".join(rng.choice(["ka", "lo", "mi", "ru", "so", "ta", "ne", "vi"]) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """Copies, near copies, shared passages, hot source, empty and null texts, repeated rows, null ids and sources."""
    rng = random.Random(5)
    rows, base, passage = [], prose(rng, 120), prose(rng, 60)
    for i in range(120):
        if i < 30:
            words = base.split()
            if i % 3:
                words[rng.randrange(len(words))] = f"new{i}"
            text = " ".join(words)
        elif i < 60:
            text = prose(rng, 40) + "\n" + passage + "\n" + prose(rng, rng.randrange(1, 50))
        elif i < 70:
            text = "spam eggs " * 40
        else:
            text = prose(rng, rng.randrange(0, 90))
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}", len(text)))
    long = prose(rng, 20000)
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \n\t ", "en", None, 4), (203, long, "en", "s2", len(long)), (203, long, "en", "s2", len(long)), (None, passage, "en", "s3", 9), (None, None, None, "s3", None)]
    rows += [(204, "One TWO", "en", "s1", 7), (205, "one two", "en", "s1", 7), (206, "é ü x y \x0b z", "fr", "s4", 9)]
    return rows


def words_of(text):
    return (text or "").encode().split()


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (30, 20), (200, 150), (300, 299)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 299 else [(i, i + 1) for i in range(299)]
        parent = list(range(n))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in edges:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
        got = {r.node: r.component for r in graph.components(frame(spark, edges + [(None, 1), (2, None)] if n > 2 else edges, "u long, v long")).collect()}
        touched = {x for e in edges if e[0] != e[1] for x in e}
        assert got == {x: find(x) for x in touched}


def test_simhash_classes(spark, docs):
    got = simhash.simhash_duplicates(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    fps = {}
    for doc_id, text, *_ in docs:
        fps.setdefault(doc_id, simhash.fingerprint(text or ""))
    ids = sorted(i for i in fps if i is not None)
    component = {i: i for i in ids}
    for _ in ids:
        before = dict(component)
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    component[b] = min(component[a], component[b])
        if component == before:
            break
    for r in got:
        assert r.component_id == (None if r.doc_id is None else component[r.doc_id])
        if r.doc_id is not None:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}"
    kept = [r.doc_id for r in simhash.dedup(frame(spark, docs)).collect()]
    assert sorted(kept, key=str) == sorted([d for d, *_ in docs if d is None or component[d] == d], key=str)


def test_fingerprints_by_definition():
    from xxhash import xxh64_intdigest

    for text in ("", " \n", "One", "one  TWO", "a b c", "A b\tc d e a b c", "é ü ñ x"):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_pigeonring_loses_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) for _ in range(k)]) for k in (1, 2, 3, 4)]]))
    ids, labels = np.arange(len(fps)), np.arange(len(fps))
    u, v = [], []
    for k in range(4):
        turned = fps << np.uint64(16 * k) | (fps >> np.uint64(64 - 16 * k) if k else np.uint64(0))
        a, b = simhash.links_in_cells((turned >> np.uint64(48)).astype(np.int64), turned, ids, np.full(len(ids), -1), 3)
        u.append(a)
        v.append(b)
    labels = simhash.forest(len(fps), np.concatenate(u), np.concatenate(v))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1))
    assert (labels == simhash.forest(len(fps), i, j)).all() and len(i) > 60


def test_blocks_of_large_cells_give_the_same(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)})
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    df = frame(spark, rows, "fp long, id long")
    whole = {(r.node, r.component) for r in graph.components(simhash.near_links(df)).collect()}
    cut = {(r.node, r.component) for r in graph.components(simhash.near_links(df, max_cell=25)).collect()}
    assert whole == cut and len(whole) > 200


def marked(docs, window=13):
    first = {}
    for d, text, *_ in docs:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    for d, text, *_ in docs:
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        yield d, text, w, gone


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_report(spark, docs, batches):
    got = collections.Counter(map(tuple, substring.report(frame(spark, docs), batches=batches).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    want = collections.Counter((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()) for d, _, w, gone in marked(docs))
    assert got == want
    assert sum(n for _, n, r, _ in got) and sum(r for _, _, r, _ in got) > 1000


def test_substring_dedup_keeps_columns(spark, docs):
    rows = [(*r, "x", i) for i, r in enumerate(docs)]
    df = frame(spark, rows, SCHEMA + ", block string, n long")
    out = substring.dedup(df)
    assert out.columns == df.columns
    got = {r.n: r for r in out.collect()}
    for (d, text, w, gone), row in zip(marked(docs), rows):
        r = got[row[6]]
        assert words_of(r.text) == [x for x, g in zip(w, gone) if not g] and (r.block, r.source) == ("x", row[3])
        if not any(gone):
            assert r.text == text
        assert r.text is None or r.n_chars == len(r.text)


def test_substring_index_takes_new_batches(spark, docs, tmp_path):
    import json

    index = substring.WindowIndex(spark, f"file://{tmp_path}/index", 4)
    got = collections.Counter()
    parts = [[r for r in docs if r[0] is not None and a <= r[0] < b] for a, b in ((0, 40), (40, 65), (65, 110), (110, 999))]
    for part in parts:
        out = substring.report(frame(spark, part), batches=1, index=index)
        got.update(map(tuple, out.select("doc_id", "n_words", "n_removed").collect()))
        index = substring.WindowIndex.restore(spark, json.loads(json.dumps(index.state())))
    assert got == collections.Counter((d, len(w), sum(gone)) for d, _, w, gone in marked(docs) if d is not None)
    assert [len(x) for x in index.levels] == [0, 0, 1]


def test_substring_index_finds_equal_hashes_apart():
    main, second = np.array([5, 5, 7, 7, 9], np.uint64), np.array([1, 2, 1, 1, 3], np.uint32)
    m, s, d = substring.first_of_each(main, second, np.array([4, 3, 9, 2, 1]))
    assert list(zip(m.tolist(), s.tolist(), d.tolist())) == [(5, 1, 4), (5, 2, 3), (7, 1, 2), (9, 3, 1)]
    assert substring.find(np.array([5, 5, 5, 7, 8, 99], np.uint64), np.array([2, 1, 3, 1, 1, 1], np.uint32), m, s).tolist() == [1, 0, -1, 2, -1, -1]
    for a, b in zip(substring.unpack(*substring.pack(m, s, d)), (m, s, d)):
        assert (a == b).all()


def test_quality_counts(spark, docs):
    got = quality.quality_report(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    want = collections.Counter()
    for d, text, *_ in docs:
        t = text or ""
        w = words_of(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want[d, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_bad_hosts_are_rejected_and_small_ones_shrunk(spark):
    rng = random.Random(9)
    good = prose(rng, 60)
    rows = []
    for host, n, bad in (("bad", 60, 55), ("fine", 300, 6), ("other", 200, 4), ("tiny", 1, 1)):
        rows += [(len(rows) + i, "too few words" if i < bad else f"{good} {rng.random()}", "en", host, 0) for i in range(n)]
    kept = collections.Counter(r.doc_id for r in quality.quality_report(frame(spark, rows)).where("kept").collect())
    hosts = {r[0]: r[3] for r in rows}
    left = collections.Counter(hosts[d] for d in kept)
    assert left["bad"] == 0 and left["fine"] == 294 and left["other"] == 196
    verdicts = {r.of_host: r for r in quality.host_verdicts(quality.host_rates(quality.judged(frame(spark, rows)))).collect()}
    assert {h for h, r in verdicts.items() if not r.host_ok} == {"bad"}
    assert 0.8 < verdicts["bad"].host_rate_few_words < 55 / 60 and 6 / 300 < verdicts["fine"].host_rate_few_words < 0.03 and verdicts["tiny"].host_rate_few_words < 0.9


def test_prior_has_the_greatest_likelihood(spark):
    from math import lgamma

    hosts = [("a", 50, 5), ("b", 80, 6), ("c", 40, 2), ("d", 100, 12), ("e", 3, 3), ("bad", 60, 50), ("f", 1, 0)]
    df = frame(spark, [(h, n, f, 0, n, 0, f) for h, n, f in hosts], "host string, n long, f0 long, f1 long, f2 long, f3 long, f4 long")
    m, s = quality.beta_priors(df)[0]

    def like(m, s):
        return sum(lgamma(m * s + f) + lgamma((1 - m) * s + n - f) - lgamma(s + n) + lgamma(s) - lgamma(m * s) - lgamma((1 - m) * s) for _, n, f in hosts)

    p = sum(f for *_, f in hosts) / sum(n for _, n, _ in hosts)
    assert like(m, s) >= max(like(p * o / (1 - p + p * o), k) for o in quality.ODDS for k in quality.STRENGTHS) - 1e-3
    assert quality.beta_priors(df)[1] == (0.0, quality.STRENGTHS[-1]) and quality.beta_priors(df)[2] == (1.0, quality.STRENGTHS[-1])
    verdict = {r.of_host: r.host_ok for r in quality.host_verdicts(df.withColumn("f2", F.lit(0))).collect()}
    assert verdict == {h: h != "bad" for h, *_ in hosts}


def test_quality_filter_keeps_columns_and_names(spark, docs):
    df = frame(spark, [(*r, i, "h") for i, r in enumerate(docs)], SCHEMA + ", n_words int, host string")
    out = quality.quality_filter(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    kept = {(r.doc_id, r.text) for r in quality.quality_report(frame(spark, docs)).where("kept").join(frame(spark, docs), "doc_id").select("doc_id", "text").collect()}
    assert {(r.doc_id, r.text) for r in out.where("doc_id is not null").collect()} == kept


def water(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, capped, budget = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        target = {s: 2.0 * sizes[s] for s in capped} | {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixture(spark, docs):
    got = mixing.mixture(frame(spark, docs)).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((d, len(words_of(t))) for d, t, *_ in docs)
    sizes = collections.Counter()
    for _, text, _, source, _ in docs:
        sizes[source] += len(words_of(text))
    target = water(sizes)
    by_target = {}
    for r in got:
        assert r.taken <= 2 * r["size"] and r.taken % max(r["size"], 1) == 0
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    for s, t in target.items():
        rows = by_target[sizes[s], round(t, 6)]
        assert abs(sum(r.taken for r in rows) - t) <= max(r["size"] for r in rows) * len([x for x in target if (sizes[x], target[x]) == (sizes[s], t)]) + 1e-6
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixture(frame(spark, docs).repartition(3)).collect()))


def test_rounding_over_many_levels_keeps_sums_and_expectations(spark):
    n = 3000
    rows = spark.range(n).selectExpr("cast(id as string) as key", "'s' as source", f"{n}L as n", "1 + id % 7 as size", "0.3D as p")
    out = mixing.rounded(rows, fan_in=8).collect()
    assert len(out) == n == len({r.key for r in out}) and {r.p for r in out} == {0.0, 1.0}
    due = sum(0.3 * (1 + i % 7) for i in range(n))
    assert abs(sum(r.p * r["size"] for r in out) - due) <= 7
    by_size = collections.Counter(r["size"] for r in out if r.p)
    assert all(abs(by_size[s] / (n / 7) - 0.3) < 0.08 for s in range(1, 8))


def test_mix_documents_repeats_rows(spark, docs):
    df = frame(spark, docs)
    taken = collections.Counter()
    for r in mixing.mixture(df).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mix_documents(df.withColumn("copies", F.lit("c")))
    assert mixed.columns == [*df.columns, "copies"]
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(words_of(r.text))
    assert words == collections.Counter({d: n for d, n in taken.items() if n})


def test_whole_cells_are_never_cut():
    import pyarrow as pa

    rng = random.Random(3)
    cells = sorted([(rng.randrange(40), rng.randrange(3)) for _ in range(2000)] + [(50, 0)] * 700)
    batches = [pa.record_batch([pa.array(x) for x in zip(*cells[i : i + 97])], names=["a", "b"]) for i in range(0, len(cells), 97)]
    for rows in (1, 100, 500, 10**6):
        tables = [list(zip(*(t.column(c).to_pylist() for c in "ab"))) for t in simhash.whole_cells(iter(batches), ["a", "b"], rows)]
        assert sum(tables, []) == cells
        assert all(x[-1] != y[0] for x, y in zip(tables, tables[1:]))
        assert all(len(x) <= rows + 97 + 700 for x in tables)
    assert list(simhash.whole_cells(iter([]), ["a"], 5)) == []


def test_many_rows_of_one_key_spread_over_blocks_and_chunks(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, 'one two three', concat('w', id, ' x y')) as text", "'s' as source").repartition(5)
    keys = mixing._numbered(mixing._rows(*mixing.by_place(df))).select("key")
    assert keys.distinct().count() == 3000
    got = mixing.mixture(df).groupBy("taken").count().collect()
    assert sum(r["count"] for r in got) == 3000 and abs(sum(r["count"] * r.taken for r in got) - 1.5 * 9000) <= 3
    out = substring.report(df)
    assert out.count() == 3000 and out.agg(F.sum("n_removed")).first()[0] == 0


def test_index_refuses_documents_at_or_below_its_greatest(spark, tmp_path):
    index = substring.WindowIndex(spark, f"file://{tmp_path}/index", 4)
    assert substring.report(frame(spark, [(5, "a b", "en", "s", 3)]), batches=1, index=index).count() == 1
    with pytest.raises(ValueError, match="not above"):
        substring.report(frame(spark, [(5, "a b", "en", "s", 3)]), batches=1, index=index)
    assert substring.report(frame(spark, [(6, "a b", "en", "s", 3)]), batches=1, index=index).count() == 1


def test_names_that_differ_in_case_alone(spark, docs):
    rows = [(*r[:4], "T", "x", "y") for r in docs if r[1] is None or len(r[1]) < 5000]
    df = frame(spark, rows, "doc_id long, text string, lang string, source string, TEXT string, Doc_ID string, `a.b` string")
    plain = df.toDF(*"abcdefg").select("a", "b", "c", "d").toDF("doc_id", "text", "lang", "source")
    for f in (simhash.simhash_duplicates, substring.report, quality.quality_report, mixing.mixture):
        assert sorted(map(repr, f(df).collect())) == sorted(map(repr, f(plain).collect()))
    for f in (simhash.dedup, near_copies.dedup, substring.dedup, quality.quality_filter, mixing.mix_documents):
        out = f(df)
        assert out.columns == df.columns
        got = collections.Counter((r[0], r[1], r[3]) for r in out.collect())
        assert got == collections.Counter((r[0], r[1], r[3]) for r in f(plain).collect())


def test_empty_tables(spark):
    none = frame(spark, [])
    for out in (simhash.simhash_duplicates(none), simhash.dedup(none), substring.report(none), substring.dedup(none), quality.quality_report(none), quality.quality_filter(none), mixing.mixture(none), mixing.mix_documents(none)):
        assert out.count() == 0
