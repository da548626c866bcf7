"""Token files, counts, pieces, pages, vectors, language model and the pipeline, against the libraries or brute force on small tables."""

import collections
import glob
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colonnade.llm import embeddings, html_text, language_model, pieces, registry, token_counts, token_files, units

DOCS = "doc_id long, text string"
STRANGE = ["", None, " ", "  two  spaces ", "a\n\n b\t c", "\x1c x \x85 y\xa0z", "<|endoftext|> in <|startoftext|>text", "don't I'll we've", "漢字 かな 😀 é é ​", "▁under ▁ line", "x" * 3000, "ÀÉ ñ ß İ ﬁ ½", "\r\n end \r", "0 12 345 #$%", "a" * 40 + " " * 40 + "b"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    alphabet = ["a", "Zq", " ", "  ", "\n", "é", "\xa0", "\x1c", "'s", " '", "12", "!?", "_", "ñ", "漢", "😀", " the", "ing "]
    out = STRANGE + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(150)]
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    return out + [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 300, 9000)] + ["hello world"] * 2


def frame(spark, texts):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(0, "again"), (0, "again")]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def test_token_files_hold_what_the_library_gives(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df, rows = frame(spark, texts)
    folder = f"file://{tmp_path}/files"
    got = token_files.token_files(df.withColumn("start", F.lit(1)), path, folder, seq_len=64, rows_per_batch=4).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
    for name in sorted(glob.glob(f"{tmp_path}/files/shard-*.arrow")):
        with pa.memory_map(name) as source:
            file = pa.ipc.open_file(source)
            assert file.schema.field("input_ids").type == pa.list_(pa.uint16(), 64) and file.schema.field("mask").type == pa.list_(pa.bool_(), 64)
            before = pa.total_allocated_bytes()
            rows_in = [file.get_batch(b).num_rows for b in range(file.num_record_batches)]
            ids = file.get_batch(0).column(0).flatten().to_numpy(zero_copy_only=True)
            assert pa.total_allocated_bytes() == before and not ids.flags.owndata
            assert all(n == 4 for n in rows_in[:-1])
        shard = token_files.Shard(folder, name.rsplit("/", 1)[1].removesuffix(".arrow"))
        n = sum(x[2] for part in shard.documents() for x in part)
        masks = [shard.sequence(r)[1] for r in range(sum(rows_in))]
        assert sum(map(sum, masks)) == n and all(len(m) == 64 for m in masks)
    open(f"{tmp_path}/files/shard-000000-99.arrow", "w").close()  # what a lost attempt left
    again = token_files.read_shards(spark, folder).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    units = token_files.token_files(df, path, f"file://{tmp_path}/units", seq_len=64, rows_per_batch=4, by_word=True).collect()
    assert sorted(map(repr, units)) == sorted(map(repr, got))


def test_units_split_nothing_that_belongs_together(texts):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    library, fast = Tokenizer.from_file(path), token_files.UnitEncoder(path)
    for _ in range(2):
        for t, ids in zip(texts, fast.encode(pa.array(texts, pa.string()))):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert fast.encode(pa.array([], pa.string())) == []
    assert [x.tolist() for x in fast.encode(pa.array(["no", "a b", None, "c  d"]).slice(1))] == [library.encode(t).ids for t in ("a b", "", "c  d")]
    fast.word.clear()
    assert fast.encode(pa.array(["hello world"]))[0].tolist() == library.encode("hello world").ids


def test_pieces_have_the_ids_of_their_units(texts, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    rng = random.Random(9)
    parts = ["a", "Zq", " ", "  ", "\n", "é", "à", "à ", "\xa0", "\x1c", "'s", " '", "'", "'ll", "12", "!?", "ñ", "漢", "。", "😀", " the", "ing ", "\x85", "\u2003", "½", "٣", "\u0301", "“", "â", "æ", ".", "..", " (", ")", '"', "-", "\t", "<|endoftext|>"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    mixed += ["".join(chr(rng.choice([32, 97, rng.randrange(256), rng.randrange(0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(500)]
    mixed += [t or "" for t in texts]
    spec = json.loads(open(path).read())
    crossing = {**spec, "model": {**spec["model"], "vocab": {c: i for i, c in enumerate([*token_files.BYTE_CHARS, ".a", "aĠ", "aĠa", "1a", "ĠĠ", "Ġa", "'s", "'sa"])}, "merges": [[".", "a"], ["a", "Ġ"], ["aĠ", "a"], ["1", "a"], ["Ġ", "Ġ"], ["Ġ", "a"], ["'", "s"], ["'s", "a"]]}}
    (tmp_path / "crossing.json").write_text(json.dumps(crossing))
    (tmp_path / "looks_up.json").write_text(json.dumps({**spec, "model": {**spec["model"], "ignore_merges": True}}))
    mixed += ["".join(rng.choice(["a", ".", " ", "1", "'s", "s", "\n"]) for _ in range(30)) for _ in range(1000)]
    for file in (path, str(tmp_path / "crossing.json")):
        library, own = Tokenizer.from_file(file), token_files.UnitEncoder(file, False, token_files.piece_pattern(file))
        for i in range(0, len(mixed), 500):
            block = mixed[i : i + 500]
            assert [x.tolist() for x in own.encode(pa.array(block))] == [e.ids for e in library.encode_batch_fast(block, add_special_tokens=False)]
    assert token_files.piece_pattern(str(tmp_path / "looks_up.json")) is None
    # a long run without blanks is not gone over from each place in it
    began, run = time.thread_time(), "abc.def," * 30_000 + "é"
    own = token_files.UnitEncoder(path, False, token_files.piece_pattern(path))
    assert own.encode(pa.array([run]))[0].tolist() == Tokenizer.from_file(path).encode(run, add_special_tokens=False).ids
    assert time.thread_time() - began < 15
    # a text goes to the library whole, which makes fewer strings of it
    prose = "It was, as they said (twice), the 3rd of May; nobody came. " * 50
    units = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(prose)
    own = token_files.encoder(path, False, token_files.piece_pattern(path)).library
    pieces = own.pre_tokenizer.pre_tokenize_str(prose)
    assert 10 * len(pieces) < len(units) and "".join(p for p, _ in pieces) == "".join(u for u, _ in units)


def odd_texts(texts):
    """Texts in which cuts are hard to find."""
    rng = random.Random(17)
    parts = ["a", "Zq", " ", "  ", "\n", "é", "à ", "\xa0", "\x1c", "'s", " '", "'", "'ll", "'re", "'l", "'v", "'S", "12", "!?", "ñ", "漢", "😀", " the", "ing ", "\x85", "\u2003", "\u3000", "½", "٣", "\u0301", "“", ".", " (", "\t", "\0", "ÿ", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "ΑΣ", "Ω", "ﬁ", "Ⱥ", "가", "e\u0301"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)]
    out += ["".join(chr(rng.choice([32, 39, 97, 115, rng.randrange(256), rng.randrange(0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(1000)]
    return out + ["".join(rng.choice(["a", "é", " ", "'", "s", "re", "1", ".", "\n"]) for _ in range(12)) for _ in range(4000)] + [t or "" for t in texts]


def test_marks_stand_where_units_begin(texts, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    spec = json.loads(open(path).read())
    crossing = {**spec, "model": {**spec["model"], "vocab": {c: i for i, c in enumerate([*token_files.BYTE_CHARS, ".a", "aĠ", "aĠa", "1a", "ĠĠ", "Ġa", "'s", "'sa"])}, "merges": [[".", "a"], ["a", "Ġ"], ["aĠ", "a"], ["1", "a"], ["Ġ", "Ġ"], ["Ġ", "a"], ["'", "s"], ["'s", "a"]]}}
    (tmp_path / "crossing.json").write_text(json.dumps(crossing))
    odd = odd_texts(texts)
    for file in (path, str(tmp_path / "crossing.json")):
        library, own = Tokenizer.from_file(file), token_files.UnitEncoder(file, False, kinds=units.kinds())
        for i in range(0, len(odd), 700):
            block = odd[i : i + 700]
            assert [x.tolist() for x in own.encode(pa.array([None, *block, ""]).slice(1))] == [e.ids for e in library.encode_batch_fast([*block, ""], add_special_tokens=False)]
    # where units begin is where the file's own pattern has them
    whole = [t for t in odd if t]
    data, cuts = units.text_bytes(pa.array(whole))
    begins = units.unit_starts(data, units.first_bytes(data, cuts), units.byte_kinds(data, units.unpacked(units.kinds())), True)
    library = Tokenizer.from_file(path)
    assert np.flatnonzero(begins).tolist() == [c + a for c, t in zip(cuts, whole) for a in np.cumsum([0] + [len(u) for u, _ in library.pre_tokenizer.pre_tokenize_str(t)])[:-1]]
    own = token_files.encoder(path, False, kinds=units.kinds())
    assert own.encode(pa.array([], pa.string())) == [] and [len(x) for x in own.encode(pa.array(["", None]))] == [0, 0]
    began, run = time.thread_time(), "abc.def," * 30_000 + "é"
    assert own.encode(pa.array([run]))[0].tolist() == library.encode(run, add_special_tokens=False).ids
    assert time.thread_time() - began < 15
    # no regular expression goes over a text
    assert own.by_mark is not None and json.loads(own.by_mark.to_str())["pre_tokenizer"]["type"] == "CharDelimiterSplit"


def test_sure_pairs_change_no_ids(tmp_path):
    import json

    from tokenizers import Tokenizer

    path, rng = registry.tokenizer_path("byte_bpe_50k.json"), random.Random(29)
    spec, letters = json.loads(open(path).read()), "abc .'s1é"
    names = list(dict.fromkeys(units.BYTE_CHARS[b] for b in letters.encode()))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(300)] + ["a" * n for n in range(9)]
    found = [0, 0]
    for k in range(120):
        tokens, merges = list(names), []
        for _ in range(rng.randrange(1, 40)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) < 8:
                tokens.append(a + b)
                merges.append([a, b])
        if k % 3 == 1:  # merges of parts that are made later
            rng.shuffle(merges)
        if k % 3 == 2:  # tokens made in two ways
            merges += [[t[0], t[1:]] for t in tokens if len(t) == 3 and t[1:] in tokens and [t[0], t[1:]] not in merges]
        vocab = dict.fromkeys([*units.BYTE_CHARS, *tokens])
        (tmp_path / "file.json").write_text(json.dumps({**spec, "added_tokens": [], "model": {**spec["model"], "vocab": {t: i for i, t in enumerate(vocab)}, "merges": merges}}))
        library, own = Tokenizer.from_file(str(tmp_path / "file.json")), token_files.UnitEncoder(str(tmp_path / "file.json"), False, kinds=units.kinds())
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)], merges
        found[own.pairs is not None] += own.pairs is None or len(own.pairs.characters())
    assert found[0] > 0 and found[1] > 100
    # a special string is not looked for in the characters that stand for bytes or pairs
    special = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    odd = [{"id": 50257 + i, "content": c, **special} for i, c in enumerate(("é", "Ā", "¡a"))]
    (tmp_path / "special.json").write_text(json.dumps({**spec, "added_tokens": [*spec["added_tokens"], *odd]}))
    library, own = Tokenizer.from_file(str(tmp_path / "special.json")), token_files.UnitEncoder(str(tmp_path / "special.json"), False, kinds=units.kinds())
    block = ["需要 the rain", "é", "aĀb needé", "cháat", "¡a", "<|endoftext|>"]
    assert [x.tolist() for x in own.encode(pa.array(block))] == [library.encode(t, add_special_tokens=False).ids for t in block]
    # prose has a good part of its bytes joined, in whole texts
    prose = ["It was, as they said (twice), the 3rd of May; nobody came. " * 5, "", "another thing"]
    data, cuts = units.text_bytes(pa.array(prose))
    got = units.marked(data, cuts, np.array([], np.int64), token_files.encoder(path, False, kinds=units.kinds()).pairs)
    assert len(got) == 3 and sum(map(len, got)) < 0.75 * len(data)
    apart = {c: chr(a) + chr(b) for c, a, b in token_files.encoder(path, False, kinds=units.kinds()).pairs.characters()}
    assert ["".join(apart.get(c, c) for c in x) for x in got] == prose


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df, rows = frame(spark, texts)
    got = collections.Counter(map(tuple, token_counts.token_counts(df, path, chunk_chars=500, overlap=16).collect()))
    counts = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for d, t in rows]
    assert got == collections.Counter((d, b, n, n > 2048) for d, b, n in counts)
    assert collections.Counter(map(tuple, token_counts.token_counts(df, path).collect())) == got
    assert collections.Counter(map(tuple, token_counts.token_counts(df, path, chunk_chars=500, overlap=16, by_word=True).collect())) == got
    other = registry.tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(other)
    assert token_counts._words(path) is not None and token_counts._words(other) is None
    assert collections.Counter(r.n_tokens for r in token_counts.token_counts(df, other, chunk_chars=500, overlap=16).collect()) == collections.Counter(len(plain.encode(t or "")) for _, t in rows)
    import sentencepiece

    model = registry.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert collections.Counter(r.n_tokens for r in token_counts.token_counts(df, model).collect()) == collections.Counter(len(sp.encode(t or "")) for _, t in rows)


def test_counts_by_mark_are_those_of_the_file(texts):
    import json

    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    library, tables = Tokenizer.from_file(path), token_counts.MarkedCounts.tables(path)
    own, odd = token_counts._marked(path, *tables), odd_texts(texts)
    for i in range(0, len(odd), 700):
        block = odd[i : i + 700]
        assert own.counts(pa.array([None, *block, ""]).slice(1)).tolist() == [len(e) for e in library.encode_batch_fast([*block, ""], add_special_tokens=False)]
    assert own.counts(pa.array([], pa.string())).tolist() == [] and own.counts(pa.array(["", None])).tolist() == [0, 0]
    # characters that count as lowered alone, between others
    alone = [chr(i) for i in np.flatnonzero(own.alone).tolist()]
    assert set("aÉß漢가٣½ \n\x85") < set(alone) and not {"\u0301", "Σ", "\u1161", "\u0958"} & set(alone)
    random.Random(4).shuffle(alone)
    for i in range(0, len(alone), 50_000):
        t = "".join(alone[i : i + 50_000])
        want = "".join(" " if own.kinds[ord(c)] == units.WHITE else c for c in t.lower()).split(" ")
        assert library.normalizer.normalize_str(t).strip(" ").split(" ") == [x for x in want if x]
    # only texts with other characters or special strings are left to the file as it is
    seen = []
    own = token_counts.MarkedCounts(path, *tables)
    own.library = type("Seen", (), {"encode_batch_fast": lambda self, texts, **k: [seen.extend(texts), [()] * len(texts)][1]})()
    own.counts(pa.array(["It's naïve, É! 漢字 5", "e\u0301", "<|endoftext|>", "<|ENDOFTEXT|>"]))
    assert seen == ["e\u0301", "<|endoftext|>"]
    assert all(token_counts.MarkedCounts.tables(registry.tokenizer_path(x)) is None for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_units_with_ends_stand_in_runs(texts, monkeypatch):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts.MarkedCounts(path, *token_counts.MarkedCounts.tables(path))
    # the library gets a whole text with a mark at each 64th unit, and some bytes in pairs, instead of a string for each unit
    prose = "It was, as they said (twice), the 3rd of May; nobody came. " * 30
    data = np.frombuffer(prose.lower().encode(), np.uint8)
    (given,), _ = own._in_units(data, np.array([0, len(data)]))
    pieces = own.by_mark.pre_tokenizer.pre_tokenize_str(given)
    n_units = len(library.pre_tokenizer.pre_tokenize_str(prose.lower()))
    assert len(pieces) == -(-n_units // 64) and len(given) < 0.7 * len(prose.replace(" ", ""))
    # places of tokens are the library's offsets
    for t in [t for t in odd_texts(texts)[:600] if t == t.lower() and not own._changing(np.frombuffer(t.encode(), np.uint8)).size and "<|" not in t] + [prose.lower(), "é漢字 " * 90]:
        e = library.encode(t, add_special_tokens=False)
        places, ids = own.starts(t)
        assert ids == e.ids and places.tolist() == [a for a, _ in e.offsets], t
    # long texts are not left to the file as it is, but for special strings and characters that may change; overlaps widen as there
    rng, seen = random.Random(5), []
    word = lambda: "".join(rng.choice("abCdeÉ漢'1!<İ") for _ in range(rng.randrange(1, 12)))
    long = [" ".join(word() for _ in range(800)), "X" * 5000, "ab" * 900 + " " + "Cd" * 900, " " * 3000, "a" + "\xa0" * 2000 + "b c d e f " * 200, "\n".join(word() for _ in range(500)), "It's 1 <|ENDOFTEXT|> " * 200]
    left = ["<|endoftext|>" * 300, "a\u0301 " * 900, "abc " * 900 + "e\u0301", "ΑΣ " * 700]
    monkeypatch.setattr(token_counts, "BLOCK", 1000)
    own.library = type("Seen", (), {"encode": lambda self, t, **k: [seen.append(t), library.encode(t, **k)][1]})()
    for texts_, by_file in ((long, False), (left, True)):
        for t in texts_:
            for chunk, overlap in ((300, 8), (700, 64), (50, 4)):
                seen.clear()
                assert own.count_huge(t, chunk, overlap) == len(library.encode(t, add_special_tokens=False).ids), (t[:30], chunk)
                assert bool(seen) == by_file, t[:30]


def test_ends_of_units_fit_other_files_or_are_left(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(registry.tokenizer_path("word_bpe_49k.json")).read())
    rng, letters, end = random.Random(31), "abc .'s1é</w>", "</w>"
    names = list(dict.fromkeys(units.BYTE_CHARS[b] for b in letters.replace(" ", "").encode()))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(300)] + ["a" * n for n in range(9)] + ["a</w>", "a</w> a", "ab " * 200]
    n_fit = n_pairs = 0
    for k in range(120):
        tokens, merges = [*names, *(c + end for c in names)], []
        made = {*units.BYTE_CHARS, *(c + end for c in units.BYTE_CHARS)}
        for _ in range(rng.randrange(1, 60)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in made and len((a + b).replace(end, "")) < 8 and (k % 4 == 2 or not a.endswith(end)):
                tokens.append(a + b)
                made.add(a + b)
                merges.append([a, b])
        if k % 4 == 1:  # merges of parts that are made later
            rng.shuffle(merges)
        if k % 4 == 3:  # a token written like a byte at the end of a unit
            merges = [["<", "/"], ["</", "w"], ["</w", ">"], ["a", "</w>"], *(m for m in merges if "<" not in m[0] + m[1])]
        vocab = dict.fromkeys([*units.BYTE_CHARS, *(c + end for c in units.BYTE_CHARS), *(a + b for a, b in merges)])
        path = str(tmp_path / f"file{k}.json")
        (tmp_path / f"file{k}.json").write_text(json.dumps({**spec, "added_tokens": [], "model": {**spec["model"], "vocab": {t: i for i, t in enumerate(vocab)}, "merges": merges}}))
        try:
            library = Tokenizer.from_file(path)
        except Exception:  # a part without a token
            continue
        tables = token_counts.MarkedCounts.tables(path)
        assert k % 4 or tables
        assert k % 4 != 3 or tables is None
        if tables:
            own = token_counts.MarkedCounts(path, *tables)
            assert own.counts(pa.array(texts)).tolist() == [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)], merges
            n_fit, n_pairs = n_fit + 1, n_pairs + len(own.pairs.characters())
    assert n_fit >= 30 and n_pairs > 30


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_overlaps_resynchronise_or_widen(name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.tokenizer_path(name))
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé漢'1!<") for _ in range(rng.randrange(1, 12)))
    cases = [" ".join(word() for _ in range(800)), "x" * 5000, "ab" * 900 + " " + "cd" * 900, " " * 3000, "a" + " " * 2000 + "b c d e f " * 200, "\n".join(word() for _ in range(500)), "<|endoftext|>" * 300, "one two " * 40 + "y" * 3000 + " three four" * 60]
    for t in cases:
        for chunk, overlap in ((300, 8), (700, 64), (50, 4)):
            assert token_counts.count_huge(library, t, chunk, overlap) == len(library.encode(t, add_special_tokens=False)), (t[:30], chunk)


def test_pieces_and_spans(spark, texts):
    import sentencepiece

    model = registry.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    df, rows = frame(spark, texts)
    by_text = collections.defaultdict(set)
    for d, t in rows:
        by_text[d].add(t or "")
    for r in pieces.encode_documents(df, model).collect():
        source = next(t for t in by_text[r.doc_id] if sp.encode(t) == r.ids)
        assert r.decoded == sp.decode(r.ids)
        raw = source.encode()
        assert "".join(raw[a:b].decode("utf-8", "surrogateescape") for a, b in zip(r.begins, r.ends)).encode("utf-8", "surrogateescape") == raw
        proto = sp.encode(source, return_type="proto").pieces
        for k, (a, b, i) in enumerate(zip(r.begins, r.ends, r.ids)):
            if not sp.is_byte(i) and "▁" not in source:
                assert (a, b) == (proto[k].begin, proto[k].end)
    got = collections.Counter(map(tuple, pieces.digests(df.withColumn("ids_sha256_", F.lit("x")), model).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == collections.Counter((d, len(i := sp.encode(t or "")), sha(",".join(map(str, i))), sha(sp.decode(i))) for d, t in rows)


@pytest.fixture(scope="module")
def mapped_models(tmp_path_factory):
    """The public model with the library's compiled character maps in place of its own, which is empty."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    out, folder = [], tmp_path_factory.mktemp("models")
    for rule, flags in (("nmt_nfkc", {}), ("nfkc", {"add_dummy_prefix": False}), ("nmt_nfkc_cf", {"apart": ["<sep>", "ﬁ½"]}), ("nfkc_cf", {"remove_extra_whitespaces": False}), ("nmt_nfkc", {"escape_whitespaces": False})):
        held, model = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
        held.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        with open(registry.tokenizer_path("piece_bpe_32k.model"), "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        spec.precompiled_charsmap, spec.name = held.normalizer_spec.precompiled_charsmap, rule
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = True
        for k, v in flags.items():
            if k != "apart":
                setattr(spec, k, v)
        for p in flags.get("apart", []):
            model.pieces.add(piece=p, score=0, type=4)
        out.append(f"{folder}/{len(out)}.model")
        with open(out[-1], "wb") as f:
            f.write(model.SerializeToString())
    return out


def test_every_text_goes_through_the_map(spark, texts, mapped_models):
    import sentencepiece

    rng = random.Random(11)
    alphabet = [*"abcdefghij klmno  PQ ", "é", "ﬁ", "½", "İ", "Ａ", "\u3000", "\xa0", "\u200b", "\t", "\n", "\r", "漢", "😀", "e\u0301", "ｶﾞ", "①", "\x07", "ŉ", "\x1f", "<sep>", "▁"]
    cases = [t or "" for t in texts if len(t or "") < 5000] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    cases += ["  lead", "trail  ", "   ", "\u200b", "a \u200b b", "ab<sep>", "xﬁ½ﬁ", "x ▁", "▁", "\x07ab", " \x07 a", "b\x07", "b \x07"]
    for path in [registry.tokenizer_path("piece_bpe_32k.model"), *mapped_models]:
        library, enc = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceEncoder(path)
        changed = 0
        for t in cases:
            ids, begins, ends = enc.encode_one(t)
            proto = library.encode(t, return_type="proto").pieces
            assert ids == [p.id for p in proto], (path, t)
            changed += enc.normalise(t)[0].decode().replace("▁", " ").strip() != t.replace("▁", " ").strip()
            if not any(enc.sizes[i] == 1 and library.is_byte(i) for i in ids):
                assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in proto], (path, t)
        assert (changed > 300) == (path in mapped_models)
    df, rows = frame(spark, cases[:100])
    library = sentencepiece.SentencePieceProcessor(model_file=mapped_models[0])
    got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode_documents(df.withColumn("ids", F.lit(1)), mapped_models[0]).collect())
    assert got == collections.Counter((d, tuple(i := library.encode(t or "")), library.decode(i)) for d, t in rows)


def double_array(entries):
    """A character map's trie of single-step nodes, laid out one node after another: for the reader's test."""
    units, at = {}, 256
    tree: dict = {}
    for k, v in entries.items():
        node = tree
        for c in k:
            node = node.setdefault(c, {})
        node["value"] = v
    queue = [(0, tree, 0)]
    while queue:
        place, node, label = queue.pop()
        base = at
        at += 256
        offset = place ^ base
        assert offset < 1 << 21
        units[place] = offset << 10 | label | ((1 << 8) if "value" in node else 0)
        if "value" in node:
            units[base] = node["value"] | 1 << 31
        for c, child in node.items():
            if c != "value":
                queue.append((base ^ c, child, c))
    return [units.get(i, 0) for i in range(at)]


def test_character_map_takes_the_longest_prefix():
    import struct

    texts = b"one\0two\0\0"
    units = double_array({b"a": 0, b"abc": 4, "é".encode(): 8})
    m = pieces.CharacterMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts)
    assert m.longest(b"abd", 0) == (1, b"one") and m.longest(b"xabcd", 1) == (3, b"two") and m.longest("é".encode(), 0) == (2, b"")
    assert m.longest(b"b", 0) is None and m.longest(b"", 0) is None
    enc = pieces.PieceEncoder(registry.tokenizer_path("piece_bpe_32k.model"))
    enc.map = m
    enc.begins = enc._starts()
    out, source = enc.normalise("xabé a")
    assert out == "▁xoneb▁one".encode() and source.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 5, 5, 5, 6, 6, 6, 7]


def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- <p>no</p> -->
    <div id="cookie-banner">We use cookies to make this site work for you, please agree to all of them.</div>
    <main><article class='post'><h1>The &amp; title</h1><p>First   paragraph<br>goes on with <b>bold</b> &lt;words&gt; and
    more of them.<p>As.</p><div class=ad>Buy this wonderful thing today and get another one for free.</div><p title="a > b">Second with <a href=x>a link</a> in it.</p>
    <form><label>Mail</label><input name=q><button>Send</button></form><ul><li>point one of the list in the text</li><li>point two of the list</li></ul></article>
    <aside><p>Other stories that you may like to read, with many words in them.</p></aside>
    <section class="comments"><h2>Comments</h2><p>I liked this article a lot, it was very good to read.</p></section></main>
    <footer>&copy; 2020 &middot; All rights</footer></body></html>"""
    want = ["The & title", "First paragraph goes on with bold <words> and more of them.", "As.", "Second with a link in it.", "point one of the list in the text", "point two of the list"]
    assert html_text.main_text(page) == "\n\n".join(want)
    plain = "<body><div><h2>A heading</h2>The text of a page without an article, <span class='share-link'>Share it</span><em>all</em> in one block of its own.</div><div>© 2021 Some company</div>"
    assert html_text.main_text(plain) == "A heading\n\nThe text of a page without an article, all in one block of its own."
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "just text"), (4, "x", "<p>open <b>bold"), (4, "x", "<p>open <b>bold"), (5, "y", "<" * 50 + "a b='"), (6, "z", "<div>" * 3000 + "deep text here")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, text string")
    got = collections.Counter(map(tuple, html_text.extract(df).collect()))
    assert got[1, "u", "\n\n".join(want), len("\n\n".join(want))] == 1 and got[2, None, "", 0] == 1 and got[3, "v", "", 0] == 1
    assert got[None, "w", "just text", 9] == 1 and got[4, "x", "open bold", 9] == 2 and got[6, "z", "deep text here", 14] == 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_names_of_wrappers_and_of_parts_of_lines_lose_no_article():
    words = "Some words in a long text that goes on, and on. " * 6
    inner = f"<h1>The big title</h1><p>{words}</p><p>As.</p><p>More words <span class='hljs-comment'>inner</span> <span class='search'>find</span> <em class='notice'>note</em> end.</p>"
    want = "\n\n".join(["The big title", words.strip(), "As.", "More words inner find note end."])
    menu, foot = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>", "<footer>&copy; 2020 Some company</footer>"
    for name in ("single post no-sidebar", "has-sidebar", "page comments-open", "home siteFooter", ""):
        for a, b in (("", ""), ("<div class='layout with-banner'>", "</div>"), ("<main><article>", "</article></main>"), ("<div id=has-sidebar><article class=post>", "</article></div>"), ("<form>", "</form>")):
            assert html_text.main_text(f"<body class='{name}'>{menu}{a}{inner}{b}{foot}") == want, (name, a)
    page = f"<body><article><h1>Title</h1><p>{words}</p><section class='related-work'><h2>Related work</h2><p>{words}</p></section></article><div class='siteFooter'>Who we are</div>{foot}"
    assert html_text.main_text(page) == "\n\n".join(["Title", words.strip(), "Related work", words.strip()])


def test_cut_agrees_better_than_a_threshold_on_generated_pages():
    from colonnade.llm.html_pages import generated

    weights, errors, alone, n, flips = html_text.classifier(), 0, 0, 0, 0
    for page, truth in generated(200, 99):
        blocks, elements = html_text.blocks_of(page)
        odds = html_text.features(blocks, elements) @ weights
        for b, keep, x in zip(blocks, html_text.label(blocks, odds), odds):
            errors += keep != (b.text in truth)
            alone += (x > 0) != (b.text in truth)
            flips += keep != (x > 0)
            n += 1
    assert flips > 5 and errors < alone and errors < 0.02 * n


def test_end_tags_without_a_partner_cost_no_walk():
    import time

    began = time.perf_counter()
    assert html_text.main_text("<div>" * 2000 + "<b><p>text here" + "</section>" * 40000 + "</i>" * 40000) == "text here"
    assert html_text.main_text("<i>" + "<b>" * 3000 + "x" + "<div>" + "<em>" * 3000 + "</i>" * 3000 + "</nothing" * 5) == "x"
    assert time.perf_counter() - began < 4


def test_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(1, 8)
        gain = [rng.randrange(-9, 10) for _ in range(n)]
        links = [(rng.randrange(n), rng.randrange(n), rng.randrange(6)) for _ in range(rng.randrange(10))]
        links = [x for x in links if x[0] != x[1]]

        def cost(side, gain=gain, links=links):
            return sum(max(0, -g) if s else max(0, g) for g, s in zip(gain, side)) + sum(c for i, j, c in links if side[i] != side[j])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(gain, links)) == best


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    centres = rng.normal(size=(30, 16))
    for i in range(400):
        v = centres[i % 30] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.6])
        rows.append((len(rows), [float(np.float32(x)) for x in v], i % 4))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [1.0, None] * 8, 1), (2004, rows[5][1], None), (None, rows[5][1], rows[5][2]), (2005, [1.0, 2.0], 1), (2006, [float("inf")] * 16, 1)]
    return rows


@pytest.mark.parametrize("options", [{"cell_size": 1000}, {"cell_size": 20, "block": 4096}, {"cell_size": 20, "block": 25}])
def test_vectors(spark, options):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_vectors(df.withColumn("cell", F.lit(1)), **options).collect()}
    assert len(got) == len(rows)
    good = [r for r in rows if r[0] is not None and (r[0] < 2000)]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & np.equal.outer([r[2] for r in good], [r[2] for r in good])
    np.fill_diagonal(near, False)
    labels = list(range(len(good)))
    for _ in labels:
        new = [min([labels[i], *(labels[j] for j in np.flatnonzero(near[i]))]) for i in range(len(good))]
        if new == labels:
            break
        labels = new
    links = sum(got[r[0]].n_links for r in good)
    assert links == near.sum() and all(got[r[0]].n_links == near[i].sum() for i, r in enumerate(good))
    for i, r in enumerate(good):
        assert got[r[0]].component_id == good[labels[i]][0] and got[r[0]].kept == (labels[i] == i)
    for r in rows:
        if r not in good:
            assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(df).count() == 0
    one = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embeddings.near_vectors(one).collect()] == [(1, 0, 1, True)]


def test_language_model(spark):
    rng = random.Random(8)
    after = {w: [rng.choice("abcdefghijklmnopqrst") * 2 for _ in range(3)] for w in (c * 2 for c in "abcdefghijklmnopqrst")}

    def text(n):
        w, out = "aa", []
        for _ in range(n):
            out.append(w if rng.random() < 0.8 else w.upper())
            w = rng.choice(after[w]) if rng.random() < 0.95 else "".join(rng.choice("xyz") for _ in range(5))
            w = w if w in after else rng.choice(list(after)) if rng.random() < 0.5 else w
            if w not in after:
                out.append(w)
                w = "bb"
        return " ".join(out)

    rows = [(i, text(rng.randrange(1, 120))) for i in range(300)] + [(301, None), (302, ""), (303, " \n"), (None, "aa bb"), (5, "aa cc"), (304, text(8000))]
    df = spark.createDataFrame(rows, DOCS)
    got = collections.Counter()
    scores = {}
    for r in language_model.language_scores(df.withColumn("block", F.lit(0)), head_words=16, classes=4, steps=60).collect():
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)] += 1
        scores.setdefault(r.doc_id, r)
    counts, held = collections.Counter(), lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    split = lambda t: [*(t or "").encode().lower().split(), None]
    for d, t in rows:
        if not held(d):
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t))
    assert got == collections.Counter((d, held(d), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(base(t), 6)) for d, t in rows)
    out = [r for r in scores.values() if r.held_out]
    assert len(out) > 10 and sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)
    assert language_model.language_scores(df.limit(0)).count() == 0
    held_only = language_model.language_scores(df.where("doc_id is null")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in held_only] == [(True, 0, 0)]


def test_scores_are_what_the_model_says(spark, monkeypatch):
    """Scores recomputed token by token from the trained numbers and from counts made here; probabilities of all words sum to one."""
    rng = random.Random(2)
    words = ["Ab", "ab", "cde", "f", "ghi", "é", "zz", "q1"] + [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words[: rng.randrange(2, 38)]) for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [(500, None), (501, "only here once")]
    found, train = {}, language_model.train
    monkeypatch.setattr(language_model, "train", lambda pairs, **k: found.setdefault("p", train(pairs, **k)))
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.score for r in language_model.language_scores(df, head_words=6, classes=3, prior=5.0, steps=20).collect()}
    split = lambda t: [*(t or "").encode().lower().split(), None]
    lines = [(d, split(t)) for d, t in rows]
    counts, pairs = collections.Counter(), collections.Counter()
    for d, w in lines:
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(w)
            pairs.update(zip([None, *w], w))
    vocabulary = [w for w in counts if w is not None]
    keys = dict(zip(vocabulary, language_model.word_hashes(vocabulary).tolist()))
    head = sorted(keys[w] for w in sorted(vocabulary, key=lambda w: (-counts[w], keys[w]))[:6])
    class_of = lambda w: zlib.crc32(w[-3:]) % 3
    symbol = lambda w: 0 if w is None else 4 + head.index(keys[w]) if keys.get(w) in head else 1 + class_of(w)
    table = language_model.log10_table(found["p"]).astype(float)
    tail = [w for w in vocabulary if symbol(w) <= 3]
    mass = {c: sum(counts[w] for w in tail if class_of(w) == c) + 0.1 * (sum(class_of(w) == c for w in tail) + 1) for c in range(3)}

    def smooth(c, w):
        p = 10 ** table[symbol(c), symbol(w)]
        return p if symbol(w) in (0, 4, 5, 6, 7, 8, 9) else p * (counts[w] + 0.1) / mass[class_of(w)]

    probability = lambda c, w: (pairs[c, w] + 5.0 * smooth(c, w)) / (counts[c] + 5.0)
    for d, w in lines:
        assert abs(got[d] - sum(math.log10(probability(c, x)) for c, x in zip([None, *w], w))) < 1e-3 * len(w), d
    for c in (None, b"ab", b"w7", b"never"):
        unknown = 5.0 * sum(10 ** table[symbol(c), 1 + k] * 0.1 / mass[k] for k in range(3)) / (counts[c] + 5.0)
        assert abs(sum(probability(c, w) for w in [None, *vocabulary]) + unknown - 1) < 1e-4


def test_counts_past_32_bits():
    keys, _, sums, answers = language_model.summed([np.array([3, 9], np.uint64), np.array([9], np.uint64)], [np.array([1, 3_000_000_000]), np.array([3_000_000_000])])
    assert keys.tolist() == [3, 9] and sums.tolist() == [1, 6_000_000_000] and [x.tolist() for x in answers] == [[1, 6_000_000_000], [6_000_000_000]]
    x = np.array([6_000_000_000, 0, 2**62], np.int64)
    assert language_model.unpacked(language_model.packed(x), 3, np.int64).tolist() == x.tolist() and language_model.unpacked(language_model.packed(x[:0]), 0, np.int64).tolist() == []


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    p = language_model.train(rng.integers(0, 50, (40, 40)).astype(np.float32), steps=30)
    assert np.allclose((10.0 ** language_model.log10_table(p).astype(float)).sum(axis=1), 1, atol=1e-4)


def test_trained_model_beats_its_start():
    rng = np.random.default_rng(4)
    p = np.zeros((30, 30))
    for i in range(30):
        p[i, [(i + 1) % 30, (i * 7) % 30]] = rng.integers(20, 400, 2)
    p += 0.5
    table = language_model.log10_table(language_model.train(p.astype(np.float32)))
    unigram = np.log10(p.sum(axis=0) / p.sum())
    assert (p * table).sum() / p.sum() > (p * unigram).sum() / p.sum() + 0.3


def test_pipeline(spark, tmp_path, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, state = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, state, sf_dir)
        assert out.columns == columns, name
        out.write.parquet(f"file://{tmp_path}/{name}")
        state = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen[name] = state.count()
    assert 0 < seen["substring_dedup"] == seen["near_dedup"] < seen["quality_rules"] < docs.count()
    final = corpus_pipeline.STAGES[-1][1](spark, state, sf_dir)
    assert final.count() == seen["mix"]
    run = corpus_pipeline.run(spark, sf_dir)
    assert collections.Counter(map(tuple, run.collect())) == collections.Counter(map(tuple, final.collect()))
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
