"""Token ids in Arrow files of fixed-size-list batches.

A shard holds the ids of a range of documents in ascending doc_id order, packed end to end into rows of seq_len ids.
Its file is an Arrow IPC file (the stream format with a footer), uncompressed, with the columns
``input_ids`` fixed_size_list<uint16 or uint32>[seq_len] and ``mask`` fixed_size_list<bool>[seq_len] (true on ids, false on
the padding of the last row). Every batch but the last has the same number of rows, so row r lies in batch r div rows_per_batch, and
id t of the shard is item t % seq_len of row t div seq_len: a memory-mapped reader reaches any sequence without copying.
A second file beside it lists (doc_id, start, n_tokens) of the shard's documents. Each attempt of a task writes files under names of its own,
nothing is renamed, and the manifest, written last, says which files hold the data: what a lost or speculative attempt left behind is never read.

Defined cases: a null or empty text has the end id alone; rows with one doc_id stay separate rows, next to each other in an
order fixed by their texts, and may lie in several shards; a null doc_id sorts first; a very long text is encoded in one piece, and its ids cross
batches as any do; an empty table gives no shard and no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import units
from colonnade.llm.common import arrow_blocks, new_path, only
from colonnade.llm.units import BYTE_CHARS

#: Encoded pieces of text that a worker keeps; the store is emptied when full, which bounds memory and changes speed alone.
CACHED_UNITS = 1_500_000
MANIFEST = "manifest.json"
#: Most units of a piece of a text (see piece_pattern): a string for each piece costs time, and so do long queues of merges.
PIECE_UNITS = 8
#: Most units between two marks of a text (see UnitEncoder._marked).
MARKED_UNITS = 64


def _visible(c: str) -> bool:
    return c.isalnum() or "!" <= c <= "~"


def _plain(word: str) -> bool:
    """Whether a space before the word, and one after it, are sure to be cuts."""
    return bool(word) and _visible(word[0]) and _visible(word[-1])


def _one_of(values) -> str:
    """A class of the characters of these bytes."""
    return _class(tuple(sorted(values)))


@lru_cache(maxsize=None)
def _class(values: tuple[int, ...]) -> str:
    points = np.unique([ord(BYTE_CHARS[b]) for b in values])
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "[" + "".join(f"\\x{{{x[0]:x}}}" + (f"-\\x{{{x[-1]:x}}}" if len(x) > 1 else "") for x in runs) + "]"


def _beyond_ascii(member: np.ndarray) -> str:
    """The members past ASCII, as sequences of the characters of their bytes."""
    tree: dict = {}
    blocks = member.reshape(-1, 64)
    for k in np.flatnonzero(blocks.any(axis=1)).tolist():
        if k >= 2:
            *lead, before, _ = chr(k * 64).encode("utf-8", "surrogatepass")
            at = tree
            for b in lead:
                at = at.setdefault(b, {})
            at[before] = _one_of((np.flatnonzero(blocks[k]) + 0x80).tolist())

    def pattern(at) -> str:
        if isinstance(at, str):
            return at
        alike: dict[str, list[int]] = {}
        for b, rest in at.items():
            alike.setdefault(pattern(rest), []).append(b)
        parts = [_one_of(bs) + rest for rest, bs in sorted(alike.items(), key=lambda x: min(x[1]))]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    by_size = [{b: x for b, x in tree.items() if lo <= b < hi} for lo, hi in ((0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5))]
    return "|".join(f"(?={_one_of(x)}){pattern(x)}" for x in by_size if x)


@lru_cache(maxsize=2)
def markable(path: str) -> bool:
    """Whether the file is fit for pieces of several units: the usual pattern, and merges alone make its tokens, from a token for each byte."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    spec = json.loads(library.to_str())
    model = spec["model"]
    vocab = model.get("vocab") or {}
    if not UnitEncoder.fits(library) or any(model.get(k) for k in ("unk_token", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    return all(c in vocab for c in BYTE_CHARS) and units.relabelled(spec) is not None


@lru_cache(maxsize=2)
def piece_pattern(path: str) -> str | None:
    """Pattern, over the characters of bytes, of pieces of a text that have the same ids as the units of the usual pattern in them, one after the other; None if the file is not fit for it.

    The usual pattern cuts a text into units: a word with its leading space, a number, a run of signs, white space. The library spends more
    than half its time on making a string of each and on turning that into characters of bytes. Here the text is turned at once, and a piece is a run of
    up to PIECE_UNITS units (a run of plain characters between blanks counts as one) where no token of the model has the last byte of a unit followed by the first of the next. Whatever merges make is a
    token, so none crosses such a place, and merges on its two sides, done by rank, go on as if they were alone. Any other place, and both ends of white space, are cuts as before.
    """
    from tokenizers import Tokenizer

    if not markable(path):
        return None
    vocab = json.loads(Tokenizer.from_file(path).to_str())["model"]["vocab"]
    byte_of = {c: b for b, c in enumerate(BYTE_CHARS)}
    after: list[set[int]] = [set() for _ in range(256)]
    for token in vocab:
        raw = [byte_of.get(c) for c in token]
        for a, b in zip(raw, raw[1:]):
            if a is not None and b is not None:
                after[a].add(b)
    letter, number, white = map(units.members, (r"\p{L}", r"\p{N}", r"\s"))
    other = ~(letter | number | white)
    other[0xD800:0xE000] = False
    ascii_of = [set(np.flatnonzero(m[:128]).tolist()) for m in (letter, number, other)]
    joints = []
    for last in (*ascii_of, set(range(0x80, 0xC0))):
        unlike = {32}.union(*(x for x in ascii_of[: 2 if last is ascii_of[2] else 3] if x is not last))
        last = [b for b in last if not after[b] & unlike]
        following = set().union(*(after[b] for b in last))
        if last:
            joints.append(f"(?<={_one_of(last)})" + (f"(?!{_one_of(following)})" if following else ""))
    space, blank = BYTE_CHARS[32], f"(?:{_one_of(np.flatnonzero(white[:128]).tolist())}|{_beyond_ascii(white)})"
    words, numbers, signs = (f"{space}?(?:{_one_of(x)}++|{_beyond_ascii(m)})++" for x, m in zip(ascii_of, (letter, number, other)))
    cut = [f"(?:{'|'.join([chr(92) + 'G', *joints])})(?>{words}|'s|'t|'re|'ve|'m|'ll|'d|{numbers}|{signs})"]
    # what stands between blanks, if it is of plain characters: its units need not be told apart, as all places between them are such; at most 64, or a long
    # run before an odd character would be gone over again from each place in it
    kind = {b: k for k, x in enumerate(ascii_of) for b in x if 33 <= b < 127 and b != 39}
    plain = {a for a, k in kind.items() if 32 not in after[a] and not any(kind.get(b, k) != k for b in after[a])}
    plain -= {b for a in kind for b in after[a] if kind.get(b, kind[a]) != kind[a]}
    if plain:
        ends = [b for b in range(256) if 32 in after[b]]
        before = rf"(?:\G|{f'(?<!{_one_of(ends)})' if ends else ''}(?={space}))"
        cut.insert(0, rf"{before}{space}?(?>{_one_of(plain)}{{1,64}})(?={_one_of(np.flatnonzero(white[:128]).tolist())}|\z)")
    return rf"(?:{'|'.join(cut)}){{1,{PIECE_UNITS}}}|{blank}+(?={blank}|\z)|{blank}++"


class UnitEncoder:
    """Ids of texts, each encoded whole by the library, or, with by_word, by encoding each distinct unit of text once.

    Byte-level pre-tokenisation lets no token span the place before a single space that stands between two visible
    characters. So a text is cut there, each distinct unit goes to the tokenizers library once, and its ids are joined.
    Where either neighbour of the space is not surely visible (not alphanumeric, not printable ASCII), units stay together.
    A file of another kind (see fits) has its texts encoded whole. Of a text encoded whole, the library makes pieces by marks put in it (see _marked) if there is
    a table of kinds, by a given pattern (see piece_pattern) if there is one, or by the file's own pre-tokenizer.
    """

    def __init__(self, path: str, by_word: bool = True, pieces: str | None = None, kinds: bytes | None = None, pairs: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_word = by_word and self.fits(self.library)
        if pieces is not None and not self.by_word:
            to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.library.pre_tokenizer = pre_tokenizers.Sequence([to_bytes, pre_tokenizers.Split(Regex(pieces), "isolated")])
            self.library.model._resize_cache(0)  # pieces seldom come again
        self.by_mark = None
        if kinds is not None and not self.by_word:
            spec = json.loads(self.library.to_str())
            self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
            self.kinds, self.neighbours = units.unpacked(kinds), units.neighbours(spec["model"]["vocab"])
            self.pairs = units.Pairs.of(spec) if pairs else None
            self.by_mark = Tokenizer.from_str(units.relabelled({**spec, "added_tokens": []}, self.pairs))
            self.by_mark.model._resize_cache(0)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.opens = np.zeros(size, bool)
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        #: Ids, as bytes, of a word after a single space.
        self.word: dict[str, bytes] = {}

    @staticmethod
    def fits(library) -> bool:
        """Whether the file is a byte-level BPE that leaves the text as it is, splits it by the usual pattern, and has no special string with white space or greed for it."""
        spec = json.loads(library.to_str())
        split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 or t["content"].strip() != t["content"] for t in spec.get("added_tokens", []))

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct plain words as they are after a space; they are kept."""
        out: list[bytes] = []
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(part) and starts[0] == 0:
                raw, cuts = ids.tobytes(), (np.append(starts, len(ids)) * self.dtype.itemsize).tolist()
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += self._each([" " + w for w in part])
        self.word.update(zip(words, out))
        return out

    def _each(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def _odd(self, parts: list[str]) -> bytes:
        """A text with spaces that may be no cuts: what stands around them stays one unit."""
        units, was_visible = [], False
        for k, p in enumerate(parts):
            if k and was_visible and p and _visible(p[0]):
                units.append(" " + p)
            elif k:
                units[-1] += " " + p
            else:
                units.append(p)
            was_visible = bool(p) and _visible(p[-1])
        return b"".join(self._each(units))

    def _marked(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts that the library has whole, with a mark at the first of each MARKED_UNITS units, and wherever a token of the model has the two bytes
        beside the place where a unit begins next to each other. Across any other such place no merge can go (see piece_pattern). Pairs of bytes that the merges are sure to join
        first stand as one character (see units.Pairs), which spares the library about half of its merges. A text that holds a special string is encoded by the file as it is."""
        data, cuts = units.text_bytes(texts)
        if not len(data):
            return [np.empty(0, self.dtype) for _ in range(len(texts))]
        first = units.first_bytes(data, cuts)
        begins = np.flatnonzero(units.unit_starts(data, first, units.byte_kinds(data, self.kinds), True))
        cut = self.neighbours[data[begins - 1], data[begins]]
        cut[::MARKED_UNITS] = True
        found = self.by_mark.encode_batch_fast(units.marked(data, cuts, begins[cut & ~first[begins]], self.pairs), add_special_tokens=False)
        raw = data.tobytes()
        if any(x in raw for x in self.special):
            ends = cuts.tolist()
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                if any(x in raw[a:b] for x in self.special):
                    found[i] = self.library.encode(raw[a:b].decode(), add_special_tokens=False)
        return [np.frombuffer(array("I", e.ids), np.uint32).astype(self.dtype) for e in found]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none. Arrow finds the distinct words, so Python handles each once a call."""
        if self.by_mark is not None:
            return self._marked(texts)
        if not self.by_word:
            found = self.library.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return [np.fromiter(e.ids, self.dtype, len(e)) for e in found]
        if len(self.word) > CACHED_UNITS:
            self.word.clear()
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        cuts = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        cuts -= cuts[0]
        words, place = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        held = list(map(self.word.get, words))
        gaps = [i for i, x in enumerate(held) if x is None]
        odd = [i for i in gaps if not _plain(words[i])]  # texts with such words are encoded on their own, below
        for i in odd:
            held[i] = b""
        gaps = [i for i in gaps if held[i] is None]
        for i, x in zip(gaps, self._learn([words[i] for i in gaps])):
            held[i] = x
        opening = flat.dictionary.take(pa.array(place[cuts[:-1]])).to_pylist()
        held += self._each(opening)
        # held: ids of each distinct word, then of each text's first word, which no space precedes
        size = self.dtype.itemsize
        pool = np.frombuffer(b"".join(held), self.dtype)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // size
        starts = np.cumsum(sizes) - sizes
        place = place.astype(np.int64)
        strange = np.zeros(len(words), bool)
        strange[odd] = True
        inner = strange[place]
        inner[cuts[:-1]] = False
        alone = np.add.reduceat(inner, cuts[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        alone |= np.array([n > 1 and not (w and _visible(w[-1])) for w, n in zip(opening, np.diff(cuts))], bool)
        place[cuts[:-1]] = len(words) + np.arange(len(texts))
        n = sizes[place]
        ends = np.cumsum(n)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[place] - (ends - n), n)]
        ends = np.concatenate([[0], ends])[cuts].tolist()
        out = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(alone).tolist():
            out[i] = np.frombuffer(self._odd(texts[i].as_py().split(" ")), self.dtype)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool, pieces: str | None = None, kinds: bytes | None = None) -> UnitEncoder:
    return UnitEncoder(path, by_word, pieces, kinds)


@cache
def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Packs documents into rows of seq_len ids, in files that bear the attempt's name."""

    def __init__(self, folder: str, shard: int, attempt: str, dtype, seq_len: int, rows_per_batch: int):
        self.fs, root = _fs(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"shard-{shard:06d}-{attempt}"
        self.seq_len, self.take = seq_len, seq_len * rows_per_batch
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.kind, self.dtype = kind, dtype
        self.schema = pa.schema([("input_ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(f"{root}/{self.name}.arrow")
        self.index_out = self.fs.open_output_stream(f"{root}/{self.name}.index")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.index = pa.ipc.new_file(self.index_out, self.index_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.docs: list[tuple] = []
        self.n_docs = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, len(ids)))
        self.held.append(ids)
        self.n += len(ids)
        self.n_held += len(ids)
        self.n_docs += 1
        if self.n_held >= self.take:
            self._rows(False)
        if len(self.docs) >= 65536:
            self._docs()

    def _rows(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        full = len(ids) // self.take * self.take
        for i in range(0, full, self.take):
            self._batch(ids[i : i + self.take], self.take)
        rest = ids[full:]
        if last and len(rest):
            self._batch(rest, -(-len(rest) // self.seq_len) * self.seq_len)
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)

    def _batch(self, ids: np.ndarray, size: int) -> None:
        values, mask = np.zeros(size, self.dtype), np.zeros(size, bool)
        values[: len(ids)], mask[: len(ids)] = ids, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (values, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def _docs(self) -> None:
        columns = zip(*self.docs) if self.docs else ([], [], [])
        self.index.write_batch(pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], schema=self.index_schema))
        self.docs = []

    def close(self) -> None:
        self._rows(True)
        self._docs()
        for w, o in ((self.writer, self.out), (self.index, self.index_out)):
            w.close()
            o.close()


def write_shards(documents: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2, seq_len: int = 2048, rows_per_batch: int = 64, by_word: bool = False) -> list[tuple[str, int, int]]:
    """Writes all documents (doc_id, text) as shards under folder; returns (name, documents, ids) of each, in doc_id order.

    One range exchange on doc_id (and the text's hash, which splits a repeated id) deals the texts out; each task then encodes and writes
    its own shard. Texts go to the library whole; by_word sends each distinct unit of text once a worker instead, which gives the same ids in less time.
    The list that comes back, which is also the manifest, has a row for each shard, not for each document.
    """
    spark, kinds = documents.sparkSession, units.kinds() if not by_word and markable(tokenizer) else None
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = only(documents, "doc_id", "text").repartitionByRange(n, *by[:2]).sortWithinPartitions(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, enc, task = None, encoder(tokenizer, by_word, kinds=kinds), TaskContext.get()
        end = np.array([] if end_id is None else [end_id], enc.dtype)
        for block in arrow_blocks(batches, 4_000_000 if enc.by_word else 400_000):
            if writer is None:
                writer = ShardWriter(folder, task.partitionId(), f"{task.taskAttemptId()}", enc.dtype, seq_len, rows_per_batch)
            for d, ids in zip(block.column(0).to_pylist(), enc.encode(block.column(1))):
                writer.add(d, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([writer.name]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n], pa.int64())], names=["shard", "n_docs", "n_ids"])

    shards = sorted(tuple(r) for r in dealt.mapInArrow(write, "shard string, n_docs long, n_ids long").collect())
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps({"seq_len": seq_len, "rows_per_batch": rows_per_batch, "shards": shards}).encode())
    return shards


def manifest(folder: str) -> list[tuple[str, int, int]]:
    """What write_shards returned, of a folder that it has finished."""
    fs, root = _fs(folder)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as held:
        return [tuple(x) for x in json.loads(held.read())["shards"]]


class Shard:
    """Random access to a shard; a local file is memory-mapped and its ids are views, not copies."""

    def __init__(self, folder: str, shard: str):
        fs, root = _fs(folder)
        name = f"{root}/{shard}"
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(name + ".arrow") if local else fs.open_input_file(name + ".arrow"))
        self.index = pa.ipc.open_file(pa.memory_map(name + ".index") if local else fs.open_input_file(name + ".index"))
        self.seq_len = self.file.schema.field("input_ids").type.list_size
        self.n_batches = self.file.num_record_batches
        self._at: tuple[int, np.ndarray] | None = None
        self.rows_per_batch = self.file.get_batch(0).num_rows if self.n_batches else 1

    def batch_ids(self, b: int) -> np.ndarray:
        if self._at is None or self._at[0] != b:
            self._at = b, self.file.get_batch(b).column(0).flatten().to_numpy(zero_copy_only=True)
        return self._at[1]

    def sequence(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Row r: its ids and its mask."""
        b, k = divmod(r, self.rows_per_batch)
        mask = self.file.get_batch(b).column(1).slice(k, 1).flatten().to_numpy(zero_copy_only=False)
        return self.batch_ids(b)[k * self.seq_len : (k + 1) * self.seq_len], mask

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids start to start + n of the shard, in pieces that each lie in one batch."""
        size = self.rows_per_batch * self.seq_len
        while n > 0:
            b, k = divmod(start, size)
            got = self.batch_ids(b)[k : k + n]
            yield got
            start, n = start + len(got), n - len(got)

    def documents(self) -> Iterator[list[tuple]]:
        """(doc_id, start, n_tokens) of its documents, in lists of bounded length."""
        for i in range(self.index.num_record_batches):
            yield list(zip(*(c.to_pylist() for c in self.index.get_batch(i).columns)))


def read_shards(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Reads the files: doc_id, start, n_tokens, ids_crc32 of each document, with start counted over all shards (those of the manifest if none are given)."""
    before, rows = 0, []
    for shard, _, n in manifest(folder) if shards is None else shards:
        rows.append((shard, before))
        before += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns)):
                held = Shard(folder, shard)
                for part in held.documents():
                    out = []
                    for doc_id, start, n in part:
                        crc = 0
                        for ids in held.ids(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        out.append((doc_id, base + start, n, crc))
                    yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "shard string, base long")
    return listed.mapInArrow(read, schema)


def token_files(documents: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes documents as token files and returns what the files hold, a row for each document."""
    spark = documents.sparkSession
    folder = folder or new_path(spark, "token-files")
    return read_shards(spark, folder, write_shards(documents, tokenizer, folder, **options))
