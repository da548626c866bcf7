"""Token counts of whole texts, with huge ones encoded in overlapping chunks.

A text of up to chunk_chars characters is one chunk: it goes to the library whole, lowered and with the ends of the usual pattern's units told if the file is of the usual kind (see MarkedCounts). With by_word, where the library's tokens never span white space, such texts
are counted by their distinct words instead, with the same result. A longer one is encoded in chunks that overlap; both encodings of an
overlap carry offsets. The chunks are spliced at a place where white space is followed by a visible character, where a
token of both encodings begins, and where the guard tokens before and after it are the same in both: there the library's pre-tokenisation
starts a new word whatever stands further off, so no token depends on what the other chunk lacks. Where an overlap has no such
place (one endless word, say) it is doubled, until the chunk reaches the end of the text.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from colonnade.llm import units
from colonnade.llm.common import WHITE, arrow_blocks, only

#: Words whose counts a worker keeps; the store is emptied when full, which bounds memory and changes speed alone.
CACHED_WORDS = 1_500_000


@lru_cache(maxsize=2)
def _load(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def _splice(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], low: int, high: int, guard: int) -> int | None:
    """Offset in [low, high) at which both encodings, as (start, id) of each token, may be joined; None if there is none."""
    at = {s: k for k, (s, _) in enumerate(right)}
    first = bisect_left(left, (low, -1))
    middle = (low + high) // 2
    found = [s for s, _ in left[first:] if low < s < high and text[s - 1] in WHITE and text[s] not in WHITE and s in at]
    for s in sorted(set(found), key=lambda s: abs(s - middle)):
        i, j = bisect_left(left, (s, -1)), at[s]
        while j and right[j - 1][0] == s:
            j -= 1
        if i < guard or j < guard or i + guard > len(left) or j + guard > len(right):
            continue
        if left[i - guard : i + guard] == right[j - guard : j + guard]:
            return s
    return None


def count_huge(library, text: str, chunk_chars: int, overlap: int, guard: int = 4, starts: Callable[[str], tuple[np.ndarray, list[int]]] | None = None) -> int:
    """Tokens of a long text by overlapping chunks; starts gives where each token of a chunk begins, and its id, in the library's stead."""

    def tokens(a: int, b: int) -> list[tuple[int, int]]:
        if starts is not None:
            places, ids = starts(text[a:b])
            return list(zip((places + a).tolist(), ids))
        e = library.encode(text[a:b], add_special_tokens=False)
        return [(s + a, i) for (s, _), i in zip(e.offsets, e.ids)]

    total, start = 0, 0  # start: tokens before this offset are counted
    end = min(len(text), chunk_chars)
    left, left_from = tokens(0, end), 0
    while end < len(text):
        wide = overlap
        while True:
            a = max(end - wide, left_from)
            b = min(len(text), a + max(chunk_chars, 2 * wide))
            right = tokens(a, b)
            at = _splice(text, left, right, max(a, start), end, guard)
            if at is not None or a == left_from:
                break
            wide *= 2
        if at is None:  # even the whole left chunk has no such place: it becomes longer instead
            end = min(len(text), 2 * end - left_from)
            left = tokens(left_from, end)
            continue
        total += bisect_left(left, (at, -1)) - bisect_left(left, (start, -1))
        left, left_from, start, end = right, a, at, b
    return total + len(left) - bisect_left(left, (start, -1))


class WordCounts:
    """Token counts of texts for a library whose tokens never hold or span white space, by encoding each distinct word once.

    Words to learn go to the library many at a time, with a special token of its own between them.
    """

    def __init__(self, library):
        self.library = library
        special = [(i, t.content) for i, t in library.get_added_tokens_decoder().items() if t.special]
        self.mark, self.text = special[0] if special else (None, None)
        self.known: dict[str, int] = {}

    @staticmethod
    def fits(library) -> bool:
        """Whether words end in a suffix of their own, and white space leaves no token."""
        return bool(getattr(library.model, "end_of_word_suffix", None)) and not library.encode(" \t\n\x0b\x0c\r a", add_special_tokens=False).ids[1:]

    def _learn(self, words: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            if self.text is not None and not any(self.text in w for w in part):
                ids = np.array(self.library.encode_batch_fast([f" {self.text} ".join(part)], add_special_tokens=False)[0].ids)
                at = np.flatnonzero(ids == self.mark)
                if len(at) == len(part) - 1:
                    out += (np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1).tolist()
                    continue
            out += [len(e) for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
        self.known.update(zip(words, out))
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        parts = pc.ascii_split_whitespace(texts)
        cuts = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        held = list(map(self.known.get, words))
        gaps = [i for i, x in enumerate(held) if x is None]
        for i, x in zip(gaps, self._learn([words[i] for i in gaps])):
            held[i] = x
        n = np.array(held, np.int64)[flat.indices.to_numpy()]
        return np.diff(np.concatenate([[0], np.cumsum(n)])[cuts - cuts[0]])


@lru_cache(maxsize=2)
def _words(path: str) -> WordCounts | None:
    library = _load(path)
    return WordCounts(library) if WordCounts.fits(library) else None


#: Units between marks: more make the library's merges of a run slower, fewer make it spend more on each run.
MARKED_UNITS = 64
#: Characters of a long text that are looked through at a time.
BLOCK = 1 << 18

#: What a file of the usual kind does to a text, and where it cuts it.
LOWERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class MarkedCounts:
    """Token counts of texts that the library has whole, lowered, with the end of each unit of the usual pattern told by the character of its last byte.

    The library spends most of its time on normalising each character with its place, on the pattern, on turning bytes, and on a string for each unit. Where each character of a text has
    but one lowered form whatever its neighbours (units.lowered_alone), str.lower() gives the same text, and the places come from its bytes (units.unit_starts). As no merge goes
    past the end of a unit (units.with_ends), units stand one after the other, with a mark at the first of each MARKED_UNITS. Pairs of bytes that the merges are sure to join first stand as one
    character (units.Pairs); all other merges are the library's. Texts with any other character, or with a special string, are encoded by the file as it is.
    """

    def __init__(self, path: str, kinds: bytes, alone: bytes):
        from tokenizers import Tokenizer

        self.library = _load(path)
        spec = json.loads(self.library.to_str())
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.kinds, self.alone = units.unpacked(kinds), units.unpacked(alone) > 0
        file, self.pairs = units.with_ends({**spec, "added_tokens": []})
        self.by_mark = Tokenizer.from_str(file)
        self.by_mark.model._resize_cache(0)  # runs of units seldom come again
        vocab = json.loads(file)["model"]["vocab"]
        #: Bytes of the token of each id.
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = max(self.sizes[i], len(token))

    @staticmethod
    def tables(path: str) -> tuple[bytes, bytes] | None:
        """What workers need, made on the driver; None if the file is of another kind."""
        if path.endswith(".model"):
            return None
        spec = json.loads(_load(path).to_str())
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        cut, *rest = split.get("pretokenizers") or [None]
        fit = spec.get("normalizer") == LOWERS and split.get("type") == "Sequence" and cut == CUTS and len(rest) == 1
        fit = fit and rest[0].get("type") == "ByteLevel" and rest[0].get("add_prefix_space") is False and rest[0].get("use_regex") is False
        fit = fit and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "unk_token", "byte_fallback", "ignore_merges"))
        fit = fit and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in spec["added_tokens"])
        if not fit or spec.get("post_processor") is not None or units.with_ends(spec, pairs=False) is None:
            return None
        alone = units.lowered_alone(json.dumps(LOWERS))
        return (units.kinds(), alone) if units.unpacked(alone)[:128].all() else None

    def counts(self, texts: pa.Array) -> np.ndarray:
        data, cuts = units.text_bytes(texts)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(cuts, self._changing(data), "right") - 1] = True
        raw, ends = data.tobytes(), cuts.tolist()
        spans = list(zip(ends, ends[1:]))
        if any(x in raw for x in self.special):
            odd |= [any(x in raw[a:b] for x in self.special) for a, b in spans]
        lowered = [b"" if o else raw[a:b].decode().lower().encode() for (a, b), o in zip(spans, odd.tolist())]
        data = np.frombuffer(b"".join(lowered), np.uint8)
        cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))])
        found = self.by_mark.encode_batch_fast(self._in_units(data, cuts)[0], add_special_tokens=False)
        n = np.fromiter(map(len, found), np.int64, len(found))
        if odd.any():
            n[odd] = [len(e) for e in self.library.encode_batch_fast([raw[a:b].decode() for (a, b), o in zip(spans, odd.tolist()) if o], add_special_tokens=False)]
        return n

    def count_huge(self, text: str, chunk_chars: int, overlap: int) -> int:
        """Tokens of a long text by overlapping chunks, lowered and by mark as well."""
        blocks = (np.frombuffer(text[i : i + BLOCK].encode(), np.uint8) for i in range(0, len(text), BLOCK))
        if any(x.decode() in text for x in self.special) or any(len(self._changing(x)) for x in blocks):
            return count_huge(self.library, text, chunk_chars, overlap)
        return count_huge(self.library, text.lower(), chunk_chars, overlap, starts=self.starts)

    def starts(self, lowered: str) -> tuple[np.ndarray, list[int]]:
        """The character in which each token of a lowered text begins, by the sizes of those before it, and its id."""
        data = np.frombuffer(lowered.encode(), np.uint8)
        texts, own = self._in_units(data, np.array([0, len(data)]))
        ids = self.by_mark.encode_batch_fast(texts, add_special_tokens=False)[0].ids
        sizes = self.sizes[np.array(ids, np.int64)]
        return np.cumsum((data & 0xC0) != 0x80)[own[np.cumsum(sizes) - sizes]] - 1, ids

    def _changing(self, data: np.ndarray) -> np.ndarray:
        """Places of characters whose form may hang on their neighbours."""
        at, _, point = units.code_points(data)
        return at[~self.alone[point]]

    def _in_units(self, data: np.ndarray, cuts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The texts of lowered bytes, end to end, as by_mark takes them, and the places of the bytes that are in units."""
        first = units.first_bytes(data, cuts)
        kind = units.byte_kinds(data, self.kinds)
        begins = units.unit_starts(data, first, kind, False)
        own = np.flatnonzero(kind != units.WHITE)
        symbols = data.astype(np.uint16)
        symbols[np.append(begins[1:], True)[: len(data)]] += units.END
        places = np.flatnonzero(begins.take(own))
        return units.marked(symbols.take(own), np.searchsorted(own, cuts), places[MARKED_UNITS::MARKED_UNITS], self.pairs), own


@lru_cache(maxsize=2)
def _marked(path: str, kinds: bytes, alone: bytes) -> MarkedCounts:
    return MarkedCounts(path, kinds, alone)


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048, chunk_chars: int = 16384, overlap: int = 512, by_word: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each document (doc_id, text). No exchange."""
    tables = None if by_word else MarkedCounts.tables(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _load(tokenizer)
        pieces = tokenizer.endswith(".model")
        words = _words(tokenizer) if by_word and not pieces else None
        marks = _marked(tokenizer, *tables) if tables else None
        for block in arrow_blocks(batches, 4_000_000 if words else 400_000):
            texts = pc.fill_null(block.column(1), "")
            huge = pc.greater(pc.utf8_length(texts), chunk_chars).to_numpy(zero_copy_only=False) & (not pieces)
            n = np.zeros(len(texts), np.int64)
            short = texts.filter(pa.array(~huge))
            if words:
                n[~huge] = words.counts(short)
            elif marks:
                n[~huge] = marks.counts(short)
            elif pieces:
                n[~huge] = [len(x) for x in library.encode(short.to_pylist(), num_threads=1)]
            else:
                n[~huge] = [len(e) for e in library.encode_batch_fast(short.to_pylist(), add_special_tokens=False)]
            for i in np.flatnonzero(huge).tolist():
                n[i] = marks.count_huge(texts[i].as_py(), chunk_chars, overlap) if marks else count_huge(library, texts[i].as_py(), chunk_chars, overlap)
            yield pa.record_batch([block.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return only(documents, "doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
