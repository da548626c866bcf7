"""Where the usual patterns of byte-level files cut texts into units, found over the bytes of many texts at once.

The library's own pre-tokenisation is a regular expression gone over for each text, a string for each unit, and a turning of each into characters of bytes,
which together cost more than the merges. Here the places of the cuts come from the bytes of a block of texts, by tables of what the library's own
regular expressions take for letters, numbers and white space. The library then gets every text whole, with a mark at the places where it is to be cut, and
makes its merges. So that bytes need no turning, its model is written with the character of the same number for each byte (relabelled). Two bytes whose merge is sure,
whatever the rest of the text does, may be given as one character of their own (Pairs). In a file whose units end in a suffix, the last byte of a unit has another character than
the same byte elsewhere (with_ends), and units need no mark between them.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The character that byte-level files write for each byte.
BYTE_CHARS = [chr(b) for b in range(256)]
for _n, _b in enumerate([*range(33), *range(127, 161), 173]):
    BYTE_CHARS[_b] = chr(256 + _n)
#: What stands at a cut: a byte that no text in UTF-8 holds.
MARK = 0xFF
#: What is added to the last byte of a unit, where units end in a suffix.
END = 0x100
WHITE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=4)
def members(category: str) -> np.ndarray:
    """Which code points the library's own regular expressions take for members of a category (that U+0000 is not in)."""
    from tokenizers import Regex, normalizers

    out, blank = np.zeros(0x110000, bool), normalizers.Replace(Regex(category), "\0")
    for plane in range(0, 0x110000, 0x10000):
        points = np.arange(plane, plane + 0x10000)
        points = points[(points < 0xD800) | (points >= 0xE000)]
        left = blank.normalize_str(points.astype("<u4").tobytes().decode("utf-32-le"))
        out[points] = np.frombuffer(left.encode("utf-32-le"), "<u4") == 0
    out[0] = False
    return out


@lru_cache(maxsize=1)
def kinds() -> bytes:
    """The kind of each code point, packed: 2 CPU seconds, so made on the driver once and sent to workers."""
    out = np.full(0x110000, OTHER, np.uint8)
    for k, category in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        out[members(category)] = k
    return zlib.compress(out.tobytes())


@lru_cache(maxsize=2)
def unpacked(table: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.uint8)


def relabelled(spec: dict, pairs: Pairs | None = None) -> str | None:
    """A byte-level BPE file (as the library writes it) without normalizer, with chr(b) for each byte b, the characters of pairs, and cuts at marks alone; None if its tokens hold other characters."""
    model, to = spec["model"], {ord(c): chr(b) for b, c in enumerate(BYTE_CHARS)}
    if any(ord(c) not in to for t in model["vocab"] for c in t):
        return None
    merges = [[x.translate(to) for x in m] for m in split_merges(model)]
    return _cut_at_marks(spec, {t.translate(to): i for t, i in model["vocab"].items()}, merges, pairs)


def with_ends(spec: dict, pairs: bool = True) -> tuple[str, Pairs | None] | None:
    """The same of a file whose units end in a suffix, with chr(END + b) for the last byte b of a unit instead of the suffix, and its pairs.

    No left part of a merge holds the suffix, so no merge goes past the end of a unit: units may stand one after the other, and merges of each, done by rank, go on as if it
    were alone. None if that does not hold, if a token is made in two ways (one written like a byte's with the suffix, say) or before its parts, or if the vocabulary is not that of bytes and merges.
    """
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    name = {c: chr(b) for b, c in enumerate(BYTE_CHARS)} | {c + suffix: chr(END + b) for b, c in enumerate(BYTE_CHARS)}
    merges = split_merges(model)
    for a, b in merges:
        if a not in name or b not in name or a + b in name or ord(name[a][-1]) >= END:
            return None
        name[a + b] = name[a] + name[b]
    if name.keys() != model["vocab"].keys():
        return None
    merges = [(name[a], name[b]) for a, b in merges]
    sure = Pairs.among(merges, 2 * END) if pairs else None
    return _cut_at_marks({**spec, "model": {**model, "end_of_word_suffix": None}}, {name[t]: i for t, i in model["vocab"].items()}, merges, sure), sure


def split_merges(model: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]


def _cut_at_marks(spec: dict, vocab: dict[str, int], merges: list, pairs: Pairs | None) -> str:
    if pairs is not None:
        vocab = vocab | {c: vocab[chr(a) + chr(b)] for c, a, b in pairs.characters()}
    cut = {"type": "CharDelimiterSplit", "delimiter": chr(MARK)}
    return json.dumps({**spec, "normalizer": None, "pre_tokenizer": cut, "post_processor": None, "decoder": None, "model": {**spec["model"], "vocab": vocab, "merges": merges}})


class Pairs:
    """Pairs of bytes that the merges of a byte-level BPE join before anything else can touch either, in any text where they stand between given bytes.

    Merges go by rank. Let r be the rank of (a, b). Until a and b are joined, a can only be the right part of a merge whose left part ends in the byte before it, and b the left
    part of one whose right part begins with the byte after it. If all such merges have ranks above r, none comes before that of a and b. And if all merges with ab as a part have ranks above r as well,
    none of them would have come before r: joined from the start, the text has the same other merges in the same order. Every token must be made by one merge, as the library tells queued merges by their token.
    """

    #: No such merge.
    NONE = 0xFFFF

    def __init__(self, ranks: np.ndarray, left: np.ndarray, right: np.ndarray, letters: int = 256):
        self.letters, self.shift = letters, letters.bit_length() - 1
        at = np.flatnonzero(ranks < self.NONE)
        at = at[np.argsort(ranks[at])][: 0xD800 - letters]  # below the surrogates, the first in the shortest characters
        character = np.zeros(letters * letters, np.uint16)
        character[at] = letters + np.arange(len(at))
        #: At letters * a + b: the rank of (a, b), the least of a merge of what ends in a with b, the least of one of a with what begins with b, and the character of ab.
        self.ranks, self.left, self.right = (np.minimum(x, self.NONE).astype(np.uint16) for x in (np.where(character > 0, ranks, self.NONE), left, right))
        self.character = character

    @classmethod
    def of(cls, spec: dict) -> Pairs | None:
        """Those of a file (as the library writes it); None if a token is made by several merges, or holds other characters."""
        to = {ord(c): chr(b) for b, c in enumerate(BYTE_CHARS)}
        rank = {m: r for r, m in enumerate(split_merges(spec["model"]))}
        if len({a + b for a, b in rank}) < len(rank) or any(ord(c) not in to for m in rank for t in m for c in t):
            return None
        return cls._ranked({(a.translate(to), b.translate(to)): r for (a, b), r in rank.items()}, 256)

    @classmethod
    def among(cls, merges: list[tuple[str, str]], letters: int) -> Pairs:
        """Those of merges, in order and each of another token, of texts in chr(0) to chr(letters - 1)."""
        return cls._ranked({m: r for r, m in enumerate(merges)}, letters)

    @classmethod
    def _ranked(cls, rank: dict[tuple[str, str], int], letters: int) -> Pairs:
        least: dict[str, int] = {}  # rank of a merge that has the token as a part
        ranks, left, right = (np.full(letters * letters, cls.NONE, np.int64) for _ in range(3))
        for (a, b), r in rank.items():
            least[a], least[b] = min(r, least.get(a, r)), min(r, least.get(b, r))
            at = ord(a[-1]) * letters + ord(b[0])
            if len(b) == 1:
                left[at] = min(left[at], r)
            if len(a) == 1:
                right[at] = min(right[at], r)
        for (a, b), r in rank.items():
            if len(a) == len(b) == 1 and r < least.get(a + b, cls.NONE) and chr(MARK) not in (a, b):
                ranks[ord(a) * letters + ord(b)] = min(r, cls.NONE)
        return cls(ranks, left, right, letters)

    def characters(self) -> list[tuple[str, int, int]]:
        """(character, a, b) of each pair that has one."""
        return [(chr(self.character[at]), at >> self.shift, at & (self.letters - 1)) for at in np.flatnonzero(self.character).tolist()]

    def joined(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts end to end, as characters with the sure pairs as one, and where each text begins, with the end of the last."""
        out = data.astype(np.uint16)
        if len(data) < 2:
            return out, ends
        at = out[:-1].astype(np.intp)
        at <<= self.shift
        at |= out[1:]
        rank, left, right = (x.take(at, mode="wrap") for x in (self.ranks, self.left, self.right))
        sure = rank < self.NONE
        sure[1:] &= rank[1:] < left[:-1]
        sure[:-1] &= rank[:-1] < right[1:]
        sure[ends[(ends > 0) & (ends < len(data))] - 1] = False
        sure = np.flatnonzero(sure)  # places are taken, not masks: a mask without order costs several times as much
        out[sure] = self.character.take(at.take(sure))
        sure += 1
        own = np.ones(len(data), bool)
        own[sure] = False
        return out.take(np.flatnonzero(own)), ends - np.searchsorted(sure, ends)


def neighbours(vocab) -> np.ndarray:
    """[a, b]: whether a token has byte b next after byte a."""
    out, byte_of = np.zeros((256, 256), bool), {c: b for b, c in enumerate(BYTE_CHARS)}
    for token in vocab:
        raw = [byte_of.get(c) for c in token]
        for a, b in zip(raw, raw[1:]):
            if a is not None and b is not None:
                out[a, b] = True
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins, with the end of the last; a null text has none."""
    held = pc.fill_null(texts, "") if texts.null_count else texts
    held = held if pa.types.is_string(held.type) else held.cast(pa.large_string())
    _, places, raw = held.buffers()
    if not len(held) or raw is None or not raw.size:
        return np.empty(0, np.uint8), np.zeros(len(held) + 1, np.int64)
    cuts = np.frombuffer(places, np.int32 if pa.types.is_string(held.type) else np.int64)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    return np.frombuffer(raw, np.uint8)[cuts[0] : cuts[-1]], cuts - cuts[0]


def first_bytes(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Whether each byte is the first of a text."""
    out = np.zeros(len(data) + 1, bool)
    out[cuts[:-1]] = True
    return out[:-1]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, sizes and code points of the characters past ASCII."""
    at = np.flatnonzero(data >= 0xC2)
    b = data[at].astype(np.int32)
    size = 2 + (b >= 0xE0) + (b >= 0xF0)
    point = b & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for j in (1, 2, 3):
        more = np.flatnonzero(size > j)
        point[more] = point[more] << 6 | data[at[more] + j] & 0x3F
    return at, size, point


def byte_kinds(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte is of."""
    out = np.frombuffer(bytearray(data.tobytes().translate(table[:256].tobytes())), np.uint8)
    at, size, point = code_points(data)
    kind = table[point]
    out[at] = kind
    for j in (1, 2, 3):
        more = size > j
        out[at[more] + j] = kind[more]
    return out


def unit_starts(data: np.ndarray, first: np.ndarray, kind: np.ndarray, spaced: bool) -> np.ndarray:
    """Whether a unit begins at each byte.

    Spaced: by 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+.
    Else by 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+, where white space is of no unit, though its runs count as units here.
    """
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    inner = (data & 0xC0) == 0x80  # not the first byte of a character
    quote = np.flatnonzero(begins & (data == ord("'")))
    if spaced:
        run = np.flatnonzero(begins & (kind != WHITE) & ~first)
        before = run - 1
        blank = data[before] == 32
        quote = quote[first[quote] | (data[quote - 1] != 32)]
        # a space before a run belongs to it
        begins[run[blank]] = False
        begins[before[blank]] = True
        # the last blank before a run, if no such space, is a unit of its own
        last = before[~blank & (kind[before] == WHITE)]
        while (more := inner[last]).any():
            last = last - more
        begins[last] = True
    else:
        begins |= (kind == NUMBER) & ~inner
    if len(quote):
        # 's and its like: one unit, and what letters follow begin another
        wide = np.concatenate([data, np.zeros(4, np.uint8)])
        alone = np.append(first, [True] * 4)
        x, y = wide[quote + 1], wide[quote + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8)) & ~alone[quote + 1]
        two = (np.isin(x, np.frombuffer(b"rv", np.uint8)) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))) & ~alone[quote + 1] & ~alone[quote + 2]
        begins[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        after = after[after < len(data)]
        begins[after[kind[after] == LETTER]] = True
    return begins


def marked(data: np.ndarray, cuts: np.ndarray, places: np.ndarray, pairs: Pairs | None = None) -> list[str]:
    """The texts with a mark before each of these places (ascending), each byte (or 16-bit number) as the character of its number, or sure pairs as theirs."""
    out = np.full(len(data) + len(places), MARK, data.dtype)
    own = np.ones(len(out), bool)
    own[places + np.arange(len(places))] = False
    out[own] = data
    ends = cuts + np.searchsorted(places, cuts)
    if pairs is not None:
        out, ends = pairs.joined(out, ends)
    held, ends = out.tobytes().decode("latin-1" if out.itemsize == 1 else "utf-16-le"), ends.tolist()
    return [held[a:b] for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=1)
def lowered_alone(normalizer: str) -> bytes:
    """Packed: which code points a normalizer of NFC, one space for white space, and lower case (as its JSON) turns into str.lower() of them, whatever stands beside them.

    Characters of white space need only become white space. Left out are characters that NFC may join with or move about what is before them, those that Python's Unicode
    does not know, and capital sigma, which str.lower() turns by what is around it.
    """
    import unicodedata

    from tokenizers import Tokenizer, models

    library = Tokenizer.from_str(json.dumps({**json.loads(Tokenizer(models.BPE()).to_str()), "normalizer": json.loads(normalizer)})).normalizer
    points = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and c != "|"]
    got = library.normalize_str("|" + "|".join(points) + "|").split("|")[1:-1]
    if len(got) != len(points):
        raise ValueError("a normalizer that makes or takes bars")
    seconds = {chr(x) for x in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # of Hangul syllables
    for c in points:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    kind, out = unpacked(kinds()), np.zeros(0x110000, bool)
    out[ord("|")] = True
    for c, x in zip(points, got):
        if x == (" " if kind[ord(c)] == WHITE else c.lower()) and c != "Σ" and unicodedata.category(c) != "Cn":
            head = c if c < "\x80" else unicodedata.normalize("NFD", c)[0]
            out[ord(c)] = not unicodedata.combining(c) and not unicodedata.combining(head) and c not in seconds and head not in seconds
    return zlib.compress(out.view(np.uint8).tobytes())
