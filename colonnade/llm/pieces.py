"""SentencePiece ids with the byte span of each piece in the text as it was, and decoding.

Every text is normalised here, through the model's compiled character map: at each place the longest prefix that the map's trie holds (or
that is a piece set apart by the model, which stays as it is) is replaced, anything else passes as it is. Every normalised byte records the source byte
that it came from. The library segments the normalised text, by a copy of the model whose own normaliser is off, so a piece is a range of
normalised bytes and projects to a range of source bytes. The added leading space projects to an empty span; a character that normalisation
removes belongs to the piece before it, white space that it trims at either end to none. Places where nothing in the map can begin are passed over in one step,
so a model with an empty map costs a copy.

Defined cases: null and empty texts have no ids and decode to ''; repeated rows, and rows with a null doc_id, stay; a very long text is encoded whole;
an empty table gives no rows; other columns, whatever their names, are ignored by encode_documents.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colonnade.llm.common import only, rows_in_blocks

SPACE = "▁".encode()


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 bytes, and the replacements it points to.

    Layout: a little-endian uint32 with the size of the trie in bytes, the trie's uint32 units, then the replacements, each ended by a
    zero byte. Of a unit, bit 8 says that a value hangs below, bits 0-7 and 31 are the label, bits 10-30 the offset
    (times 256 where bit 9 is set); of a value's unit, bits 0-30 are the value.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def can_begin(self, c: int) -> bool:
        """Whether anything in the map begins with this byte."""
        if not self.units:
            return False
        node = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6) ^ c
        return node < len(self.units) and self.units[node] & 0x800000FF == c

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map, and its replacement."""
        units = self.units
        if not units:
            return None
        found, node = None, 0
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        n, start = found
        return n, self.texts[start : self.texts.index(b"\0", start)]


class PieceEncoder:
    """Encodes and decodes by a model file, with spans."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.spec = spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), -1)
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.numbers = [str(i) for i in range(len(model.pieces))]
        #: Pieces that the model sets apart: normalisation leaves them as they are.
        self.apart = [p.piece.encode() for p in model.pieces if p.type == 4]
        self.begins = self._starts()
        plain = sentencepiece_model_pb2.ModelProto()
        plain.CopyFrom(model)
        plain.normalizer_spec.precompiled_charsmap = b""
        plain.normalizer_spec.name = "identity"
        plain.normalizer_spec.add_dummy_prefix = plain.normalizer_spec.remove_extra_whitespaces = plain.normalizer_spec.escape_whitespaces = False
        plain.ClearField("denormalizer_spec")
        self.segments = sentencepiece.SentencePieceProcessor(model_proto=plain.SerializeToString())

    def _starts(self) -> re.Pattern | None:
        """Finds the bytes at which something in the map, or a piece set apart, can begin; None if there is none."""
        first = {p[0] for p in self.apart} | {c for c in range(256) if self.map.can_begin(c)}
        return re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in sorted(first)) + b"]") if first else None

    def _replace(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """data through the map, and the source byte of each byte."""
        out, source, done, at = [], [], 0, 0

        def passed(a: int, b: int) -> None:
            if b > a:
                out.append(data[a:b])
                source.append(np.arange(a, b))

        while self.begins and (m := self.begins.search(data, at)):
            i = m.start()
            if data[i] & 0xC0 == 0x80:  # inside a character
                at = i + 1
                continue
            n = max((len(p) for p in self.apart if data.startswith(p, i)), default=0)
            if n:
                at = i + n
                continue
            hit = self.map.longest(data, i)
            if not hit:
                at = i + 1
                continue
            passed(done, i)
            n, new = hit
            out.append(new)
            source.append(np.full(len(new), i))
            at = done = i + n
        passed(done, len(data))
        return b"".join(out), np.concatenate(source) if source else np.zeros(0, np.int64)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them the source byte it starts from; one entry more, the length of the source."""
        data, spec = text.encode(), self.spec
        out, source = self._replace(data)
        opens, closes = 0, len(data)
        if spec.remove_extra_whitespaces:
            opens = self._leading(data)
            raw = np.frombuffer(out, np.uint8)
            space = raw == 32
            keep = ~(space & np.concatenate([[True], space[:-1]])) if len(raw) else space  # leading spaces, and all but the first of a run
            end, ends = len(out), (b" ", SPACE) if spec.escape_whitespaces else (b" ",)
            while cut := next((len(x) for x in ends if out.endswith(x, 0, end)), 0):
                end -= cut
            closes = int(source[end]) if end < len(out) else closes
            keep &= np.arange(len(raw)) < end
            out, source = raw[keep].tobytes(), source[keep]
        if not out:
            return b"", np.array([len(data)], np.int64)
        mark = SPACE if spec.escape_whitespaces else b" "
        if spec.escape_whitespaces:
            source = np.repeat(source, np.where(np.frombuffer(out, np.uint8) == 32, len(SPACE), 1))
            out = out.replace(b" ", SPACE)
        if spec.add_dummy_prefix:
            out, source = mark + out, np.concatenate([np.full(len(mark), opens, np.int64), source])
        return out, np.append(source, closes)

    def _leading(self, data: bytes) -> int:
        """Bytes at the start that are a space, or become one."""
        at = 0
        while at < len(data):
            n, new = self.map.longest(data, at) or (1, data[at : at + 1])
            if new != b" " or any(data.startswith(p, at) for p in self.apart):
                break
            at += n
        return at

    def encode_one(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids of a text, and the source byte at which each piece begins and ends."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        normal = [self.normalise(t) for t in texts]
        plain = [n.decode() for n, _ in normal]
        return [(ids, *self._spans(p, n, source, ids)) for p, (n, source), ids in zip(plain, normal, self.segments.encode(plain, num_threads=1))]

    def _spans(self, plain: str, normal: bytes, source: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        k = np.array(ids, np.int64)
        sizes = self.sizes[k]
        if (k == self.unknown).any():  # only the library knows how much of the text an unknown piece covers
            sizes = np.array([len(p.piece.encode()) for p in self.segments.encode(plain, return_type="proto").pieces], np.int64)
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return source[ends - sizes], source[ends]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_documents(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int>, begins and ends array<int> (byte spans in the source) and decoded of each document. No exchange."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for (doc_ids,), texts in rows_in_blocks(batches):
            made = enc.encode_all(texts)
            ids, spans = [x[0] for x in made], [x[1:] for x in made]
            each = pa.list_(pa.int32())
            columns = [pa.array(doc_ids, pa.int64()), pa.array(ids, each), pa.array([s[0].astype("i4") for s in spans], each), pa.array([s[1].astype("i4") for s in spans], each), pa.array(enc.decode(ids))]
            yield pa.record_batch(columns, names=["doc_id", "ids", "begins", "ends", "decoded"])

    return only(documents, "doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(documents: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """The same encoding, reduced in the worker that made it: n_tokens, ids_sha256, decoded_sha256, spans_crc32.

    keep: columns of documents that come first (doc_id if not given); they may be of any type and name but those four.
    """
    keep = keep or ["doc_id"]
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    given = only(documents, *keep)
    at = keep.index("text") if "text" in keep else len(keep)
    if at == len(keep):
        given = only(documents, *keep, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for _, texts in rows_in_blocks(iter([batch.select([at])])):
                encoded = enc.encode_all(texts)
                for (i, *spans), back in zip(encoded, enc.decode([x[0] for x in encoded])):
                    crc = 0
                    for s in spans:
                        crc = zlib.crc32(s.astype("<u4").tobytes(), crc)
                    made = len(i), hashlib.sha256(",".join(map(enc.numbers.__getitem__, i)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), crc
                    for column, value in zip(out, made):
                        column.append(value)
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    schema = ", ".join([f"c{i} {given.schema[i].dataType.simpleString()}" for i in range(len(keep))] + [f"c{len(keep) + i} {x.split()[1]}" for i, x in enumerate(made.split(", "))])
    return given.mapInArrow(work, schema).toDF(*keep, *(x.split()[0] for x in made.split(", ")))
