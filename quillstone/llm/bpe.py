"""Byte-level BPE encoding and decoding through a sentencepiece model written directly from a rank file.

Every vocabulary entry becomes a piece whose bytes are mapped one to one onto printable characters and whose score
is its negative rank, so sentencepiece's best-scoring merge is the lowest-rank merge. Normalisation is the identity.
Pre-tokens come from the split pattern; each is encoded alone. Decoding maps pieces back to bytes.

Defined cases: null text is the empty text; an empty text has no ids and decodes to no bytes; repeated rows each give
a row; an empty table gives an empty table; only the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow import ddl
from quillstone.llm.common import spread

#: Pre-tokens whose ids a worker remembers; the memory is emptied when full, so it stays bounded.
REMEMBERED = 100_000


def byte_characters() -> list[str]:
    """A character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    import struct

    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


UNKNOWN = "⁇unknown"


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank table: piece 0 is the unknown piece, piece rank + 1 the entry of a rank."""
    shown = byte_characters()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = [_field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2))]
    for rank, entry in enumerate(order):
        piece = "".join(shown[b] for b in entry).encode()
        pieces.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1) + _field(45, UNKNOWN.encode())
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}


class Tokenizer:
    """Encodes a text to ids (ranks) and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(pattern).findall
        self.shown = byte_characters()
        self.table = dict(enumerate(self.shown))
        back = {c: b for b, c in enumerate(self.shown)}
        self.entries = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(1, self.model.get_piece_size())]
        self.whole = {entry: i for i, entry in enumerate(self.entries)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def ids_of(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8")
        if (own := self.whole.get(raw)) is not None:  # an entry is itself, whether or not merges reach it
            return (own,)
        return tuple(i - 1 for i in self.model.encode(raw.decode("latin-1").translate(self.table)))

    def encode(self, text: str | None) -> list[int]:
        seen, out = self.seen, []
        for token in self.split(text or ""):
            ids = seen.get(token)
            if ids is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                ids = self.ids_of(token)
                if len(token) < 64:
                    seen[token] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


@lru_cache(4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each worker process and vocabulary; the file is read where the worker runs."""
    return Tokenizer(read_ranks(path), pattern)


#: What to return of each document: (Arrow fields, function of ids and decoded bytes).
Finish = tuple[list[pa.Field], Callable[[list[int], bytes], tuple]]
IDS_AND_BYTES: Finish = ([pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.binary())], lambda ids, raw: (ids, raw))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", finish: Finish = IDS_AND_BYTES) -> DataFrame:
    """Encodes each text and decodes its ids. Returns id_col and what `finish` makes of ids and decoded bytes, by default both.

    One pass without a shuffle (but for small inputs: see spread()); a worker holds an Arrow batch of texts and one document's ids at a time.
    """
    fields, made = finish
    kind = docs.select(id_col).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [made(ids := own.encode(text.as_py()), own.decode(ids)) for text in part.column(1)]
                columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *(f.name for f in fields)])

    picked = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    out = picked.mapInArrow(run, f"id {kind.simpleString()}, {ddl(fields)}")
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and `decoded`, the bytes of each id list; a null list decodes to no bytes. An id outside the vocabulary fails."""
    kind = rows.select(id_col).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(ids.as_py() or []) for ids in batch.column(1)], pa.binary())], names=["id", "decoded"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind.simpleString()}, decoded binary").withColumnRenamed("id", id_col)
