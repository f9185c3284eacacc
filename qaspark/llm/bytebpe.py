"""Byte-level BPE through a sentencepiece model that is serialised directly from a table of ranks.

Each byte of a token maps to a printable character, so every token is a piece of ordinary characters; its
score is the negative rank, so sentencepiece merges the pair of lowest rank first, as byte-level BPE does.
Normalisation is the identity: no prefix, no folding, no escapes. Pre-tokens (matches of a pattern) are
encoded one by one, frequent ones from a cache; decoding maps ids back to bytes.

Defined results. Null text: as empty, no ids. Rows stand alone, so repeated rows, ties, null ids and
extra columns change nothing. Texts between pre-tokens that the pattern leaves out are left out, as in
tiktoken. Empty table: no rows.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Pre-tokens kept with their ids; the cache is emptied when full, or over so many bytes.
CACHE, LONGEST_CACHED = 1 << 17, 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else one from 256 up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A table of `base64 rank` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes by length, ints as varints, floats as 32 bits."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


#: Field numbers and values of sentencepiece's ModelProto.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE, UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPES = 1, 3, 4, 5
MINUS_ONE = (1 << 64) - 1


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A ModelProto: piece 0 is the unknown one, the token of rank r is piece r + 1."""
    letters = byte_characters()
    out = [_field(PIECES, _field(PIECE, b"<unk>") + _field(SCORE, 0.0) + _field(TYPE, UNKNOWN))]
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    for token, rank in by_rank:
        piece = "".join(letters[b] for b in token).encode()
        out.append(_field(PIECES, _field(PIECE, piece) + _field(SCORE, float(-rank))))
    out.append(_field(TRAINER, _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(ranks) + 1) + _field(UNK_ID, 0) + _field(BOS_ID, MINUS_ONE) + _field(EOS_ID, MINUS_ONE) + _field(PAD_ID, MINUS_ONE)))
    out.append(_field(NORMALIZER, _field(NAME, b"identity") + _field(DUMMY_PREFIX, 0) + _field(EXTRA_SPACES, 0) + _field(ESCAPES, 0)))
    return b"".join(out)


class Codec:
    """Encodes texts to ids and decodes them. `ids_of` keeps pre-token -> ids as little-endian bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.find = regex.compile(pattern).findall
        self.letters = byte_characters()
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        codec = self

        class Cache(dict):
            def __missing__(self, word: str) -> bytes:
                ids = codec.encode_word(word)
                if len(word) <= LONGEST_CACHED:
                    if len(self) >= CACHE:
                        self.clear()
                    self[word] = ids
                return ids

        self.ids_of = Cache()

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token: a token as it stands, else by sentencepiece's merges."""
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None:
            return struct.pack("<I", whole)
        pieces = self.model.encode("".join([self.letters[b] for b in raw]))
        return struct.pack(f"<{len(pieces)}I", *[p - 1 for p in pieces])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.ids_of.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist())) if ids else b""


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""

    def encoded(batches):
        import pyarrow as pa

        from qaspark.llm.bytebpe import codec as made

        encode = made(ranks_path, pattern).encode
        for batch in batches:
            ids = [encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return in_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), encoded, "doc_id long, n_tokens long, ids binary")


def decode_column(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): decoded has the bytes of the ids."""

    def decoded(batches):
        import pyarrow as pa

        from qaspark.llm.bytebpe import codec as made

        decode = made(ranks_path, pattern).decode
        for batch in batches:
            texts = [decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return in_batches(encoded.select("doc_id", "n_tokens", "ids"), decoded, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
