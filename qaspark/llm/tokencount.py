"""Token counts by a sentencepiece model; huge texts are encoded in overlapping chunks.

A place in a text is stable if no piece of the vocabulary has its two neighbouring characters side by
side: no merge can cross it, so it is a token boundary in every encoding that contains both neighbours
and the tokens on its two sides do not depend on each other. Chunks of a huge text overlap; two
neighbours are spliced at a stable place inside the overlap at which the offsets of both encodings have
a boundary. Where the overlap has none it is widened, up to the rest of the text.

This holds for BPE models with identity normalisation, without user-defined symbols; for others
(`Counter.chunks` is False) every text is encoded whole.

Defined results. Null text: as empty, 0 tokens. Rows are counted one by one, so repeated rows, ties, null
ids and extra columns change nothing. Empty table: no rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from .common import in_batches

CHUNK, OVERLAP = 1 << 15, 1 << 9
SPACE = "▁"


class Counter:
    """Encodes with one model; `chunk` and `overlap` are in characters."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, max(2, overlap)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.beside = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        probe = f"a{SPACE} b  c ﬁ½\t́e\n "
        self.chunks = self._plain_bpe() and self.model.normalize(probe) in (f"{SPACE}{probe}".replace(" ", SPACE), probe.replace(" ", SPACE))

    def _plain_bpe(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        normal = proto.normalizer_spec
        self.prefix = normal.add_dummy_prefix
        return proto.trainer_spec.model_type == proto.trainer_spec.BPE and not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and not any(p.type == p.USER_DEFINED for p in proto.pieces)

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece can lie across place `at` of the text, 0 < at < len(text)."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.beside

    def boundaries(self, text: str) -> tuple[list[int], dict[int, int]]:
        """Tokens of a chunk, and for each character offset at which a token begins its number.

        The prefix space that the model adds has no characters of the text.
        """
        ids = self.model.encode(text)
        starts, at, k = {}, 0, 0
        pieces = [self.model.id_to_piece(i) for i in ids]
        while k < len(ids):
            starts.setdefault(at, k)
            if self.model.is_byte(ids[k]):  # the bytes of one character
                width = len(text[at].encode())
                k, at = k + width, at + 1
                continue
            at += len(pieces[k]) - (self.prefix and k == 0)
            k += 1
        starts[at] = len(ids)
        return ids, starts

    def encode(self, text: str) -> list[int]:
        """The ids of the whole text."""
        if len(text) <= self.chunk or not self.chunks:
            return self.model.encode(text)
        out: list[int] = []
        begin, skip = 0, 0  # the chunk begins at character `begin`; its tokens before `skip` are counted already
        end = min(len(text), self.chunk)
        ids, starts = self.boundaries(text[:end])
        while end < len(text):
            width = self.overlap
            while True:  # splice with the next chunk, which begins `width` characters before this one's end
                low = max(begin + 1, end - width)
                next_end = min(len(text), low + self.chunk + width)
                next_ids, next_starts = self.boundaries(text[low:next_end])
                joint = next((p for p in range(end - 1, low, -1) if p - begin in starts and p - low in next_starts and starts[p - begin] >= skip and self.stable(text, p)), None)
                if joint is not None:
                    out += ids[skip : starts[joint - begin]]
                    begin, end, ids, starts, skip = low, next_end, next_ids, next_starts, next_starts[joint - low]
                    break
                if low == begin + 1 or width >= self.chunk:  # widening backwards ended: this chunk grows instead
                    end = min(len(text), end + width)
                    ids, starts, skip = self._grown(text, begin, end, starts, skip)
                    if end == len(text):
                        break
                width *= 2
        return out + ids[skip:]

    def _grown(self, text: str, begin: int, end: int, starts: dict[int, int], skip: int) -> tuple[list[int], dict[int, int], int]:
        """The chunk encoded again up to a later end; its counted part ended at a stable place and so is found again."""
        counted = next(at for at, k in starts.items() if k == skip)
        ids, starts = self.boundaries(text[begin:end])
        return ids, starts, starts[counted]


@lru_cache(4)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text."""

    def counted(batches):
        import pyarrow as pa

        from qaspark.llm.tokencount import counter as made

        encoder = made(model_path, chunk, overlap)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            short = [t for t in texts if len(t) <= chunk]
            sizes = iter([len(x) for x in encoder.model.encode(short, num_threads=1)] if short else [])
            tokens = [next(sizes) if len(t) <= chunk else len(encoder.encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return in_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), counted, "doc_id long, n_bytes long, n_tokens long")
