"""Byte-level BPE through a sentencepiece model written out from a rank file.

Every byte stands for one printable character, every ranked byte string is a piece whose score is its
negative rank, and normalisation is the identity; so the library's best-score-first merging is the
merging by rank. Texts are cut by the given pattern, each match is encoded alone, and the ids are
turned back to bytes by the inverse of the same table.

Defined cases: a null or empty text has no tokens and decodes to nothing; repeated rows are encoded each
for itself; strings that look like special tokens are plain text; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches

#: matches whose ids one worker remembers, and the longest match worth remembering
REMEMBERED = 1 << 19
LONGEST = 64

#: a printable character for each byte; none of them is white space or a mark of the library
BYTE_CHAR = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(0x4E00 + b) for b in range(256)]
_TO_CHARS = {b: c for b, c in enumerate(BYTE_CHAR)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; one unknown piece follows the last rank."""
    size = max(ranks.values(), default=-1) + 1
    pieces = [b""] * size
    for token, rank in ranks.items():
        name = "".join(BYTE_CHAR[b] for b in token).encode()
        pieces[rank] = _field(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
    # ranks without a token and the unknown piece; types: 2 unknown, 5 unused
    for rank, piece in enumerate(pieces):
        if not piece:
            pieces[rank] = _field(1, f"<unused{rank}>".encode()) + _field(3, 5)
    pieces.append(_field(1, b"<unk>") + _field(3, 2))
    body = b"".join(_field(1, piece) for piece in pieces)
    # model_type 2 is BPE; no begin, end or padding pieces
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one rank file, with the ids of frequent matches kept."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        tokens = sorted((rank, token) for token, rank in ranks.items())
        self.length = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        self.begin = np.zeros_like(self.length)
        at = 0
        for rank, token in tokens:
            self.begin[rank], self.length[rank] = at, len(token)
            at += len(token)
        self.blob = np.frombuffer(b"".join(token for _, token in tokens), np.uint8)
        self.known: dict[str, tuple[str, bytes]] = {}

    def _ids(self, matches: list[str]) -> list[list[int]]:
        raw = [m.encode() for m in matches]
        coded = self.processor.encode([r.decode("latin-1").translate(_TO_CHARS) for r in raw], num_threads=1)
        # a match that is itself ranked is one token, whatever its merges give
        return [[self.ranks[r]] if r in self.ranks else ids for r, ids in zip(raw, coded)]

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """Ids of a text as decimal text joined by commas, and as an array."""
        matches = self.pattern.findall(text)
        if not matches:
            return "", np.zeros(0, np.int32)
        known, long = self.known, {}
        missing = list({m for m in matches if m not in known})
        if missing:
            if len(known) + len(missing) > REMEMBERED:
                known.clear()
                missing = list(set(matches))
            for m, ids in zip(missing, self._ids(missing)):
                value = (",".join(map(str, ids)), np.array(ids, np.int32).tobytes())
                (known if len(m) <= LONGEST else long)[m] = value
        if long:
            parts = [long.get(m) or known[m] for m in matches]
        else:
            parts = [known[m] for m in matches]
        return ",".join([p[0] for p in parts]), np.frombuffer(b"".join([p[1] for p in parts]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered from the table of tokens."""
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if ends.size else 0
        # of byte p in token k: where k begins in the table, plus its place within k
        shift = self.begin[ids] - (ends - length)
        return self.blob[np.repeat(shift, length) + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Id, n_tokens, ids_sha256 and decoded_sha256 of every text; with ``keep_ids`` also the ids themselves.

    ``ranks`` is a file that every executor has.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            counts, coded, decoded, kept = [], [], [], []
            for value in texts:
                ids_text, ids = own.encode(value.as_py())
                counts.append(ids.size)
                coded.append(hashlib.sha256(ids_text.encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = f"doc {dict(base.dtypes)['doc']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = base.mapInArrow(run, kind + (", ids array<int>" if keep_ids else ""))
    return out.withColumnRenamed("doc", id_col)
