"""Token counts of whole texts, huge ones by overlapping chunks.

A huge text is encoded in chunks that overlap. A cut inside an overlap is taken only where both
encodings have a token border and the border is proven stable: the vocabulary holds no piece in which
a word mark follows another character, so no merge can cross from a character to the mark before a
word. Where an overlap has no such border, it is widened, in the end to the rest of the text.

Defined cases: a null or empty text has no tokens; repeated rows are counted each for itself; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: texts handed to the library at once
GROUP = 64
_MARK = "▁"


@lru_cache(maxsize=4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def marks_begin_words(path: str) -> bool:
    """Whether the vocabulary proves that a mark after another character always begins a piece."""
    sp = processor(path)
    return not any(re.search(f"[^{_MARK}]{_MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


def _encode(sp, text: str) -> tuple[list[int], list[int]]:
    """Ids of a text, and the character of the text at which each id begins."""
    found = sp.encode(text, return_type="offset_mapping")
    return found["ids"], [begin for begin, _ in found["offsets"]]


def _stable(text: str, at: int) -> bool:
    """A space after another character: the merges on both sides do not see each other."""
    return 0 < at < len(text) and text[at] == " " and text[at - 1] != " " and text[at - 1] != _MARK


def spliced(sp, text: str, proven: bool, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text through overlapping chunks; equal to encoding it whole."""
    out: list[int] = []
    start, done = 0, 0
    ids, begins = _encode(sp, text[:chunk])
    end = min(chunk, len(text))
    # ``start``: first character of the chunk at hand; ``done``: ids before this character are out
    while end < len(text):
        width, cut = overlap, None
        while proven and cut is None and width < end - done:
            begin = end - width
            here = {start + b for b in begins}
            # the next chunk starts at a stable border, so that its first token is the whole text's too
            while begin > done and not (_stable(text, begin) and begin in here):
                begin -= 1
            if begin <= done:
                break
            # the mark in front of a text stands for the space left out
            stop = min(begin + chunk + width, len(text))
            next_ids, next_begins = _encode(sp, text[begin + 1: stop])
            there = {begin + 1 + b for b in next_begins} - {begin + 1}
            there.add(begin)
            common = [p for p in here if begin <= p < end and (p in there or p + 1 in there) and _stable(text, p)]
            if common:
                cut = max(common)
            else:
                width *= 2
        if cut is None:
            # no border proven so far: take the rest of the text into the chunk, twice as far each time
            end = min(start + 2 * (end - start), len(text))
            ids, begins = _encode(sp, text[start:end] if start == 0 else text[start + 1: end])
            begins = begins if start == 0 else [b + 1 if k else 0 for k, b in enumerate(begins)]
            continue
        out += [i for i, b in zip(ids, begins) if done <= start + b < cut]
        start, done = begin, cut
        ids, begins = next_ids, [b + 1 if k else 0 for k, b in enumerate(next_begins)]
        end = stop
    return out + [i for i, b in zip(ids, begins) if start + b >= done]


def count_texts(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    sp, proven = processor(path), marks_begin_words(path)
    out = [0] * len(texts)
    plain = [k for k, t in enumerate(texts) if len(t) <= chunk]
    for at in range(0, len(plain), GROUP):
        part = plain[at: at + GROUP]
        for k, ids in zip(part, sp.encode([texts[k] for k in part], num_threads=1)):
            out[k] = len(ids)
    for k, t in enumerate(texts):
        if len(t) > chunk:
            out[k] = len(spliced(sp, t, proven, chunk, overlap))
    return out


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Id, n_bytes and n_tokens of every text; ``model`` is a sentencepiece file that every executor has."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            counts = pa.array(count_texts(texts.to_pylist(), model, chunk, overlap), pa.int64())
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, counts], names=["doc", "n_bytes", "n_tokens"])

    counted = base.mapInArrow(count, f"doc {dict(base.dtypes)['doc']}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("doc", id_col)
