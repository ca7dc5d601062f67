"""Fill-in-the-middle texts by rotating blocks in place.

A text is cut into units (a run of ASCII letters, or any other code point), and two cuts, drawn from a digest of the
document's id, divide it into prefix, middle and suffix. A scan over the bytes finds the cuts; the three sentinels are inserted
into one bytearray in the order of the text, and neighbouring blocks change places by three reversals of that array. The
inverse rotation, found from the sentinels alone, gives the text back byte for byte.

Documents are independent of each other: one pass, no shuffle, memory of one block of texts (or of one text, if longer).

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays as it is (form plain); a null id is
drawn like an empty one; rows with one id and text give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import text as tx
from tideline.llm.shared import small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: of 100 texts, how many are rearranged, and of 100 rearranged ones how many begin with their suffix
REARRANGED, SUFFIX_FIRST = 90, 20
SEED = "1"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def unit_starts(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of all units of a block, and where each document's begin among them."""
    letter = _LETTER[block.data]
    starts = _LEAD[block.data]
    inner = letter[1:] & letter[:-1]
    border = np.zeros(block.data.size + 1, bool)
    border[block.offsets] = True
    starts[1:] &= ~inner | border[1:-1]
    places = np.flatnonzero(starts)
    return places, np.searchsorted(places, block.offsets)


def draws(name: str, seed: str = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers drawn from an id."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return tuple(int.from_bytes(digest[k: k + 4], "big") for k in range(0, 16, 4))


def form_of(text: bytes, drawn: tuple[int, ...], rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> str:
    if not text or drawn[2] % 100 >= rearranged or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain"
    return "spm" if drawn[3] % 100 < suffix_first else "psm"


def rotate(buffer: bytearray, first: int, second: int, end: int) -> None:
    """Lets the blocks ``first .. second`` and ``second .. end`` change places, in place, by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    for low, high in ((first, second), (second, end), (first, end)):
        half = (high - low) // 2
        left, right = view[low: low + half], view[high - half: high][::-1]
        kept = left.copy()
        left[:] = right
        right[:] = kept


def arrange(text: bytes, cut: int, cut_end: int, form: str) -> bytearray:
    """The text whose middle is ``cut .. cut_end``, in the order of ``form`` and with sentinels."""
    buffer = bytearray(text)
    if form == "plain":
        return buffer
    buffer[cut_end:cut_end] = SUFFIX
    buffer[cut:cut] = MIDDLE
    buffer[0:0] = PREFIX
    middle = len(PREFIX) + cut
    suffix = len(PREFIX) + len(MIDDLE) + cut_end
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restore(output: bytes | bytearray, form: str) -> bytearray:
    """The text that ``arrange`` was given, from its output and form alone."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    # no sentinel stands in a rearranged text, so each is found where it was inserted
    suffix, other = buffer.find(SUFFIX), buffer.find(MIDDLE if form == "psm" else PREFIX)
    rotate(buffer, suffix, other, len(buffer))
    suffix = suffix + len(buffer) - other
    middle = buffer.find(MIDDLE)
    del buffer[suffix: suffix + len(SUFFIX)], buffer[middle: middle + len(MIDDLE)], buffer[: len(PREFIX)]
    return buffer


def _worker(seed: str, rearranged: int, suffix_first: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(2).to_pylist()
            for block in tx.blocks(batch.column(1)):
                places, bounds = unit_starts(block)
                # code points before each byte
                points = np.append(0, np.cumsum(_LEAD[block.data]))
                body = block.data.tobytes()
                counts, forms, heads, middles, outputs, digests, restored = [], [], [], [], [], [], []
                for d in range(block.size):
                    begin, end = int(block.offsets[d]), int(block.offsets[d + 1])
                    text, n = body[begin:end], int(bounds[d + 1] - bounds[d])
                    drawn = draws(names[block.first + d], seed)
                    form = form_of(text, drawn, rearranged, suffix_first)
                    low, high = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
                    cut, cut_end = (int(places[bounds[d] + k]) if k < n else end for k in (low, high))
                    output = arrange(text, cut - begin, cut_end - begin, form)
                    counts.append(n)
                    forms.append(form)
                    heads.append(None if form == "plain" else int(points[cut] - points[begin]))
                    middles.append(None if form == "plain" else int(points[cut_end] - points[cut]))
                    digests.append(hashlib.sha256(output).hexdigest())
                    restored.append(hashlib.sha256(restore(output, form)).hexdigest())
                    if keep_text:
                        outputs.append(output.decode())
                columns = [
                    batch.column(0).slice(block.first, block.size), pa.array(counts, pa.int64()), pa.array(forms, pa.string()),
                    pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(digests, pa.string()), pa.array(restored, pa.string()),
                ]
                fields = ["doc", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
                if keep_text:
                    columns.append(pa.array(outputs, pa.string()))
                    fields.append("output")
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rearranged: int = REARRANGED,
    suffix_first: int = SUFFIX_FIRST, keep_text: bool = False,
) -> DataFrame:
    """Per document: id, units n, form, code points of prefix and middle (null if plain), digests of the output and of the
    text restored from it; with ``keep_text`` also the output."""
    small_batches(docs.sparkSession)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), name.alias("name"))
    schema = f"doc {dict(base.dtypes)['doc']}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return base.mapInArrow(_worker(seed, rearranged, suffix_first, keep_text), schema + (", output string" if keep_text else "")).withColumnRenamed("doc", id_col)
