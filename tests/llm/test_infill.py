"""Fill-in-the-middle against slices of lists of units, and exact round trips."""

import hashlib
import random
import re

import pytest

from tideline.llm.infill import arrange, draws, fill_in_middle, form_of, restore, rotate


def plain(doc_id, text):
    """Units, form, cuts and output by regular expression and string slices."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k: k + 8], 16) for k in range(0, 32, 8))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_equal_to_slices_of_units(spark):
    rnd = random.Random(5)
    pieces = ["a", "Zz", "é", "漢字", "😀", " ", "\n", "\x00", "9", "<", ">", "<P", "S>", "<M", "P>", "[", "`", "{", "@"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 60))) for _ in range(600)]
    texts += [None, "", "one", "x" * 3_000_000, "é" * 200_000 + "tail", "with <P> inside", "<S>", "a<M>b"]
    rows = [(None if k % 97 == 0 else k, t, k) for k, t in enumerate(texts)]
    rows += rows[5:8]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    want = sorted((str(d), sha(o), n, f, p, m, sha(t or "")) for d, t, _ in rows for n, f, p, m, o in [plain(d, t)])
    got = fill_in_middle(docs, keep_text=True).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(((str(r.doc_id), r.output_sha256, r.n, r.form, r.prefix_chars, r.middle_chars, r.restored_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert all(sha(r.output) == r.output_sha256 for r in got)


@pytest.mark.parametrize("sizes", [(0, 0), (0, 3), (3, 0), (1, 1), (4, 7), (9, 2)])
def test_rotation_exchanges_blocks(sizes):
    one, two = bytes(range(sizes[0])), bytes(range(100, 100 + sizes[1]))
    buffer = bytearray(b"<" + one + two + b">")
    rotate(buffer, 1, 1 + sizes[0], 1 + sum(sizes))
    assert bytes(buffer) == b"<" + two + one + b">"


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_restores_from_output_and_form(form):
    text = "<<P prefix<S".encode() + "é M>> middle <".encode() + b" P><M suffix<"
    for cut in range(len(text) + 1):
        for end in range(cut, len(text) + 1):
            assert bytes(restore(bytes(arrange(text, cut, end, form)), form)) == text


def test_sentinels_keep_a_text_plain():
    drawn = (0, 0, 0, 99)
    assert [form_of(t, drawn) for t in (b"", b"a<P>", b"<M>", b"<S>b", b"<p>")] == ["plain"] * 4 + ["psm"]
    assert form_of(b"a", draws("7"), rearranged=0) == "plain"


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
