"""No prompt is paid for twice, whatever becomes of the tasks that ask."""

import os
import uuid
from collections import Counter
from pathlib import Path

import pytest

from tideline.operators import labeling, planning
from tideline.operators.ledger import Ledger, answered

KEYS = ("app_id", "batch")


def counting(folder, fatal=None):
    """A labeler that leaves one file a call; at a prompt that holds ``fatal`` its whole worker dies, once."""

    def answer(prompt):
        mark = f"{folder}/died"
        if fatal and fatal in prompt and not os.path.exists(mark):
            open(mark, "x").close()
            os._exit(7)
        if "down" in prompt and not os.path.exists(f"{folder}/up"):
            raise ConnectionError("down")
        with open(f"{folder}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(prompt)
        return f"answer to {prompt}", "length" if "cut" in prompt else "stop", {"prompt_tokens": len(prompt), "completion_tokens": 3}

    return answer


def calls(folder):
    return Counter(p.read_text() for p in Path(folder).glob("*.call"))


def batches(spark, prompts, parts=1):
    rows = [(1, k, 1, p) for k, p in enumerate(prompts)]
    return spark.createDataFrame(rows, "app_id int, batch int, size int, prompt string").coalesce(parts)


def test_a_worker_that_dies_half_way_has_paid_once(spark, tmp_path):
    prompts = [f"prompt {k}" for k in range(40)]
    book, labeler = Ledger(str(tmp_path / "book"), "one"), counting(tmp_path, "prompt 27")
    with pytest.raises(Exception):
        answered(batches(spark, prompts), labeler, KEYS, book).collect()
    before = calls(tmp_path)
    assert 0 < len(before) < 40
    rows = answered(batches(spark, prompts), labeler, KEYS, book).collect()
    assert calls(tmp_path) == Counter(prompts)
    assert {r.batch: r.content for r in rows} == {k: f"answer to {p}" for k, p in enumerate(prompts)}
    # what the stopped run had paid for is part of the spending, but was not asked by this one
    assert sum(r.prompt_tokens for r in rows) == sum(map(len, prompts))
    assert sum(r.asked for r in rows) == 40 - len(before)


def test_a_finished_run_asks_nothing_and_leaves_no_files(spark, tmp_path):
    prompts = ["a", "b cut", "a", "c"]
    book, labeler = Ledger(str(tmp_path / "book"), "one"), counting(tmp_path)
    for asked in (3, 0):
        rows = sorted(answered(batches(spark, prompts, 2), labeler, KEYS, book).collect())
        assert sum(r.asked for r in rows) == asked
        # equal prompts are asked once, and the first of their batches pays; a cut answer is paid for
        assert [(r.batch, r.finish, r.prompt_tokens) for r in rows] == [(0, "stop", 1), (1, "length", 5), (2, "stop", None), (3, "stop", 1)]
    assert calls(tmp_path) == Counter(["a", "b cut", "c"])
    assert not (tmp_path / "book" / "run=one" / "open").exists()
    # another run pays for itself
    answered(batches(spark, ["a"]), labeler, KEYS, Ledger(str(tmp_path / "book"), "two")).collect()
    assert calls(tmp_path)["a"] == 2


def test_failed_calls_are_asked_again(spark, tmp_path):
    book, labeler = Ledger(str(tmp_path / "book"), "one"), counting(tmp_path)
    first = {r.batch: r for r in answered(batches(spark, ["down", "fine"]), labeler, KEYS, book).collect()}
    assert (first[0].content, first[0].finish, first[0].prompt_tokens) == (None, "error: ConnectionError", None)
    (tmp_path / "up").touch()
    again = {r.batch: r for r in answered(batches(spark, ["down", "fine"]), labeler, KEYS, book).collect()}
    assert again[0].content == "answer to down" and again[0].asked and not again[1].asked
    assert calls(tmp_path) == Counter(["down", "fine"])


def test_a_stop_between_rows_and_files_counts_no_answer_twice(spark, tmp_path):
    book, labeler = Ledger(str(tmp_path / "book"), "one"), counting(tmp_path)
    book.put("0" * 64, ("left over", "stop", 1, 2))
    rows = answered(batches(spark, ["x"]), labeler, KEYS, book).collect()
    assert len(rows) == 1 and book.answers(spark).count() == 1
    # the same rows once more, as a stop before the files went would have left them
    book.absorb(book.answers(spark))
    assert book.answers(spark).count() == 1
    assert [r.content for r in answered(batches(spark, ["x"]), labeler, KEYS, book).collect()] == ["answer to x"]
    assert calls(tmp_path) == Counter(["x"])


def test_empty_and_null_prompts(spark, tmp_path):
    book, labeler = Ledger(str(tmp_path / "book"), "one"), counting(tmp_path)
    assert answered(batches(spark, ["x"]).where("false"), labeler, KEYS, book).collect() == []
    rows = answered(spark.createDataFrame([(1, 0, 1, None), (1, 1, 1, "")], "app_id int, batch int, size int, prompt string"), lambda text: ("ok", "stop"), KEYS, book).collect()
    assert [r.content for r in rows] == ["ok", "ok"] and sum(r.asked for r in rows) == 1


def test_a_whole_labelling_run_restarted(spark, tmp_path):
    import json

    def labeler(prompt):
        import re

        with open(f"{tmp_path}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(prompt)
        numbers = re.findall(r'<review n="(\d+)">([^<]*)', prompt)
        if "boom" in prompt and len(numbers) > 1:
            return "cut", "length"
        return json.dumps([{"n": int(n), "aspects": [{"id": "a", "sentiment": "+"}]} for n, _ in numbers]), "stop"

    rows = spark.createDataFrame([(1, 0, 1, "fine"), (1, 0, 2, "boom"), (1, 1, 1, "fine"), (1, 2, 1, "other")], "app_id int, batch bigint, n int, review_body string")
    got = []
    for _ in range(2):
        labels = labeling.label_run(rows, planning.label_batches(rows), labeler, ["a"], Ledger(str(tmp_path / "book"), "one"))
        got.append(sorted((r.batch, r.n, r.status) for r in labels.collect()))
    assert got[0] == got[1] == [(0, 1, "labeled"), (0, 2, "labeled"), (1, 1, "labeled"), (2, 1, "labeled")]
    assert max(calls(tmp_path).values()) == 1
