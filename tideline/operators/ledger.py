"""A ledger of paid calls: what an answer cost is paid once, whatever becomes of the task that asked for it.

The answers of a Spark task are gone with the task when it fails, but the calls behind them are paid for. So every answer is
stored by the digest of its prompt the moment it comes, in a folder that all executors reach, before the task goes on. A task
that is repeated finds them there, and a run that is started again asks only for what is missing. When the calls of a run are
through, their answers become rows of a table and the single files go.

A failed call (an exception of the labeler) was not paid for and is not stored; it is asked again by the next run. A cut
answer was paid for and stays. Two copies of one task that run at the same time may both ask for the prompt they are at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import written

ANSWER = "digest string, content string, finish string, prompt_tokens bigint, completion_tokens bigint"
_NAMES = ["digest", "content", "finish", "prompt_tokens", "completion_tokens"]
FAILED = "error: "


class Ledger:
    """Answers of one run below ``folder``, a path or URI that Spark and the executors' Arrow filesystems both reach."""

    def __init__(self, folder: str, run: str):
        folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        self.folder = f"{folder.rstrip('/')}/run={run}"

    def _place(self, digest: str) -> tuple[fs.FileSystem, str]:
        """One file a prompt, dealt over folders by the first letters of its digest."""
        store, root = fs.FileSystem.from_uri(self.folder)
        return store, f"{root}/open/{digest[:3]}/{digest}.json"

    def get(self, digest: str) -> tuple | None:
        store, path = self._place(digest)
        if store.get_file_info(path).type != fs.FileType.File:
            return None
        with store.open_input_stream(path) as f:
            row = json.loads(f.read())
        return tuple(row[n] for n in _NAMES[1:])

    def put(self, digest: str, answer: tuple) -> None:
        """A file is there as a whole or not at all: it gets its name once it is written."""
        store, path = self._place(digest)
        folder = path.rpartition("/")[0]
        store.create_dir(folder, recursive=True)
        part = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(json.dumps(dict(zip(_NAMES, (digest, *answer))), ensure_ascii=False).encode())
        store.move(part, path)

    def answers(self, spark: SparkSession) -> DataFrame:
        """The answers that have become rows, one a prompt."""
        try:
            return spark.read.schema(ANSWER).parquet(f"{self.folder}/answers").dropDuplicates(["digest"])
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], ANSWER)

    def absorb(self, fresh: DataFrame) -> None:
        """Answers become rows; only then do their files go, so a stop in between leaves both."""
        fresh.where(~F.startswith("finish", F.lit(FAILED))).select(*_NAMES).write.mode("append").parquet(f"{self.folder}/answers")
        store, root = fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(f"{root}/open").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/open")


def ask(labeler: Callable[[str], tuple], text: str) -> tuple:
    """(answer, finish reason, tokens of the prompt, tokens of the answer) of one call; a failed one has no answer."""
    try:
        content, finish, *usage = labeler(text)
        spent = usage[0] if usage else {}
        return content, finish, spent.get("prompt_tokens"), spent.get("completion_tokens")
    except Exception as problem:  # whatever a caller's function raises: a repeated task would pay again
        return None, f"{FAILED}{type(problem).__name__}", None, None


def answered(batches: DataFrame, labeler: Callable[[str], tuple], keys: tuple, ledger: Ledger) -> DataFrame:
    """Batches with the answer to their prompt: from the ledger's rows, else its files, else the labeler.

    Equal prompts are asked once; one of their batches, the least, carries what the call spent. ``asked`` tells the rows whose
    call this run still had to make.
    """
    rows = batches.select(*keys, "size", "prompt", F.sha2(F.coalesce("prompt", F.lit("")).cast("binary"), 256).alias("digest"))
    prompts = rows.groupBy("digest").agg(F.first("prompt").alias("prompt"), F.min(F.struct(*keys)).alias("payer"))
    known = ledger.answers(batches.sparkSession)
    todo = prompts.select("digest", "prompt").join(known.select("digest"), "digest", "left_anti")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # one prompt, one row: what is paid for is stored before the next call
            for digest, prompt in zip(frame["digest"], frame["prompt"]):
                found = ledger.get(digest)
                answer = found or ask(labeler, prompt)
                if found is None and not answer[1].startswith(FAILED):
                    ledger.put(digest, answer)
                out = pd.DataFrame([(digest, *answer, found is None)], columns=[*_NAMES, "asked"])
                yield out.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    fresh = written(todo.mapInPandas(call, f"{ANSWER}, asked boolean"), "answers")
    had = written(known.withColumn("asked", F.lit(False)).unionByName(fresh), "answers")
    ledger.absorb(fresh)
    every = rows.drop("prompt").join(prompts.select("digest", "payer"), "digest").join(had, "digest")
    pays = F.struct(*keys) == F.col("payer")
    return every.select(
        *keys, "size", "content", "finish", F.when(pays, F.col("prompt_tokens")).alias("prompt_tokens"),
        F.when(pays, F.col("completion_tokens")).alias("completion_tokens"), (pays & F.col("asked")).alias("asked"))
