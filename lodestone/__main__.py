"""One JSON line for a message: ``python -m lodestone --message TEXT [--faq FOLDER] [--corpus FOLDER]``.

A message that carries a mark of the rules is recorded in the FAQ table or
answered from it and from the corpus (Parquet: id, text, source); anything else
is passed over. Whatever fails is told in the line (type ``error``) and by the
exit status; nothing else is written to standard output.
"""

from __future__ import annotations

import argparse
import contextlib
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.tokenize import cjk, content
from .operators import bm25, record
from .operators.route import route
from .plans import qa
from .runtime import session
from .sources.sinks import reply_line


def reply(spark: SparkSession, message: str, faq: str | None = None, corpus: str | None = None) -> dict:
    """What a message is answered: its type (skip, record, refused or answer) and more."""
    row = spark.createDataFrame([(1, message)], "id long, text string").select("id", route("text").alias("r")).select("id", "r.route", F.col("r.body").alias("text"))
    way, body = (lambda r: (r["route"], r["text"]))(row.collect()[0])
    if way == "skip":
        return {"type": "skip"}
    if faq is None:
        raise ValueError("no FAQ table was named")
    entries = record.read(spark, faq)
    if way == "record":
        told = record.checked(row.withColumnRenamed("text", "body"), entries).collect()[0]
        if told["reason"] is not None:
            return {"type": "refused", "reason": told["reason"]}
        try:
            return {"type": "record", "pos": record.add_entry(spark, faq, told["question"], told["answer"])}
        except record.Duplicate:
            return {"type": "refused", "reason": "duplicate"}
    tokens = lambda c: content(cjk(c))
    known = entries.withColumn("content", tokens("question"))
    chunks = spark.read.parquet(corpus) if corpus else None
    index = bm25.stored(chunks, "id", cjk("text"), "corpus") if corpus else None
    planned = qa.plan(row, qa.Knowledge(known, bm25.build(known, "pos", cjk("question")), chunks, index), cjk("text"), tokens("text"))
    none = spark.createDataFrame([], "key long, reply string")
    return {"type": "answer", "reply": qa.answers(planned, none).collect()[0]["answer"]}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    out = sys.stdout
    arguments = argparse.ArgumentParser(prog="lodestone", description=__doc__.split("\n")[0])
    arguments.add_argument("--message", "-m", required=True)
    arguments.add_argument("--faq")
    arguments.add_argument("--corpus")
    told = arguments.parse_args(argv)
    with contextlib.redirect_stdout(sys.stderr):
        try:
            answer = reply(spark or session(), told.message, told.faq, told.corpus)
        except Exception as e:  # noqa: BLE001  the line tells it
            answer = {"type": "error", "reply": f"{type(e).__name__}: {e}"}
    line, status = reply_line(answer)
    out.write(line + "\n")
    return status


if __name__ == "__main__":
    sys.exit(main())
