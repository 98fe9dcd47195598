"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context and only its reply is trainable. A turn is written as

    ### role<newline>text</turn><newline>

with ``\\``, ``#`` and ``<`` of role and text escaped as ``\\\\``, ``\\h`` and ``\\l``, so
neither mark can occur inside a text and the escape can be undone; a line break
in a role is ``\\n``. Examples
carry the half-open span of their reply in code points. Turns after the last
reply are kept in one more row with an empty span, so that every conversation
can be read back whole.

Defined cases: null texts and roles are empty; turns are in order of turn (null
first), role, text, and repeated rows are turns of their own; a conversation
without an assistant turn has the one row with an empty span; a null conv_id
is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import table, written

START, BREAK, STOP = "### ", "\n", "</turn>\n"
_ESCAPED = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_BACK = {v[1]: k for k, v in _ESCAPED.items()} | {"n": "\n"}


def escape(text: Column) -> Column:
    for plain, coded in _ESCAPED.items():  # the backslash first
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for turn in text.split(STOP)[:-1]:
        if not turn.startswith(START):
            raise ValueError("a turn doesn't start with its mark")
        role, _, body = turn[len(START) :].partition(BREAK)
        out.append((unescape(role), unescape(body)))
    return out


def examples(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end: a row for each trained turn, and one for turns after the last."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit(BREAK), F.lit("\\n")), F.lit(BREAK))
    rows = rows.withColumn("body", escape(F.col("text"))).withColumn("seg", F.concat(head, "body", F.lit(STOP)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "conv_id", F.col("role").isin(*trained).alias("reply"), F.length("body").alias("size"),
        F.array_join(F.collect_list("seg").over(so_far), "").alias("text"),
        F.lead("role").over(order).isNull().alias("last"), F.row_number().over(order).alias("nth"),
        F.count_if(F.col("role").isin(*trained)).over(so_far).alias("replies"),
    )
    end = F.length("text").cast("long") - len(STOP)
    return rows.where("reply OR last").select(
        "conv_id", (F.col("replies") - F.when(F.col("reply"), 1).otherwise(0)).cast("int").alias("example"), "text",
        F.when(F.col("reply"), end - F.col("size")).otherwise(F.length("text")).cast("long").alias("loss_start"),
        F.when(F.col("reply"), end).otherwise(F.length("text")).cast("long").alias("loss_end"),
    )


def digests(rows: DataFrame) -> DataFrame:
    """Read examples back: what each conversation says and what of it is trainable.

    formatted_chars counts the code points of the formatted conversation, each turn once.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, loss, chars, whole = (), hashlib.sha256(), 0, ""

        def row():
            turns = parse(whole)
            said = hashlib.sha256()
            for role, text in turns:
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            return now[0], len(turns), said.hexdigest(), chars, loss.hexdigest(), len(whole)

        def batch(out):
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for b in batches:
            out = []
            for conv, text, start, end in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
                if now != (conv,):
                    if now:
                        out.append(row())
                    now, loss, chars = (conv,), hashlib.sha256(), 0
                reply = unescape(text[start:end])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                chars += len(reply)
                whole = text
            yield batch(out)
        if now:
            yield batch([row()])

    spread = rows.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return spread.select(F.col("conv_id").cast("long"), "text", "loss_start", "loss_end").mapInArrow(run, schema)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(written(examples(turns), "chat")[0])
