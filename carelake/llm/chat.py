"""Chat formatting by prefix-target expansion (DataFrame functions only).

Each assistant turn becomes one example: the rendered preceding turns are its
context and only its own text is trainable.  A conversation that does not end in an
assistant turn adds one example without a target, so no turn is lost.

Template, the same for every role::

    <s>[INST] {role} [/INST] {text}</s>

Escaping: in roles and texts each ``<``, ``[`` and backslash is followed by one
backslash, so no control string (all hold ``<`` or ``[`` followed by another
character) can appear inside a text; removing that backslash restores the original.

Defined cases: null role or text is empty; turns with equal numbers are ordered by role,
then text; repeated rows are separate turns; a null conversation id is a conversation
of its own; an empty table gives no example; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import pick

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """Examples: conv_id, example (from 0), text, loss_start, loss_end (code points, end exclusive).

    One grouping by conversation; the expansion and everything after stays in its
    partition.  ``loss_start = loss_end`` in an example without a target.
    """
    rows = pick(turns, conv_id=conv, turn=turn, role=role, text=text)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    prepared = grouped.select(
        "conv_id", F.size("turns").alias("n"),
        F.transform("turns", lambda t: t["role"] == TRAINABLE).alias("trainable"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))).alias("head"),
        F.transform("turns", lambda t: escape(t["text"])).alias("body"))
    places = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("trainable", i))
    places = F.when(F.element_at("trainable", -1), places).otherwise(F.concat(places, F.array(F.col("n") + 1)))
    prepared = prepared.withColumn("turn_text", F.zip_with("head", "body", lambda h, b: F.concat(h, b, F.lit(CLOSE))))
    one = prepared.select("*", F.posexplode(places).alias("example", "at"))
    has = F.col("at") <= F.col("n")
    one = one.select(
        "conv_id", "example",
        F.concat(F.array_join(F.slice("turn_text", F.lit(1), F.col("at") - 1), ""),
                 F.when(has, F.element_at("head", F.least("at", "n"))).otherwise(F.lit(""))).alias("context"),
        F.when(has, F.element_at("body", F.least("at", "n"))).alias("target"))
    start = F.length("context").cast("long")
    return one.select(
        "conv_id", "example",
        F.when(F.col("target").isNull(), F.col("context"))
        .otherwise(F.concat("context", "target", F.lit(CLOSE))).alias("text"),
        start.alias("loss_start"), (start + F.coalesce(F.length("target"), F.lit(0))).alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of an example's text, as array<struct<role,text>> with originals restored."""
    parts = F.split(text, CLOSE, -1)
    bodies = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1),
                         lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(bodies, lambda b: F.struct(
        unescape(F.substring_index(b, MIDDLE, 1)).alias("role"),
        unescape(F.substring(b, F.length(F.substring_index(b, MIDDLE, 1)) + len(MIDDLE) + 1, F.length(b)))
        .alias("text")))


def read_loss(examples: DataFrame) -> Column:
    """The original text under an example's loss mask."""
    return unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"),
                                (F.col("loss_end") - F.col("loss_start")).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turn count, hashes, trainable text, sizes."""
    read = examples.select("conv_id", "example", F.length("text").alias("chars"), read_loss(examples).alias("loss"),
                           read_turns(F.col("text")).alias("turns"))
    # the example with the longest context holds every turn
    whole = F.max_by("turns", F.col("example"))
    losses = F.array_sort(F.collect_list(F.struct("example", "loss")))
    out = read.groupBy("conv_id").agg(whole.alias("turns"), losses.alias("losses"), F.sum("chars").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"),
                     F.col("formatted_chars").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS k,
         23 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS width
  FROM t
), w AS (
  SELECT *, sum(width) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR i = k), 0) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
