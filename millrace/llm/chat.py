"""Relational chat formatting: Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, small, work_dir, written

#: Control strings of the template. A text's own escape character is doubled into ESC+'e', so no control string can occur inside an escaped text.
ESC, OPEN, MID, SEP, CLOSE = "\x1b", "\x1b[", "\x1b|", "\x1b;", "\x1b]"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit(ESC), F.lit(ESC + "e"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit(ESC + "e"), F.lit(ESC))


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_bits: int = 8, long: int = 4096, folder: str | None = None
) -> DataFrame:
    """One row per conversation: id and ``formatted``.

    Turns are sorted by turn, role and text; repeated rows stay, null turns come first. Adjacent turns of one role
    share one block ``ESC[ role ESC| text ESC; text ... ESC]``, so that merging can be undone. Null roles and
    texts count as empty. Rows without an id are one conversation. An empty table gives no rows.

    A conversation is collected in one step. One of more than ``long`` rows is collected by ranges of
    ``2 ** chunk_bits`` turn numbers first and the ranges joined after, so no task sorts more of it than its share.
    """
    turns, (conv, turn, role, text) = numbered(turns, conv_id, turn, role, text)
    folder = folder or work_dir(turns.sparkSession)
    t = turns.select(
        F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"),
    )
    large = small(written(t.groupBy("c").count().where(F.col("count") > long).select(F.col("c").alias("l"), F.lit(True).alias("large")), f"{folder}/long"), 2)
    t = t.join(large, F.col("c").eqNullSafe(F.col("l")), "left")
    said = F.sort_array(F.collect_list(F.struct("t", escaped(F.col("r")).alias("r"), escaped(F.col("x")).alias("x"))))
    plain = lambda df: _merged(df.withColumn("b", F.transform("b", lambda s: F.struct(s.r.alias("r"), s.x.alias("x")))))
    whole = plain(t.where("large IS NULL").groupBy("c").agg(said.alias("b")))
    part = plain(t.where("large").groupBy("c", F.shiftright(F.col("t"), chunk_bits).alias("k")).agg(said.alias("b")))
    joined = part.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "b"))).alias("b"))
    whole = whole.unionByName(_merged(joined.withColumn("b", F.flatten(F.transform("b", lambda s: s.b)))))
    return whole.select(
        F.col("c"), F.array_join(F.transform("b", lambda s: F.concat(F.lit(OPEN), s.r, F.lit(MID), s.x, F.lit(CLOSE))), "").alias("formatted"),
    ).toDF(conv_id, "formatted")


def _merged(df: DataFrame) -> DataFrame:
    """Adjacent blocks of one role in column ``b`` as one, their texts joined by SEP.

    Linear in the number of blocks: ``b`` and the places of the first blocks are columns of their own before a
    lambda looks into them, for a lambda computes an expression anew for every element.
    """
    head = F.transform("b", lambda s, i: F.when((i == 0) | (s.r != F.get(F.col("b"), i - 1).r), i))
    df = df.withColumn("h", F.filter(head, lambda i: i.isNotNull()))
    end = lambda k: F.coalesce(F.get(F.col("h"), k + 1), F.size("b"))
    return df.withColumn(
        "b",
        F.transform("h", lambda h, k: F.struct(F.get(F.col("b"), h).r.alias("r"), F.array_join(F.transform(F.slice("b", h + 1, end(k) - h), lambda s: s.x), SEP).alias("x"))),
    ).drop("h")


def read_chats(formatted: DataFrame, conv_id: str = "conv_id", col: str = "formatted") -> DataFrame:
    """Undoes :func:`format_chats`: id, ``turns`` (array of role and text, in order), ``loss`` (array of the texts under the loss mask).

    An empty text has no turns; a null one has null turns and loss. Other columns are not read.
    """
    blocks = F.filter(F.split(F.col(col), r"\x1b\]"), lambda s: s != "")

    def parse(s: Column) -> Column:
        cut = F.split(F.substring(s, 3, 1 << 30), r"\x1b\|", 2)
        return F.transform(F.split(F.get(cut, F.lit(1)), r"\x1b;"), lambda x: F.struct(unescaped(F.get(cut, F.lit(0))).alias("role"), unescaped(x).alias("text")))

    return (
        formatted.select(F.col(conv_id), F.flatten(F.transform(blocks, parse)).alias("turns"))
        .withColumn("loss", F.transform(F.filter("turns", lambda t: t.role == "assistant"), lambda t: t.text))
    )


def op7(spark, sf_dir):
    from .common import table

    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = format_chats(chats)
    back = read_chats(out.withColumn("n", F.length("formatted")).select(F.struct("conv_id", "n").alias("id"), "formatted"), "id")
    spoken = F.array_join("loss", "")
    return back.select(
        F.col("id.conv_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(spoken).cast("long").alias("loss_chars"), F.sha2(spoken.cast("binary"), 256).alias("loss_sha256"),
        F.col("id.n").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (SELECT *, CASE WHEN role = LAG(role) OVER w THEN 0 ELSE 1 END AS head FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(length(replace(text, chr(27), chr(27) || 'e')) + CASE WHEN head = 1 THEN 6 + length(replace(role, chr(27), chr(27) || 'e')) ELSE 2 END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""
