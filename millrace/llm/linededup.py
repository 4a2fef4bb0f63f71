"""Line dedup by deletion neighbourhoods, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, release, small, table, work_dir, written

#: Flags of a line: which of its halves a line of its own length shares, which one a line of one word less shares,
#: and whether a line of one word more shares either.
HEAD, TAIL, HEAD_SHORT, TAIL_SHORT, LONGER = 1, 2, 4, 8, 16


def words_of(line: Column) -> Column:
    """The words of a line; splitting at a single character needs no regular expression."""
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), "")


def _h(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def _lines(src: DataFrame, least: int) -> DataFrame:
    """One row per line of ``least`` words or more: place (d, th, p), identity (h1, h2) and the keys of its halves."""
    # the words come out of the generator, so that no filter computes them again
    rows = src.select("d", "th", F.posexplode(F.transform(F.split("t", "\n"), words_of)).alias("p", "w")).withColumn("n", F.size("w"))
    rows = rows.where(F.col("n") >= least)
    b, q = F.expr("n div 2").cast("int"), F.expr("(n - 1) div 2").cast("int")
    half = lambda kind, base, start, size: _h(F.lit(kind), base, F.slice("w", start, size))
    return rows.select(
        "d", "th", "p", "n", _h("w").alias("h1"), F.hash("w").alias("h2"),
        half(0, F.col("n"), F.lit(1), b).alias("k1"), half(1, F.col("n"), b + 1, F.col("n") - b).alias("k2"),
        half(0, F.col("n") - 1, F.lit(1), q).alias("k4"), half(1, F.col("n") - 1, q + 2, F.col("n") - 1 - q).alias("k8"),
    )


def _variants() -> Column:
    """Keys of a line's deletion neighbourhood as (role, key), in the halves that no shared key fixes.

    Role S: the word at a place left out, together with length and place: equal keys are one substitution
    apart. Role D: the line without a word; role F: the whole line, to meet role D of a line one word longer.
    Each key is made of two halves so that a fixed half is hashed once.
    """
    n, w = F.col("n"), F.col("hw")
    b, q = F.expr("n div 2").cast("int"), F.expr("(n - 1) div 2").cast("int")
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    none = F.expr("cast(array() as array<struct<role:int,key:bigint>>)")
    row = lambda role, key: F.struct(F.lit(role).alias("role"), key.alias("key"))
    without = lambda lo, hi, i: _h(F.concat(F.slice(w, lo + 1, i - lo), F.slice(w, i + 2, F.greatest(hi - i - 1, F.lit(0)))))
    span = lambda lo, hi, make: F.transform(F.sequence(lo, hi - 1), make)
    zero = F.lit(0)
    return F.concat(
        F.when(flag(HEAD), span(b, n, lambda i: row(0, _h(F.lit(2), n, i, F.col("a1"), without(b, n, i))))).otherwise(none),
        F.when(flag(TAIL), span(zero, b, lambda i: row(0, _h(F.lit(2), n, i, without(zero, b, i), F.col("a2"))))).otherwise(none),
        F.when(flag(HEAD_SHORT), span(q, n, lambda i: row(1, _h(F.lit(3), n - 1, F.col("c1"), without(q, n, i))))).otherwise(none),
        F.when(flag(TAIL_SHORT), span(zero, q + 1, lambda i: row(1, _h(F.lit(3), n - 1, without(zero, q + 1, i), F.col("c2"))))).otherwise(none),
        F.when(flag(LONGER), F.array(row(2, _h(F.lit(3), n, F.col("a1"), F.col("a2"))))).otherwise(none),
    )


def within_one_word(x: Column, y: Column) -> Column:
    """Whether the edit distance of two arrays of words is at most one."""
    long, short = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    odd = F.array_position(F.zip_with(F.slice(long, 1, F.size(short)), short, lambda a, b: a != b), True).cast("int")
    after = F.size(short) - odd
    return (
        F.when(odd == 0, F.size(long) - F.size(short) <= 1)
        .when(F.size(long) == F.size(short), F.slice(long, odd + 1, after) == F.slice(short, odd + 1, after))
        .otherwise((F.size(long) == F.size(short) + 1) & (F.slice(long, odd + 1, after + 1) == F.slice(short, odd, after + 1)))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, exact_words: int = 1, least_copies: int = 1, folder: str | None = None
) -> DataFrame:
    """The documents with repeated lines taken out of ``text_col``, and columns ``n_lines`` and ``n_removed``.

    Lines end at a newline; their words are cut at ASCII white space. A line of ``exact_words`` words or more goes if
    an earlier one, by id and place, has the same words; one of ``min_words`` words or more also if an earlier one of
    as many has words at an edit distance of one (a word put in, left out or replaced). The earlier line counts
    whether or not it goes itself, but only if all documents have its words on ``least_copies`` lines or more. Lines
    without a word stay. Other columns are kept whatever their names; columns named n_lines and n_removed are
    replaced. A null text stays null with no lines; an empty one has one empty line. Null ids come first. Rows that
    repeat an id and a text are one document and lose the same lines. A document may end with an empty text. An
    empty table gives no rows.

    Pairs are never listed within a group: of the lines that share a key, each is compared with the earliest one
    alone, which decides, for lines under one key are all within the bound. Only lines that share a half with
    another line, as any pair within the bound does, have their neighbourhood written out.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    if not 1 <= exact_words <= min_words:
        raise ValueError("exact_words must be from 1 to min_words")
    folder = folder or work_dir(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    columns = docs.columns
    docs, (id_, text) = numbered(docs, id_col, text_col)
    src = docs.select(F.col(id_).alias("d"), _h(text).alias("th"), F.col(text).alias("t"))

    lines = written(_lines(src, exact_words), f"{folder}/lines")
    first = written(
        lines.groupBy("h1", "h2").agg(
            F.min(F.struct("d", "th", "p")).alias("o"), (F.count("*") >= least_copies).alias("f"), F.first("n").alias("n"), *(F.first(k).alias(k) for k in ("k1", "k2", "k4", "k8"))
        ), f"{folder}/first",
    )
    near = _near_lines(src, first.where(F.col("n") >= min_words), folder)

    known = first.select("h1", "h2", "o", "f").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    gone = lines.select("d", "th", "p", "h1", "h2").join(known, ["h1", "h2"]).where(F.col("near") | (F.col("f") & (F.struct("d", "th", "p") > F.col("o"))))
    gone = written(gone.groupBy("d", "th").agg(F.collect_set("p").alias("gone")), f"{folder}/gone")
    discard(docs.sparkSession, folder, "lines", "first", "flagged", "near", "keyed", "close")
    release(docs.sparkSession)
    out = docs.withColumn("h", _h(text)).join(small(gone, "2 + size(gone)"), F.col(id_).eqNullSafe(F.col("d")) & (F.col("h") == F.col("th")), "left")
    out = out.withColumn("ls", F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("ls"), i)), "\n"))
    return out.select(
        *(left.alias(c) if c == text else F.col(c) for c in docs.columns),
        F.when(F.col("ls").isNull(), 0).otherwise(F.size("ls")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    ).toDF(*columns, "n_lines", "n_removed")


def _near_lines(src: DataFrame, first: DataFrame, folder: str) -> DataFrame:
    """Identities (h1, h2) of the lines that an earlier line with ``f`` set is at an edit distance of one from."""
    spark = src.sparkSession
    keys = first.select("h1", "h2", "f", F.explode(F.array(*(F.struct(F.lit(b).alias("flag"), F.col(f"k{b}").alias("key")) for b in (HEAD, TAIL, HEAD_SHORT, TAIL_SHORT)))).alias("x"))
    keys = keys.select("h1", "h2", "f", "x.flag", "x.key")
    long = F.col("flag") >= HEAD_SHORT  # of a line that is one word longer than the key says
    shared = keys.groupBy("key").agg(
        F.min(F.when(~long, F.col("h1"))).alias("a"), F.max(F.when(~long, F.col("h1"))).alias("b"), F.max(long).alias("longer"), F.max("f").alias("any")
    ).where("any AND (a != b OR a IS NOT NULL AND longer)").drop("any")
    bits = F.when(long, F.when(F.col("a").isNotNull(), F.col("flag")).otherwise(0)).otherwise(
        F.when(F.col("a") != F.col("b"), F.col("flag")).otherwise(0) + F.when(F.col("longer"), LONGER).otherwise(0)
    )
    flags = keys.join(shared, "key").groupBy("h1", "h2").agg(F.bit_or(bits).alias("flags")).where("flags != 0")
    flagged = first.select("h1", "h2", "o", "n", "f").join(flags, ["h1", "h2"])
    by_doc = written(flagged.groupBy("o.d", "o.th").agg(F.collect_list(F.struct("o", "n", "f", "flags", "h1", "h2")).alias("x")), f"{folder}/flagged")
    release(spark)
    texts = src.join(small(by_doc.toDF("d_", "th_", "x"), "2 + 8 * size(x)"), F.col("d").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("th_")))
    texts = texts.withColumn("ls", F.split("t", "\n")).select("ls", F.explode("x").alias("x")).select("x.*", words_of(F.get("ls", F.col("x.o.p"))).alias("w"))
    near_lines = written(texts.dropDuplicates(["h1", "h2"]), f"{folder}/near")
    release(spark)

    b, q = F.expr("n div 2").cast("int"), F.expr("(n - 1) div 2").cast("int")
    halves = near_lines.select("h1", "h2", "o", "n", "f", "flags", F.transform("w", lambda x: _h(x)).alias("hw")).withColumns({
        "a1": _h(F.slice("hw", F.lit(1), b)), "a2": _h(F.slice("hw", b + 1, F.col("n") - b)),
        "c1": _h(F.slice("hw", F.lit(1), q)), "c2": _h(F.slice("hw", q + 2, F.col("n") - 1 - q)),
    })
    keyed = written(halves.select("h1", "h2", "o", "f", F.explode(_variants()).alias("v")).select("h1", "h2", "o", "f", "v.role", "v.key"), f"{folder}/keyed")
    least = keyed.groupBy("key").agg(
        F.min(F.when((F.col("role") != 1) & F.col("f"), F.col("o"))).alias("whole"), F.min(F.when((F.col("role") == 1) & F.col("f"), F.col("o"))).alias("cut"),
        F.min("h1").alias("a"), F.max("h1").alias("b"),
    ).where("a != b").drop("a", "b")
    met = keyed.join(least, "key").select("h1", "h2", "o", F.when(F.col("role") == 2, F.col("cut")).otherwise(F.col("whole")).alias("y")).where("y < o")
    pairs = met.select("h1", "h2", "y").distinct()
    pairs = pairs.join(near_lines.select("h1", "h2", F.col("w").alias("wx")), ["h1", "h2"]).join(near_lines.select(F.col("o").alias("y"), F.col("w").alias("wy")), "y")
    near = written(pairs.where(within_one_word(F.col("wx"), F.col("wy"))).select("h1", "h2").distinct(), f"{folder}/close")
    release(spark)
    return near


def op10(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP10_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS p, list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM s, range(1, len(ls) + 1) r(i)),
e AS (SELECT w, MIN({'d': doc_id, 'p': p}) AS o FROM l WHERE len(w) >= 1 GROUP BY w),
f AS (SELECT w, o FROM e WHERE len(w) >= 5),
v AS (SELECT w, o, j, list_concat(list_slice(w, 1, j - 1), list_slice(w, j + 1, len(w))) AS x FROM f, range(1, len(w) + 1) r(j)),
near AS (
  SELECT a.w FROM v a JOIN v b ON a.x = b.x AND a.j = b.j AND b.o < a.o
  UNION SELECT a.w FROM f a JOIN v b ON a.w = b.x AND b.o < a.o
  UNION SELECT a.w FROM v a JOIN f b ON a.x = b.w AND b.o < a.o),
k AS (SELECT l.doc_id, l.p, COALESCE(e.o < {'d': l.doc_id, 'p': l.p}, FALSE) OR near.w IS NOT NULL AS gone FROM l LEFT JOIN e ON l.w = e.w LEFT JOIN near ON l.w = near.w),
g AS (SELECT k.doc_id, COUNT(*) AS n, COUNT(*) FILTER (gone) AS r, COALESCE(string_agg(ls[p], chr(10) ORDER BY p) FILTER (NOT gone), '') AS t FROM k JOIN s USING (doc_id) GROUP BY k.doc_id)
SELECT doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_lines, CAST(COALESCE(r, 0) AS BIGINT) AS n_removed, sha256(COALESCE(t, '')) AS text_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""
