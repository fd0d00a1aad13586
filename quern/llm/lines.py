"""Line dedup: drop the lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import write_table
from .common import SPACES, fold_ascii


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return fold_ascii(F.btrim(line, F.lit(SPACES)))


def _digest(key: Column) -> Column:
    """128 bits of the key: what is shuffled and counted instead of it."""
    return F.unhex(F.md5(key.cast("binary")))


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_key: int = 1
) -> DataFrame:
    """docs with shared lines dropped from `text_col`, plus n_lines, n_dropped.

    Lines are exploded, normalised and hashed; a hash whose key has at least
    `min_key` code points and that occurs in at least `min_docs` documents
    loses all its lines everywhere; the rest is joined again by position.
    Counting is partial before every shuffle, so a line in every document
    costs a task one row, and only the documents that lose lines have their
    positions collected (at most one entry per line of that document). All
    work on a document is linear in its lines.

    Null text counts as one empty line and becomes the empty string. A
    document is a distinct `id_col`, null being one of them; rows repeated
    under one id count once per line and each keep their own row. Columns
    that are already called n_lines or n_dropped are replaced; others stay.
    An empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.col(id_col).alias("__q_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__q_text"))
    rows = rows.select("__q_id", F.md5(F.col("__q_text").cast("binary")).alias("__q_row"), F.split("__q_text", "\n").alias("l"))
    lines = rows.select("__q_id", "__q_row", F.posexplode(F.transform("l", line_key)).alias("pos", "key"))
    lines = lines.where(F.char_length("key") >= min_key).select("__q_id", "__q_row", "pos", _digest(F.col("key")).alias("h"))
    lines = write_table(lines, "lines")
    shared = lines.select("h", "__q_id").distinct().groupBy("h").count().where(F.col("count") >= min_docs).select("h")
    shared = write_table(shared, "shared")  # a side of its own, so that a hot hash's lines can be split
    gone = lines.join(shared, "h", "left_semi")
    gone = gone.groupBy("__q_id", "__q_row").agg(F.array_sort(F.collect_set("pos")).alias("__q_gone"))
    gone = gone.select(F.col("__q_id").alias("__q_gid"), F.col("__q_row").alias("__q_grow"), "__q_gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.withColumn("__q_row", F.md5(text.cast("binary")))
    joined = full.join(
        gone, F.col(id_col).eqNullSafe(F.col("__q_gid")) & (F.col("__q_row") == F.col("__q_grow")), "left"
    )
    split = F.split(text, "\n")
    # A mark for each line up to the last that goes: False for those since the
    # one before, then True. Lines and marks are read side by side, once.
    since = lambda p, k: p - F.coalesce(F.get("__q_gone", k - 1), F.lit(-1)) - 1
    marks = F.flatten(F.transform("__q_gone", lambda p, k: F.array_append(F.array_repeat(F.lit(False), since(p, k)), F.lit(True))))
    kept = F.array_join(F.zip_with(split, marks, lambda line, goes: F.when(~F.coalesce(goes, F.lit(False)), line)), "\n")
    dropped = F.coalesce(F.size("__q_gone"), F.lit(0)).cast("long")
    outs = [F.when(F.col("__q_gone").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in keep]
    return joined.select(*outs, F.size(split).cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of what is kept."""
    out = drop_shared_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN s ON s.key = k.key
GROUP BY k.doc_id
"""
