"""Exact deduplication (DataFrame functions only).

Texts are normalised and grouped by their 128-bit content hash *and* the
normalised bytes themselves, so two texts that share a hash fall into
different groups: the byte comparison inside a hash group is the grouping
comparison of the aggregate. The aggregate combines copies before the
shuffle, so a hot text costs each task one row. Members find their group
again by ``(128-bit hash, 256-bit digest)``; that join carries no text, and
adaptive execution splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.llm.common import c

#: ASCII white space; each run becomes one space before texts are compared.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalise(text: Column) -> Column:
    """Null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    * null text counts as empty; empty texts form one group;
    * the smallest id of a group stays; a null id never wins against another
      and stays only in a group of null ids;
    * rows repeated under one id are one stable id: all carry the same
      ``kept``, and ``group_size`` counts every row;
    * other columns (whatever their names) are ignored; an empty table gives
      an empty result.
    """
    rows = df.select(c(id_col).alias("doc_id"), normalise(c(text_col)).alias("norm"))
    rows = rows.select("doc_id", "norm", F.md5("norm").alias("h"))
    groups = (rows.groupBy("h", "norm")
              .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    members = rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    out = members.join(groups, ["h", "text_sha256"])
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""
