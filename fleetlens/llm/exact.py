"""Exact duplicates by progressive refinement (operator 5).

Texts are grouped by byte length, then by a hash of their first characters, and only rows of groups
that still have two members get a SHA-256 of the whole text.  Lengths and prefix hashes are counted
(combined before the shuffle), so a length or a text that a third of all rows share is one row per
task; the joins back to the rows are equi-joins that Spark may split.

Defined results: a null text counts as empty.  Of equal texts the row with the largest id stays;
null ids count in group_size, are never the id that stays while another exists, and have kept = true
only where all ids are null. Rows that repeat the id that stays are all marked kept.  Other columns
play no part and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.scratch import store


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     carry: Sequence[str] = (), prefix_chars: int = 64) -> DataFrame:
    """One row per document: id_col, the columns to carry, keep_id, group_size and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.struct(*carry).alias("_carry") if carry else F.lit(True).alias("_carry"),
        text.alias("_text"), F.octet_length(text).alias("_bytes"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix"))

    lengths = rows.groupBy("_bytes").agg(F.count("*").alias("n")).where("n > 1").select("_bytes")
    prefixes = rows.groupBy("_bytes", "_prefix").agg(F.count("*").alias("n")).join(lengths, "_bytes", "left_semi")
    prefixes = store(prefixes.where("n > 1").select("_bytes", "_prefix", F.lit(True).alias("_shared")), "prefixes")

    hashed = store(rows.join(prefixes, ["_bytes", "_prefix"], "left").select(
        "_id", "_carry", F.when(F.col("_shared"), F.sha2("_text", 256)).alias("_sha")), "hashed")
    twins = hashed.where("_sha is not null")
    # stored, so that both sides of the join are plain shuffles and a hot text can be split
    groups = store(twins.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    alone = hashed.where("_sha is null").select(
        "_id", "_carry", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    found = alone.unionByName(twins.join(groups, "_sha").select("_id", "_carry", "keep_id", "group_size"))
    return found.select(F.col("_id").alias(id_col), *[F.col(f"_carry.{c}").alias(c) for c in carry],
                        "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose text also has a larger id; all columns stay.

    A document is its id and its text, so an id stays with one text and may go with another; a null id goes where its
    text has an id that is not null.  Rows that repeat the id and text that stay all stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"))
    found = exact_duplicates(keyed, "_id", "_text", carry=["_hash"])
    gone = found.where("not kept").select("_id", "_hash").distinct()
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (own == gone["_hash"]), "left_anti")
