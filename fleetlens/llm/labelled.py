"""Training rows: the split by document id, and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; an id that is null is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int, remainder: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _label) of at most `most` rows of each label value outside the held-out part.

    Ids are taken in the order of a hash.  The chosen ids, whose number is bounded by 2 * most, are sent to the documents.
    An id with both label values counts as 0; rows without a label or a text are no training rows.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, modulus, remainder))
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    chosen = None
    for value in (0, 1):
        part = own.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id")
