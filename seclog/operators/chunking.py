"""Fixed-width and overlapping chunking of a text column into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules


def chunk_pieces(text, size: int, overlap: int):
    """The chunks as an array, cut by one regex pass (linear in the text); null for a null text."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    step = size - overlap
    if step <= 0:
        raise ValueError("chunk overlap must be smaller than the chunk size")
    if step == size:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))


def chunk_text(
    df: DataFrame,
    text_col: str = "text",
    keys: Sequence[str] = ("log_id",),
    size: int = rules.ANALYSIS_CHUNK_SIZE,
    overlap: int = rules.ANALYSIS_CHUNK_OVERLAP,
    out: str = "chunk",
    index: str = "chunk_ix",
    carry: Sequence[str] = (),
    rebalance: int | None = None,
) -> DataFrame:
    """One row per chunk: ``keys…, index int, out string`` (plus ``carry`` columns).

    Code-point based like Python slicing. ``rebalance=n`` spreads the chunk
    rows of a few very large texts over ``n`` partitions (a round-robin
    shuffle of the chunk text); leave it unset when texts are many and small,
    where the scan already parallelises the work.
    """
    chunks = df.select(
        *[F.col(k) for k in keys],
        *[F.col(c) for c in carry],
        F.posexplode(chunk_pieces(F.col(text_col), size, overlap)).alias(index, out),
    )
    if rebalance:
        chunks = chunks.repartition(rebalance)
    return chunks


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows evenly over ``spark.sql.shuffle.partitions``, always: the pieces of a few giant texts would
    otherwise stay in the tasks that read them, and parsing is much dearer than moving a row once."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def at_least_spread(df: DataFrame) -> DataFrame:
    """:func:`spread` if the rows come in fewer partitions than it makes (a small table that one or two tasks read); a
    large scan has enough tasks of its own and its texts stay where they are."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread(df) if df.rdd.getNumPartitions() < wanted else df


#: A block ends after a line end if there is one among its characters, else after a blank, else after the blank that
#: ends the run of non-blanks.
_BLOCK = r"(?U)(?s:.{1,%d}+)\z|(?s:.{1,%d})(?<=\n)|(?s:.{1,%d})(?<=\s)|\S++(?s:.?)"


def text_blocks(text, size: int = rules.ANALYSIS_CHUNK_SIZE, around: int = rules.CONTEXT_WINDOW):
    """A whole text as ``array<struct<block_ix, lead, block, trail>>``: consecutive pieces of about ``size`` characters, with up
    to ``around`` characters of what stands before and after.

    Every piece ends after a blank, so nothing that has no blanks crosses pieces and none changes at their edges. Linear in
    the text; a piece is longer than ``size`` only if one run of non-blanks is.
    """
    pieces = F.regexp_extract_all(text, F.lit(_BLOCK % (size, size, size)), F.lit(0))
    empty = F.lit("")
    # at most two short pieces come in a row, so three neighbours reach far enough
    near = lambda a, i, d: F.coalesce(F.get(a, i + d), empty)

    def one(a, x, i):
        lead = F.right(F.concat(*[F.right(near(a, i, d), F.lit(around)) for d in (-3, -2, -1)]), F.lit(around))
        trail = F.left(F.concat(*[F.left(near(a, i, d), F.lit(around)) for d in (1, 2, 3)]), F.lit(around))
        return F.struct(i.alias("block_ix"), lead.alias("lead"), x.alias("block"), trail.alias("trail"))

    return F.flatten(F.transform(F.array(pieces), lambda a: F.transform(a, lambda x, i: one(a, x, i))))


def chunk_count(text, size: int = rules.ANALYSIS_CHUNK_SIZE, overlap: int = 0):
    """ceil(len / (size - overlap)) without materialising chunks."""
    step = size - overlap
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return F.floor((n + (step - 1)) / step).cast("long")
