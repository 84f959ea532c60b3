"""CIGAR expressions over strings such as 5S90M5H; sums run over the letters, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that consume the query, the reference.
QUERY, REFERENCE = "MIS=X", "MDN=X"


def total(cigar: Column, ops: str) -> Column:
    """Length of all operations of these kinds."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def end_clips(cigar: Column) -> tuple[Column, Column]:
    """(left, right) of the outermost operation alone: soft is positive, hard negative; a single operation counts left."""
    lead = F.regexp_extract(cigar, r"^\d+[SH]", 0)
    more = F.right(cigar, F.lit(1)).isin("S", "H") & (F.length(lead) < F.length(cigar))
    tail = F.when(more, F.regexp_extract(cigar, r"\d+[SH]$", 0)).otherwise("")
    signed = lambda x: F.when(x == "", 0).otherwise(F.coalesce(F.left(x, F.length(x) - 1).try_cast("long") * F.when(F.right(x, F.lit(1)) == "H", -1).otherwise(1), F.lit(0)))
    return signed(lead), signed(tail)


def all_clips(cigar: Column) -> tuple[Column, Column]:
    """(left, right) of all leading and trailing clips."""
    return total(F.regexp_extract(cigar, r"^((?:\d+[SH])+)", 1), "SH"), total(F.regexp_extract(cigar, r"((?:\d+[SH])+)$", 1), "SH")


def query_span(cigar: Column, seq_len: Column) -> tuple[Column, Column, Column]:
    """(start, end, length) in the read; hard-clipped bases count in the length."""
    left, right = end_clips(cigar)
    hard_left, hard_right = F.greatest(F.lit(0), -left), F.greatest(F.lit(0), -right)
    return F.abs(left), seq_len + hard_left - F.greatest(F.lit(0), right), seq_len + hard_left + hard_right


def identity(cigar: Column, seq_len: Column, mismatches: Column) -> Column:
    """Per cent of the unclipped read, -1 where mismatches aren't known."""
    used = seq_len - total(cigar, "S")
    return F.coalesce(100.0 * F.try_divide((used - mismatches).cast("double"), used), F.lit(-1.0))


def target_to_query(cigar: str, pos: str, start: str, end: str) -> Column:
    """Struct (q_start, q_end) in the read for [start, end) in the target, for an alignment from pos; columns by name."""
    ops = rf"regexp_extract_all({cigar}, '(\\d+[MIDNSHP=X])', 1)"
    step = rf"""aggregate({ops}, named_struct('t', CAST({pos} AS BIGINT), 'q', 0L, 's', CAST(NULL AS BIGINT), 'e', CAST(NULL AS BIGINT), 'last', ''), (a, x) -> named_struct(
      't', a.t + if(instr('{REFERENCE}', right(x, 1)) > 0, CAST(left(x, length(x) - 1) AS BIGINT), 0L),
      'q', a.q + if(a.e IS NULL AND instr('{QUERY}', right(x, 1)) > 0, CAST(left(x, length(x) - 1) AS BIGINT), 0L),
      's', CASE WHEN a.s IS NOT NULL OR a.e IS NOT NULL OR a.t + if(instr('{REFERENCE}', right(x, 1)) > 0, CAST(left(x, length(x) - 1) AS BIGINT), 0L) < {start} THEN a.s
        WHEN instr('M=X', right(x, 1)) = 0 THEN a.q + if(instr('{QUERY}', right(x, 1)) > 0, CAST(left(x, length(x) - 1) AS BIGINT), 0L)
        WHEN {pos} < {start} THEN a.q - (a.t - {start}) ELSE 0L END,
      'e', CASE WHEN a.e IS NOT NULL OR a.t + if(instr('{REFERENCE}', right(x, 1)) > 0, CAST(left(x, length(x) - 1) AS BIGINT), 0L) < {end} THEN a.e
        WHEN instr('M=X', right(x, 1)) = 0 THEN a.q + if(instr('{QUERY}', right(x, 1)) > 0, CAST(left(x, length(x) - 1) AS BIGINT), 0L)
        ELSE a.q + {end} - a.t - 1 END,
      'last', if(a.e IS NULL, x, a.last)))"""
    return F.transform(F.array(F.expr(step)), lambda a: F.struct(F.coalesce(a.s, F.lit(0)).cast("long").alias("q_start"), F.coalesce(a.e, F.when(F.instr(F.lit(REFERENCE), F.right(a["last"], F.lit(1))) > 0, a.q - 1).otherwise(a.q - F.regexp_extract(a["last"], r"^(\d+)", 1).cast("long") - 1)).alias("q_end")))[0]
