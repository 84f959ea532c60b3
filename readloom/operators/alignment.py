"""Alignments: read coverage, clip filters, PAF, read-to-contig tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions.sequence import revcomp

#: Flag bits of unmapped, secondary, failed and duplicate records, and the same with supplementary ones.
SKIP, SKIP_MORE, REVERSE = 1796, 3844, 16


def well_covered(aln: DataFrame, min_frac: float = 0.70) -> DataFrame:
    """aln: file, qname, cigar, seq_len. (qname): reads whose aligned part in some file is at least that share of the read."""
    start, end, length = C.query_span(F.col("cigar"), F.col("seq_len"))
    per = aln.select("file", "qname", (end - start).alias("span"), length.alias("length")).groupBy("file", "qname").agg(F.sum("span").alias("span"), F.max("length").alias("length"))
    return per.where(F.expr("try_divide(span, length)") >= min_frac).select("qname").distinct()


def drop_clipped(aln: DataFrame, targets: DataFrame, max_clipping: int = 100, margin: int = 25, exclude: int = 0) -> DataFrame:
    """aln: flag, rname, pos (0-based), cigar; targets: rname, ref_len. Rows that are not clipped by more than that inside the target."""
    left, right = C.all_clips(F.col("cigar"))
    end = F.col("pos") + C.total(F.col("cigar"), "MDN=X")
    x = aln.join(targets, "rname")
    inside = ((left > max_clipping) & (F.col("pos") > margin)) | ((right > max_clipping) & (end + margin < F.col("ref_len")))
    return x.where((F.col("flag").bitwiseAND(F.lit(exclude)) == 0) & ~inside).select(*aln.columns)


def enrich(aln: DataFrame) -> DataFrame:
    """aln with reference begin and end, reference and query lengths (soft clips are of the query), and identity (-1 if not known)."""
    c = F.col("cigar")
    return aln.withColumns({"xb": F.col("pos").cast("long"), "xe": F.col("pos") + C.total(c, "MDN=X"), "xr": C.total(c, "MDN=X"), "xq": C.total(c, C.QUERY), "xp": F.round(C.identity(c, F.col("seq_len"), F.col("nm")), 6)})


def to_paf(aln: DataFrame, targets: DataFrame) -> DataFrame:
    """PAF rows, query coordinates flipped for reverse alignments."""
    start, end, length = C.query_span(F.col("cigar"), F.col("seq_len"))
    x = aln.join(targets, "rname").withColumns({"qs": start, "qe": end, "qlen": length, "rev": F.col("flag").bitwiseAND(F.lit(REVERSE)) > 0, "span": C.total(F.col("cigar"), "MDN=X")})
    return x.select("qname", "qlen", F.expr("if(rev, qlen - qe, qs)").alias("qstart"), F.expr("if(rev, qlen - qs, qe)").alias("qend"), F.expr("if(rev, '-', '+')").alias("strand"), F.col("rname").alias("tname"), F.col("ref_len").alias("tlen"), F.col("pos").cast("long").alias("tstart"), (F.col("pos") + F.col("span")).alias("tend"), (F.col("span") - F.coalesce("nm", F.lit(0))).alias("matches"), F.col("span").alias("aln_len"), "mapq")


def keep_targets(paf: DataFrame, names: DataFrame) -> DataFrame:
    return paf.join(names.select(F.col("name").alias("tname")), "tname", "left_semi").select(*paf.columns)


def augment_read_contigs(phased: DataFrame, aln: DataFrame) -> DataFrame:
    """phased: qname, ctg, block, phase, rest; aln: qname, rname, mapq, flag. The phased rows, and unphased reads with -1s."""
    more = aln.where((F.col("mapq") >= 1) & (F.col("flag").bitwiseAND(F.lit(SKIP)) == 0)).join(phased.where("phase != -1").select("qname"), "qname", "left_anti")
    return phased.where("phase != -1").unionByName(more.select("qname", F.col("rname").alias("ctg"), *[F.lit(-1).alias(c) for c in ("block", "phase", "rest")]))


def flag_mask(text: str) -> int:
    """A mask of 16 bits from decimal or 0x digits."""
    return int(text, 16 if text.lower().startswith("0x") else 10) & 0xFFFF


def parse_region(region: str) -> tuple[str, int, int]:
    """Target, start and end of target:start-end."""
    m = re.fullmatch(r"([^:]*):(\d+)-(\d+)", region)
    if not m:
        raise ValueError(f"not a region: {region}")
    return m[1], int(m[2]), int(m[3])


def clip_count(aln: DataFrame, targets: DataFrame, **given: int) -> DataFrame:
    """(kept, dropped) of drop_clipped."""
    kept = drop_clipped(aln, targets, **given).agg(F.count("*").alias("kept"))
    return aln.agg(F.count("*").alias("all")).crossJoin(kept).select("kept", (F.col("all") - F.col("kept")).alias("dropped"))  # one row each


def region_sequences(aln: DataFrame, region: str, exclude: int = SKIP_MORE, flip: bool = False) -> DataFrame:
    """(qname, header, part): of alignments that reach into the region, the read's part in it; with flip, its reverse complement where the read is reversed."""
    chrom, start, end = parse_region(region)
    x = aln.withColumn("stop", F.col("pos") + C.total(F.col("cigar"), "MDN=X")).where((F.col("rname") == chrom) & (F.col("pos") < end) & (F.col("stop") > start) & (F.col("flag").bitwiseAND(F.lit(exclude)) == 0))
    x = x.withColumn("q", C.target_to_query("cigar", "pos", str(start), str(end)))
    part = F.expr("substring(seq, CAST(q.q_start AS INT) + 1, CAST(q.q_end - q.q_start AS INT) + 1)")
    if flip:
        x = x.withColumn("part", part).withColumn("part", F.when(F.col("flag").bitwiseAND(F.lit(REVERSE)) > 0, revcomp(F.col("part"))).otherwise(F.col("part")))
        part = F.col("part")
    return x.select("qname", part.alias("part")).select("qname", F.concat("qname", F.lit(" len:"), F.length("part")).alias("header"), "part")
