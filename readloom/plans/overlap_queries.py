"""Queries on overlaps and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.operators import overlaps as O
from readloom.plans.views import OVL, plain, view

#: Thresholds that fit the small reads of the bound table.
S1 = {"max_diff": 3, "max_cov": 8, "min_cov": 2, "min_len": 1100, "min_idt": 92.0}
o = lambda s, d: view(s, d, OVL)
W = f"WITH o AS ({plain(OVL)})"
COLS = "a_name, b_name, score, idt, a_rev, a_start, a_end, a_len, b_rev, b_start, b_end, b_len, tag"

PROFILE = """, ev AS (SELECT a_name, a_start AS pos, 1 AS d, CASE WHEN tag = 'u' THEN 0 ELSE 1 END AS k, CASE WHEN b_start <> 0 AND b_end <> b_len THEN 1 ELSE 0 END AS x FROM o WHERE idt >= 95
  UNION ALL SELECT a_name, a_end, -1, CASE WHEN tag = 'u' THEN 0 ELSE -1 END, -1 FROM o WHERE idt >= 95),
ep AS (SELECT a_name, pos, sum(d) AS d, sum(k) AS k, sum(x) AS x FROM ev GROUP BY a_name, pos),
pr AS (SELECT a_name, pos, CAST(sum(d) OVER w AS BIGINT) AS cov, CAST(sum(k) OVER w AS BIGINT) AS cco, CAST(greatest(0, sum(x) OVER w) AS BIGINT) AS cli FROM ep WINDOW w AS (PARTITION BY a_name ORDER BY pos))"""
GAP = PROFILE + """, pi AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a_name) AS n, lag(pos) OVER w AS lp, lag(cco) OVER w AS lc FROM pr WINDOW w AS (PARTITION BY a_name ORDER BY pos)),
pk AS (SELECT *, max(CASE WHEN cco >= {d} THEN i END) OVER b AS oi, max(CASE WHEN cco >= {d} THEN pos END) OVER b AS op, coalesce(max(CASE WHEN cco = 0 THEN pos END) OVER u, -1) AS z FROM pi
  WINDOW b AS (PARTITION BY a_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY a_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pd AS (SELECT *, cco >= {d} AND coalesce(oi <> 0 AND i - oi > 1, false) AS dip FROM pk),
dc AS (SELECT a_name, pos AS c FROM pd WHERE dip UNION ALL SELECT a_name, op FROM pd WHERE dip), cc AS (SELECT a_name, pos AS c FROM pd WHERE cco - cli < 5 AND cli > 2),
nr AS (SELECT DISTINCT dc.a_name FROM dc JOIN cc ON dc.a_name = cc.a_name AND abs(dc.c - cc.c) < 500),
ag AS (SELECT a_name, sum(CASE WHEN i > 0 AND i < n - 1 THEN (pos - lp) * lc ELSE 0 END) AS area, bool_or(dip AND op < z AND z < pos) AS zd FROM pd GROUP BY a_name),
gp AS (SELECT l.a_name, coalesce(coalesce(area, 0) / CAST(a_len AS DOUBLE) >= {m} AND (zd OR nr.a_name IS NOT NULL), false) AS gap FROM (SELECT a_name, max(a_len) AS a_len FROM o GROUP BY a_name) l LEFT JOIN ag ON l.a_name = ag.a_name LEFT JOIN nr ON l.a_name = nr.a_name)"""
USE = "tag <> 'u' AND idt >= 92 AND a_len >= 1100 AND b_len >= 1100"
PER = f", pe AS (SELECT a_name, count(*) FILTER ({USE} AND a_start = 0) AS f, count(*) FILTER ({USE} AND a_end = a_len) AS t FROM o GROUP BY a_name)"


def flags_sql(sampled: bool = False, gap: bool = False) -> str:
    """CTEs down to fl (name, flags)."""
    high, uneven = "greatest(f, t) > 8", "abs(f - t) > 3"
    sql = PER
    if sampled:
        sql = PROFILE + PER.replace(", pe AS", ", p0 AS") + """, av AS (SELECT a_name, sum((pos - lp) * lc) AS area FROM (SELECT a_name, pos, lag(pos, 1, 0) OVER w AS lp, lag(cov, 1, 0) OVER w AS lc FROM pr WINDOW w AS (PARTITION BY a_name ORDER BY pos)) GROUP BY a_name),
pe AS (SELECT p0.*, coalesce(area, 0) / CAST(a_len AS DOUBLE) AS avg_cov FROM p0 JOIN (SELECT a_name, max(a_len) AS a_len FROM o GROUP BY a_name) l ON p0.a_name = l.a_name LEFT JOIN av ON p0.a_name = av.a_name)"""
        spared = "(greatest(f, t) < 1.5 * avg_cov AND avg_cov > 0 AND (CAST(a_name AS BIGINT) * 7919) % greatest(1, CAST(ceil(avg_cov / 1.0) AS BIGINT)) < 8)"
        high, uneven = f"NOT {spared} AND {high}", f"NOT {spared} AND {uneven}"
    sql += f""", pf AS (SELECT a_name, (CASE WHEN {high} THEN 16 ELSE 0 END) | (CASE WHEN {uneven} THEN 32 ELSE 0 END) | (CASE WHEN least(f, t) < 2 THEN 8 ELSE 0 END) AS flags FROM pe)"""
    if gap:
        sql += GAP.format(d=4, m="0.0").replace(PROFILE, "" if sampled else PROFILE)
    parts = """SELECT a_name AS name, flags FROM pf WHERE flags > 0 UNION ALL SELECT a_name, 2 FROM o WHERE tag <> 'u' AND idt >= 92 AND a_len < 1100 UNION ALL SELECT b_name, 2 FROM o WHERE tag <> 'u' AND idt >= 92 AND b_len < 1100
UNION ALL SELECT b_name, 1 FROM o WHERE """ + USE + " AND tag IN ('contains', 'C') AND a_name IN (SELECT a_name FROM pf WHERE flags = 0)" + (" UNION ALL SELECT a_name, 64 FROM gp WHERE gap" if gap else "")
    return sql + f", fl AS (SELECT name, CAST(bit_or(flags) AS INT) AS flags FROM ({parts}) GROUP BY name)"


def best_sql(where: str, n: int) -> str:
    rest = "b_name, idt, a_rev, a_start, a_end, a_len, b_rev, b_start, b_end, b_len, tag"
    return f""", s2 AS (SELECT *, CASE WHEN a_start = 0 THEN 5 WHEN a_end = a_len THEN 3 END AS side, b_len - (b_end - b_start) AS m FROM o WHERE {where}),
s3 AS (SELECT *, row_number() OVER (PARTITION BY a_name, side ORDER BY score, m, {rest}) - 1 AS rn FROM s2 WHERE side IS NOT NULL),
s4 AS (SELECT *, min(CASE WHEN rn >= {n} AND m > 1000 THEN rn END) OVER (PARTITION BY a_name, side) AS cut FROM s3) SELECT {COLS} FROM s4 WHERE cut IS NULL OR rn <= cut"""


HANG = """NOT (NOT ((a_start <= 0 AND a_len - a_end <= 0) OR (lb <= 0 AND rb <= 0)) AND ((a_start <= 0 AND rb <= 0) OR (a_len - a_end <= 0 AND lb <= 0)) AND
 ((a_start - lb BETWEEN 0 AND 99 AND rb - (a_len - a_end) BETWEEN 0 AND 99) OR (a_start - lb BETWEEN -99 AND 0 AND rb - (a_len - a_end) BETWEEN -99 AND 0)))"""
name_hash = lambda: F.col("a_name").cast("long") * 7919
LINE = "format('{} {} {} {:.3f} {} {} {} {} {} {} {} {} {}', a_name, b_name, score, idt, CAST(a_rev AS INT), a_start, a_end, a_len, CAST(b_rev AS INT), b_start, b_end, b_len, tag)"
_pick = "SELECT a_name, b_name, score, a_start, b_start FROM o WHERE "
pick = lambda x: x.select("a_name", "b_name", "score", "a_start", "b_start")


ORDER = ["a_number", "score", "b_name", "idt", "a_start", "a_end", "b_start", "b_end", "b_rev", "tag"]


def _lines(s, d):  # noqa: ANN001, ANN202
    return o(s, d).select("*", F.col("a_name").cast("int").alias("a_number"), O.overlap_text().alias("line"))


QUERIES = {
    "m4_low_identity": (lambda s, d: pick(o(s, d).where(O.low_identity(95.0))), W + _pick + "idt < 95"),
    "m4_short": (lambda s, d: pick(o(s, d).where(O.short_a(1200))), W + _pick + "a_len < 1200"),
    "m4_fraction": (lambda s, d: pick(o(s, d).where(O.fraction_outside(20.0, 80.0))), W + _pick + "100.0 * (a_end - a_start) / a_len NOT BETWEEN 20 AND 80 OR 100.0 * (b_end - b_start) / b_len NOT BETWEEN 20 AND 80"),
    "m4_missing_terminus": (lambda s, d: pick(o(s, d).where(O.missing_terminus())), W + _pick + "(a_start <> 0 AND a_end <> a_len) OR (b_start <> 0 AND b_end <> b_len)"),
    "m4_overhang": (lambda s, d: pick(o(s, d).where(O.enough_overhang(100))), W + f", h AS (SELECT *, CASE WHEN b_rev THEN b_len - b_end ELSE b_start END AS lb, CASE WHEN b_rev THEN b_start ELSE b_len - b_end END AS rb FROM o) SELECT a_name, b_name, score, a_start, b_start FROM h WHERE {HANG}"),
    "m4_contained": (lambda s, d: O.contained_filter(o(s, d), 1200, 96.0), W + f", b AS (SELECT * FROM o WHERE a_name <> b_name AND tag NOT IN ('none', '?') AND idt >= 96 AND a_len >= 1200 AND b_len >= 1200), c AS (SELECT a_name AS n FROM b WHERE tag IN ('contained', 'c') UNION SELECT b_name FROM b WHERE tag IN ('contains', 'C')) SELECT {COLS} FROM b WHERE a_name NOT IN (SELECT n FROM c) AND b_name NOT IN (SELECT n FROM c)"),
    "m4_stage1_flags": (lambda s, d: O.stage1_flags(o(s, d), **S1), W + flags_sql() + " SELECT * FROM fl"),
    "m4_stage1_gap": (lambda s, d: O.stage1_flags(o(s, d), **S1, gap_filter=True, min_depth=4), W + flags_sql(gap=True) + " SELECT * FROM fl"),
    "m4_stage1_highcopy": (lambda s, d: O.stage1_flags(o(s, d), **S1, sample_rate=1.0, name_hash=name_hash()), W + flags_sql(True) + " SELECT * FROM fl"),
    "m4_flag_merge": (lambda s, d: O.merge_flags(O.stage1_flags(o(s, d), **S1).union(O.stage1_flags(o(s, d), **S1, sample_rate=1.0, name_hash=name_hash()))), "SELECT name, CAST(bit_or(flags) AS INT) AS flags FROM ((" + W + flags_sql() + " SELECT * FROM fl) UNION ALL (" + W + flags_sql(True) + " SELECT * FROM fl)) GROUP BY name"),
    "m4_flag_report": (lambda s, d: O.flag_report(O.stage1_flags(o(s, d), **S1)), W + flags_sql() + " SELECT k AS flag, count(*) FILTER (b = 0 OR flags & b > 0) AS n FROM fl, (VALUES ('flagged', 0), ('contained', 1), ('short', 2), ('low', 8), ('high', 16), ('uneven', 32), ('gap', 64)) v(k, b) GROUP BY k"),
    "m4_coverage_profile": (lambda s, d: O.coverage_profile(o(s, d)), W + PROFILE + " SELECT * FROM pr"),
    "m4_gap_in_coverage": (lambda s, d: O.gap_in_coverage(o(s, d), 4, 0.0), W + GAP.format(d=4, m="0.0") + " SELECT a_name, gap FROM gp"),
    "m4_gap_min_average": (lambda s, d: O.gap_in_coverage(o(s, d), 4, 5.0), W + GAP.format(d=4, m="5.0") + " SELECT a_name, gap FROM gp"),
    "m4_stage2_best": (lambda s, d: O.stage2_best(o(s, d), None, 90.0, 2), W + best_sql("idt >= 90 AND tag <> 'u'", 2)),
    "m4_filter": (lambda s, d: O.filter_overlaps(o(s, d), 92.0, 90.0, 1100, 2, 8, 3, None), W + flags_sql() + best_sql("idt >= 90 AND tag <> 'u' AND a_name NOT IN (SELECT name FROM fl) AND b_name NOT IN (SELECT name FROM fl)", 10)),
    "m4_pile_index": (lambda s, d: O.pile_index(_lines(s, d), ORDER), W + f", l AS (SELECT row_number() OVER (ORDER BY CAST(a_name AS INT), score, b_name, idt, a_start, a_end, b_start, b_end, b_rev, tag) AS ord, a_name, {LINE} AS line FROM o), g AS (SELECT min(ord) AS first_ord, a_name, count(*) AS n, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM l GROUP BY a_name) SELECT first_ord, a_name, n, CAST(sum(bytes) OVER (ORDER BY first_ord) - bytes AS BIGINT) AS pos, bytes FROM g"),
    "ovl_cov_stats": (lambda s, d: O.coverage_stats(o(s, d)).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "median", "min", "max", "n"), W + ", p AS (SELECT count(*) FILTER (a_start = 0) AS f, count(*) FILTER (a_end = a_len) AS t FROM o GROUP BY a_name), c AS (SELECT f AS c FROM p UNION ALL SELECT t FROM p) SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, median(c) AS median, min(c) AS min, max(c) AS max, count(*) AS n FROM c"),
}
