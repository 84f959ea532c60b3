"""Reports, name rules and configuration."""

from __future__ import annotations

import datetime
import json
import uuid as uuid_
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contig_table(contigs: DataFrame, circular: DataFrame, coverage: DataFrame) -> DataFrame:
    """contigs: name, len; circular: name; coverage: seq, cov_mean. (name, len, circular, coverage); coverage goes by the name before the first bar, 0 if missing."""
    x = contigs.withColumn("seq", F.substring_index("name", "|", 1)).join(circular.select("name").distinct().withColumn("c", F.lit(True)), "name", "left").join(coverage.select("seq", "cov_mean"), "seq", "left")
    return x.select("name", "len", F.coalesce("c", F.lit(False)).alias("circular"), F.coalesce("cov_mean", F.lit(0.0)).alias("coverage"))


def column_report(table: DataFrame) -> DataFrame:
    """(report): JSON with one array for each column, longest first."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("o"), *table.columns)))
    return table.agg(rows.alias("r")).select(F.to_json(F.struct(*[F.col(f"r.{c}").alias(c) for c in table.columns])).alias("report"))


#: Names in a contig report.
REPORT = "microbial_asm_polishing_report"
_COLUMNS = (("Contig", "contig", "name"), ("Length", "length", "len"), ("Circular", "circular", "circular"), ("Coverage", "coverage", "coverage"))


def contig_report(table: DataFrame, uuid: Column | None = None) -> DataFrame:
    """(report): JSON of a contig table, one array a column, longest contigs first. One document holds all contigs, which is what a report is."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("o"), "name", "len", "circular", "coverage")))
    columns = F.array(*[F.to_json(F.struct(F.lit(head).alias("header"), F.lit(f"{REPORT}.contigs_table.{k}").alias("id"), F.col(f"r.{c}").alias("values"))) for head, k, c in _COLUMNS])
    text = F.concat(
        F.lit(f'{{"_comment":"pbreports-style JSON","attributes":[],"dataset_uuids":[],"id":"{REPORT}","plotGroups":[],"tables":[{{"columns":['), F.concat_ws(",", columns),
        F.lit(f'],"id":"{REPORT}.contigs_table","title":"Polished contigs from Microbial Assembly"}}],"tags":[],"title":"Microbial Assembly Polishing Report","uuid":"'),
        uuid if uuid is not None else F.expr("uuid()"), F.lit('","version":"1.0.0"}'),
    )
    return table.agg(rows.alias("r")).select(text.alias("report"))


def alarm(name: str, message: str) -> str:
    """JSON list of one alarm, as a pipeline's user interface expects it."""
    at = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    return json.dumps([{"exception": name, "info": "", "message": message, "name": name, "severity": "ERROR", "owner": "TAG", "createdAt": at, "id": str(uuid_.uuid4())}])


def split_haplotigs(rows: DataFrame, header: str) -> tuple[DataFrame, DataFrame]:
    """(primary rows, haplotigs) by the name in a column."""
    return rows.where(~is_haplotig(F.col(header))), rows.where(is_haplotig(F.col(header)))


def renamed_sequences(seqs: DataFrame) -> DataFrame:
    """seqs (name, seq) under their new names; those that get none are dropped."""
    return seqs.withColumn("name", renamed(F.col("name"))).where("name != ''")


def round2(x: Column) -> Column:
    return F.round(x.cast("double"), 2)


def block_of_file(path: Column) -> Column:
    """Number between the last two dots."""
    return F.regexp_extract(path, r"\.(\d+)\.[^.]*$", 1).cast("int")


def movie_parts(header: Column) -> Column:
    """Struct movie, zmw, span of a header with two slashes, null otherwise."""
    p = F.split(header, "/")
    return F.when(F.size(p) == 3, F.struct(p[0].alias("movie"), p[1].alias("zmw"), p[2].alias("span")))


def config_lines(config: Column) -> Column:
    """Lines key=value of a map, values quoted for a shell where they need it."""
    quoted = lambda v: F.when(v.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), v).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
    return F.array_join(F.transform(F.map_entries(config), lambda e: F.concat(e.key, F.lit("="), quoted(e.value))), "\n")


def unknown_settings(defaults: Mapping[str, str], given: Column) -> Column:
    """Keys that the defaults don't have."""
    return F.array_sort(F.filter(F.map_keys(given), lambda k: ~k.isin(*defaults)))


def stale_las(path: Column) -> Column:
    """Whether a file is a numbered pair file that can go; short forms stay."""
    return F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"^(raw_reads|preads)\.\d+\.\1\.\d+\.las$")


def is_haplotig(header: Column) -> Column:
    return F.contains(F.regexp_extract(header, r"^([^ \t]*)", 1), F.lit("-"))


def renamed(name: Column) -> Column:
    """The first part; with a third of 01, both; with another third, nothing."""
    p = F.split(name, r"[.-]")
    return F.when(F.size(p) > 2, F.when(p[2] == "01", F.concat(p[1], F.lit("_01"))).otherwise("")).when(F.size(p) == 2, p[1]).otherwise(F.raise_error(F.lit("a name without parts")).cast("string"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def parse_config(text: Column) -> Column:
    """Map of key=value parts between semicolons or lines; a part with other than one = is an error."""
    parts = F.filter(F.transform(F.split(text, r"[;\n]"), lambda p: F.trim(p)), lambda p: p != "")
    pair = lambda p: F.when(F.size(F.split(p, "=")) == 2, F.struct(F.trim(F.split(p, "=")[0]).alias("key"), F.trim(F.split(p, "=")[1]).alias("value"))).otherwise(F.raise_error(F.concat(F.lit("not a setting: "), p)).cast("struct<key:string,value:string>"))
    return F.map_from_entries(F.transform(parts, pair))


def override(defaults: Mapping[str, str], given: Column) -> Column:
    """Sorted map of the defaults under the given settings."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, given))))
