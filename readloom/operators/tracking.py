"""Read tracking: best partners of a read, phase exclusion, contig ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.sources.storage import folders_of


def top_partners(hits: DataFrame, n: int = 40, min_len: int = 2500) -> DataFrame:
    """hits: q, t, len. Of each t the n longest hits of min_len or more, ties by the larger q."""
    order = W.partitionBy("t").orderBy(F.desc("len"), F.desc("q"))
    return hits.where(F.col("len") >= min_len).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def exclude_other_phase(hits: DataFrame, phases: DataFrame) -> DataFrame:
    """hits without pairs that lie in one contig and block but different phases; phases: id, ctg, block, phase; block -1 is unassigned."""
    side = lambda k: phases.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("ctg", "block", "phase")])
    x = hits.join(side("q"), "q", "left").join(side("t"), "t", "left")
    other = F.expr("q_ctg = t_ctg AND q_block = t_block AND q_block != -1 AND q_phase != t_phase")
    return x.where(~F.coalesce(other, F.lit(False))).select(*hits.columns)


def phases_by_read(reads: DataFrame, phases: DataFrame) -> DataFrame:
    """reads: id, oid; phases: oid, ctg, block, phase. (id, ctg, block, phase) of reads whose other id has a phase."""
    return reads.join(phases, "oid").select("id", "ctg", "block", "phase")


def stage1_hits(hits: DataFrame, placed: DataFrame, phases: DataFrame, n: int = 40, min_len: int = 2500) -> DataFrame:
    """hits: q, t, len, t_len; placed: q, ctg; phases: id, ctg, block, phase. Of each t of min_len or more the n longest hits (ties by the larger q) by placed reads that aren't of the other phase."""
    x = hits.where(F.col("t_len") >= min_len).join(placed.select("q"), "q", "left_semi").select("q", "t", "len")
    return top_partners(exclude_other_phase(x, phases), n, 0)


def contig_rank(best: DataFrame, placed: DataFrame) -> DataFrame:
    """best: q, t, len; placed: q, ctg. (t, ctg, n, score, rank, in_ctg): contigs of each t's partners, most overlap first, from 0."""
    per = best.join(placed, "q").groupBy("t", "ctg").agg(F.count("*").alias("n"), (-F.sum("len")).alias("score"))
    ranked = per.withColumn("rank", F.row_number().over(W.partitionBy("t").orderBy("score", "ctg")) - 1)
    own = placed.select(F.col("q").alias("t"), "ctg", F.lit(1).alias("own")).distinct()
    return ranked.join(own, ["t", "ctg"], "left").withColumn("in_ctg", F.coalesce("own", F.lit(0))).drop("own")


class BestPartners:
    """The n longest hits of each t over all batches so far, kept in a folder: a batch is merged with what is stored, and
    earlier batches aren't read again.

    Every batch makes a new version, complete before it counts; a batch that is stored already changes nothing, so that an
    update can be repeated. Versions before the last two are removed.
    """

    def __init__(self, spark: SparkSession, path: str, n: int = 40, min_len: int = 2500):
        self.spark, self.path, self.n, self.min_len = spark, path.rstrip("/"), n, min_len

    def _versions(self) -> list[str]:
        return [f for f in folders_of(self.path, "v", "batches/_SUCCESS")]

    def best(self) -> DataFrame:
        """(q, t, len) of the last version."""
        versions = self._versions()
        return self.spark.read.parquet(f"{versions[-1]}/best") if versions else self.spark.createDataFrame([], "q long, t long, len long")

    def batches(self) -> set[str]:
        versions = self._versions()
        return {r.batch for r in self.spark.read.parquet(f"{versions[-1]}/batches").collect()} if versions else set()

    def add(self, batch: str, hits: DataFrame) -> bool:
        """Merges a batch of hits (q, t, len); False if it is stored already."""
        versions, known = self._versions(), self.batches()
        if batch in known:
            return False
        new = top_partners(hits.select("q", "t", "len"), self.n, self.min_len)
        merged = top_partners(self.best().select("q", "t", "len").union(new), self.n, self.min_len) if versions else new
        at = f"{self.path}/v{int(versions[-1].rsplit('/v', 1)[1]) + 1 if versions else 1:08d}"
        merged.write.mode("overwrite").parquet(f"{at}/best")
        self.spark.createDataFrame([(b,) for b in sorted(known | {batch})], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{at}/batches")  # a version counts from here on
        for old in versions[:-1]:
            name = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            name.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(name, True)
        return True


def rank_lines(ranked: DataFrame) -> DataFrame:
    """(t, rank, value) of contig_rank(): read, contig, count, rank, score, in_ctg between spaces; in order of t and rank."""
    return ranked.select("t", "rank", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("t", "ctg", "n", "rank", "score", "in_ctg")]).alias("value"))
