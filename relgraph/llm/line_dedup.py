"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of rising ids. The store holds runs of (hash, owner): a hash stands for a line seen in an
earlier batch and its owner for the smallest id that holds it. A run is a bucketed table of one file for each hash bucket,
sorted by hash, so later batches read it where it lies: a batch first reduces its lines to one row for each hash, which
deals them to the same buckets, merge-anti-joins those with one run after another, without another shuffle of the runs, and
writes what is new as a run of level 0. When a level holds `fanout` runs, they are merged into one run of the next level. A
line of the batch goes if its hash isn't in the batch's own run (an earlier batch owns it) or its document isn't the owner.
Hashes have 128 bits.

A common line, of a third of all documents, is one row per task after partial aggregation; the join that brings
owners to lines is a plain merge join of two shuffles, not of buckets, so that adaptive execution can split it.

Edge cases: null and empty texts are one empty line; null ids sort last and count as one document; rows that
repeat an id count as one document and are filtered row by row; keys under `least` code points always stay; an
empty table gives an empty result; columns named `kept_text`, `n_lines` or `n_dropped` are replaced, others stay.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, WHITE, ascii_lower, kept, remove, scratch, spared, text_of

KEYS = ["__h1", "__h2"]


@dataclass
class RunStore:
    """Levelled runs in the shared folder. `levels[n]` names the runs of level n."""

    spark: SparkSession
    path: str
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)
    made: int = 0
    names: list[str] = field(default_factory=list)

    def _write(self, rows: DataFrame) -> str:
        """A run, as an external table in the store's folder; its name."""
        self.made += 1
        name = f"run_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        files = rows.repartition(n, *KEYS).write.format("parquet").option("path", f"{self.path}/{name}")
        files.bucketBy(n, *KEYS).sortBy(*KEYS).saveAsTable(name)
        self.names.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        """The live runs, bucketed."""
        return [self.spark.table(name) for level in self.levels for name in level]

    def hashes(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.runs()) if self.made else None

    def add(self, own: DataFrame) -> DataFrame:
        """Writes the hashes of a batch that no run holds, and returns them with their owners."""
        for run in self.runs():
            own = own.join(run.select(*KEYS).hint("merge"), KEYS, "left_anti")
        name = self._write(own)
        self._put(0, name)
        return self.spark.read.schema(own.schema).parquet(f"{self.path}/{name}")  # a run without rows has no file

    def _put(self, level: int, at: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(at)

    def compact(self) -> None:
        """Merges each level that is full into a run of the next."""
        for n in range(len(self.levels)):
            if len(self.levels[n]) >= self.fanout:
                merged = self._write(reduce(DataFrame.unionByName, map(self.spark.table, self.levels[n])))
                self.levels[n] = []  # the files stay until close(): plans may still read them
                self._put(n + 1, merged)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.path)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    line = ascii_lower(F.btrim(F.col("__line"), F.lit(WHITE)))
    return (
        docs.select("__ord", "__th", F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
        .select("__ord", "__th", "__pos", line.alias("__key"))
        .where(F.length("__key") >= least)
        .select("__ord", "__th", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(0x5EED), "__key").alias("__h2"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Adds `kept_text`, `n_lines` and `n_dropped` to the rows; other columns stay.

    `batches` only sets how many runs are built: results don't depend on it.
    """
    spark = docs.sparkSession
    rows = docs.withColumns({"__ord": F.coalesce(F.col(id_col), F.lit(NO_ID)), "__text": text_of(text_col)}).withColumn("__th", F.xxhash64("__text"))
    bounds = docs.select(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    store = RunStore(spark, scratch(spark, "runs"), fanout)
    lost = None
    edges = [None, *sorted(set(bounds or [])), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows  # by the id itself, so that the scan can leave row groups out; null ids belong to the last batch
        if low is not None:
            part = part.where((F.col(id_col) > low) | (F.col(id_col).isNull() if high is None else F.lit(False)))
        if high is not None:
            part = part.where(F.col(id_col) <= high)
        lines = _lines(part, least)
        store.compact()
        run = store.add(lines.groupBy(*KEYS).agg(F.min("__ord").alias("__owner")))
        gone = (
            lines.join(run.hint("merge"), KEYS, "left")
            .where(F.col("__owner").isNull() | (F.col("__ord") > F.col("__owner")))
            .groupBy("__ord", "__th")
            .agg(F.collect_set("__pos").alias("__gone"))
        )
        lost = gone if lost is None else lost.unionByName(gone)
    lost = kept(lost)
    store.close()
    out = rows.join(lost, ["__ord", "__th"], "left").withColumn("__lines", F.split("__text", "\n", -1))
    lines, gone = F.col("__lines"), F.coalesce("__gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.size(gone) == 0, F.col("__text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n"))
    return out.withColumns({"kept_text": text, "n_lines": F.size(lines).cast("long"), "n_dropped": F.size(gone).cast("long")}).drop("__ord", "__th", "__text", "__gone", "__lines")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op2's contract."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """The documents with their remaining lines; one whose lines all go keeps an empty text."""
    return spared(docs, ("kept_text", "n_lines", "n_dropped"), lambda own: dedup_lines(own).withColumn("text", F.col("kept_text")))
