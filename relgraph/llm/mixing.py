"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

Each source has a budget of words: its share of all words by weight, at most `most` times its own size, what it
can't use being reshared by weight. A budget is a number of whole passes over the source plus a rest. The rest is
met without a sort: words are summed by source and hash bucket, the bucket in which the running sum crosses the
rest is the source's boundary, and only that bucket is divided further (256 ways) until it holds a single hash.
Documents with a smaller hash take one pass more; those of the boundary hash share what is left (documents with
the same id and text have the same hash), so that each source meets its budget to the word.

Sources are one row each after aggregation, and so are their budgets; a source with a third of all rows is 256 rows
of a histogram. Tables of one row a source are measured: up to `SMALL` bytes they are broadcast, beyond that each of their rows
is repeated for `SALTS` salts, over which the rows of a source are dealt. Documents are never shuffled by their source alone.

Edge cases: null texts have size 0 and take nothing; a null source is a source of its own and the last; equal hashes
share a rest in proportion to their sizes, rounded down; an empty table gives an empty result; columns named like an added one
are replaced, all others stay, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, kept, text_of

#: Bits of a document's hash, and of one level of the histogram.
BITS, STEP = 56, 8
#: Bytes up to which a table of sources is broadcast, and how many parts a source's rows are dealt to otherwise.
SMALL, SALTS = 8 << 20, 64


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _hash(id_col: str, text_col: str) -> Column:
    """The first 56 bits of an MD5, which other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_of(text_col)).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, under the names of `sums`, what rows before this one in a global order come to.

    Rows are dealt to ranges of the order and summed there; ranges are summed once more, so no task holds all rows.
    """
    dealt = kept(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy("__range").agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    earlier = W.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.select("__range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    out = dealt.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(n) for n, x in sums.items()])
    return out.join(F.broadcast(ranges), "__range").withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *[f"__{n}" for n in sums])


def budgets(totals: DataFrame, weights: list[int], most: int) -> DataFrame:
    """(source, source_size) -> with `target`: shares by weight, filled up to the caps from the tightest source on.

    Sources stand in the order of their code points (UTF-8 bytes compare alike), null last, and take the weights in turn.
    A source is capped if its cap falls short of what its weight would give it of what the tighter ones leave.
    """
    names = [F.col("source").isNull(), F.col("source")]
    rows = _before(totals, names, {"place": F.lit(1).cast("long")})
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumns({"cap": F.col("source_size") * most, "ratio": F.col("source_size") * most / F.col("w")})
    rows = _before(rows, [F.col("ratio"), *names], {"caps": F.col("cap"), "ws": F.col("w")})
    whole = rows.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    rows = rows.withColumns({"rest": F.col("all_size") - F.col("caps"), "rest_w": F.col("all_w") - F.col("ws")})
    rows = kept(rows.withColumn("capped", F.col("ratio") <= F.col("rest") / F.col("rest_w")).select("source", "source_size", "w", "cap", "rest", "rest_w", "capped"))
    free = rows.where(~F.col("capped")).agg(F.max_by(F.struct("rest", "rest_w"), "rest_w").alias("free"))
    rows = rows.crossJoin(F.broadcast(free))  # one row
    share = (F.col("free.rest") * F.col("w")).cast("double") / F.col("free.rest_w").cast("double")
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _by_source(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", small: int | None = None) -> DataFrame:
    """Joins rows with a kept table of at most one row for each source (and bucket)."""
    size = table.agg(F.sum(F.octet_length("__s.name") + 128).alias("size")).first()["size"] or 0
    if size <= (SMALL if small is None else small):
        return rows.join(F.broadcast(table), on, how)
    table = table.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("__salt", F.pmod("__h", F.lit(SALTS)).cast("int")).join(table, [*on, "__salt"], how).drop("__salt")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", small: int | None = None) -> DataFrame:
    """Adds `size`, `source_size`, `target` and `taken` to every row; other columns stay. `small` overrides `SMALL`."""
    key = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    sized = docs.withColumns({"__size": word_count(text_of(text_col)), "__h": _hash(id_col, text_col), "__s": key})
    level = kept(sized.select("__s", F.col("__size").alias("size"), "__h"))
    totals = level.groupBy("__s").agg(F.sum("size").alias("source_size"))
    totals = totals.select(F.when(~F.col("__s.none"), F.col("__s.name")).alias("source"), "source_size")
    plan = budgets(totals, list(weights), most)
    plan = plan.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("__s"), "source_size", "target")
    goal = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    plan = kept(plan.withColumns({"passes": passes.cast("long"), "left": F.when(F.col("source_size") > 0, goal - passes * F.col("source_size")).otherwise(0)}))
    # Each level: where the running sum over buckets crosses what is left; a rest of nothing needs no threshold.
    open_ = plan.where("left > 0").select("__s", "left")
    for shift in range(BITS - STEP, -1, -STEP):
        bucket = F.shiftright("__h", shift)
        sums = level.groupBy("__s", bucket.alias("b")).agg(F.sum("size").alias("n"), F.count_distinct("__h").alias("hashes") if shift < BITS - STEP else F.lit(2).alias("hashes"))
        run = F.sum("n").over(W.partitionBy("__s").orderBy("b"))
        cross = sums.withColumn("run", run).join(open_, "__s").where((F.col("run") - F.col("n") <= F.col("left")) & (F.col("left") < F.col("run")))
        cut = kept(cross.select("__s", "b", (F.col("left") - F.col("run") + F.col("n")).alias("left"), "n", "hashes"))
        level = _by_source(level.withColumn("b", bucket), cut.select("__s", "b"), ["__s", "b"], "left_semi", small).drop("b")
        open_ = cut.select("__s", "left")
        if cut.where("hashes > 1").isEmpty():
            break
        level = kept(level)
    edge = _by_source(level, cut.drop("b"), ["__s"], small=small).groupBy("__s").agg(F.max("__h").alias("edge"), F.max("left").alias("share"), F.max("n").alias("among"))
    plan = plan.join(edge, "__s", "left")
    plan = kept(plan.select("__s", F.struct("source_size", "target", "passes", "left", "edge", "share", "among").alias("__p")))
    out = _by_source(sized, plan, ["__s"], small=small)
    get = lambda name: F.col(f"__p.{name}")
    more = (
        F.when((get("left") > 0) & (F.col("__h") < get("edge")), F.col("__size"))
        .when((get("left") > 0) & (F.col("__h") == get("edge")), F.expr("cast(cast(__p.share as decimal(19,0)) * __size div __p.among as bigint)"))
        .otherwise(0)
    )
    taken = (get("passes") * F.col("__size") + more).cast("long")
    return out.withColumns({"size": F.col("__size"), "source_size": get("source_size"), "target": get("target"), "taken": taken}).drop("__s", "__h", "__p", "__size")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op3's contract."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def stage(docs: DataFrame) -> DataFrame:
    """The documents of the mix: those of which it takes words, with `taken` and what led to it."""
    return mix(docs).where("taken > 0")
