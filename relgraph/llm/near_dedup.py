"""Near-duplicate groups by SetSketch registers, banded, estimated by likelihood, then verified on full sets.

1. Each text becomes its set of hashed word shingles, the set's digest, and a SetSketch of `M` registers: register
   j holds floor(1 - log_b x) of the smallest x over the set, x being exponential with rate `RATE` and cut to [0, Q + 1].
   The minimum of a union is the minimum of the minima, so sketches merge by taking the larger registers.
2. Documents with equal sets form one class, whose representative is the smallest id. Partial aggregation makes a
   hot class one row per task.
3. Registers are banded (`ROWS` to a band, chance of no common band at similarity 0.85: 7e-6). Members of a
   bucket are never all paired with each other: each is compared with the one of the smallest id and, where these links leave
   both apart, with that of the smallest set (of texts with one template it is the nearest to all) and one drawn by hash, so
   links stay linear in the members. Members of buckets that then still hold several components are joined exactly, between
   components only, by prefixes of their sets in the order of rising frequency: the larger set offers its rarest
   (100 - percent) / 100 shingles, the smaller one its rarest (100 - percent) / (100 + percent), and what stands before a
   shared one bounds what two sets can have in common. Texts of one template differ in more than that share, so the
   template's shingles, the frequent ones, are never keys.
4. A candidate is dropped if the likelihood of the two sketches' registers (equal, smaller or larger ones counted, given
   the cardinalities) puts its similarity far under the threshold. The rest is verified on the sets of whole texts.
5. Components come from min-label propagation with pointer jumping over the links, checkpointed at each step.

Every join that a hot key could meet is a plain inner join, which adaptive execution can split.

Edge cases: null and empty texts have empty sets, no link, and are their own component; texts with fewer words than a
shingle are one shingle; rows that repeat an id count as one document for links and get a row each; a null id is
treated as the largest one and returned as null, `kept` comparing null-safely; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, kept, kept_with, mapped, remove, scratch, slices, utf8

M, ROWS = 64, 4
BANDS = M // ROWS
#: Parameters of the sketch: base, rate, largest register.
BASE, RATE, Q = 1.001, 20.0, 2**16 - 2
#: Standard deviations that an estimate may fall short by: 1.3e-7 of pairs at 0.85 with a common band fall shorter.
MARGIN = 5.5
#: Counters of shingles' frequencies (2^`SLOTS`), and the rows of a shingle that one salt stands for.
SLOTS, SALTED = 20, 256
#: Ratio of sizes that are joined as one.
WIDTH = 1.02
_random = np.random.default_rng(20240229)
_MULTIPLIERS = _random.integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 2**63, M, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    split = [t.lower().split() for t in texts]  # of bytes: A-Z only, at `[\x20\x09-\x0D]`
    flat = [w for words in split for w in words]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in texts]
    values = np.empty(len(flat), dtype=object)
    values[:] = flat
    codes, words = pd.factorize(values)
    hashes = pd.util.hash_array(np.asarray(words, dtype=object), categorize=False)[codes]
    out, at = [], 0
    step = np.uint64(0x9E3779B97F4A7C15)
    for ws in split:
        n = len(ws)
        h = hashes[at : at + n]
        at += n
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        k = min(n, size)
        rolled = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            rolled = rolled * step + h[i : n - k + 1 + i]
        out.append(np.unique(_mix(rolled)))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers, a row for each set; of empty sets, zeros."""
    out = np.zeros((len(sets), M), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
    least = np.empty((len(full), M), np.uint64)
    for j in range(M):
        least[:, j] = np.minimum.reduceat((flat ^ _OFFSETS[j]) * _MULTIPLIERS[j], starts)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs by maximum likelihood over a grid, from how many registers are equal, smaller or larger.

    For similarity s, u = n_a / (n_a + n_b) and v = 1 - u: registers of a exceed those of b with p(u - v s), those of
    b exceed those of a with p(v - u s), where p(x) = -log_b(1 - x (b - 1) / b), and are equal otherwise.
    """
    equal, more, less = (a == b).sum(1)[:, None], (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    s = np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * s), p(v - u * s)
    logs = more * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-9, 1))
    logs = np.where(s <= np.minimum(u / v, v / u) + 1e-12, logs, -np.inf)  # similarity is at most the ratio of sizes
    return s[0][np.argmax(logs, axis=1)]


def _summaries(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                sets = shingle_sets(utf8(batch["__text"]), size)
                one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                two = np.array([_mix(s + np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["__id"], pa.array(one), pa.array(two), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in sketches(sets)], pa.binary())],
                    names=["__id", "k1", "k2", "n_shingles", "sketch"],
                )

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("text").alias("__text"))
    return mapped(rows, run, "__id long, k1 long, k2 long, n_shingles long, sketch binary")


def _banded(reps: DataFrame) -> DataFrame:
    """Rows (key, node, n), n being the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            regs = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None, :], regs.shape[:2])
            for i in range(ROWS):
                keys = _mix(keys * np.uint64(0x10001) + regs[:, :, i] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *(pa.array(np.repeat(batch[c].to_numpy(), BANDS)) for c in ("node", "n"))], names=["key", "node", "n"])

    return mapped(reps.select("node", "sketch", F.col("n_shingles").alias("n")), run, "key long, node long, n long")


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sketches don't rule them out."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            regs = [np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, M) for c in ("sa", "sb")]
            ok = np.concatenate([estimate(regs[0][i : i + 4096], regs[1][i : i + 4096], batch["na"].to_numpy()[i : i + 4096], batch["nb"].to_numpy()[i : i + 4096]) for i in range(0, len(batch), 4096)]) >= least
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok))

    return mapped(both.select("a", "b", "sa", "sb", "na", "nb"), run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "tb", 2 << 20):
                one, two = shingle_sets(utf8(batch["ta"]), size), shingle_sets(utf8(batch["tb"]), size)
                ok = []
                for x, y in zip(one, two, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(len(x) > 0 and len(y) > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return mapped(both.select("a", "b", "ta", "tb"), run, "a long, b long")


def _frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """How many sets hold a shingle of a slot; whatever meets there, both sides of a pair see the same table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SLOTS, np.int64)
        for whole in batches:
            for batch in slices(whole):
                for s in shingle_sets(utf8(batch["text"]), size):
                    np.add.at(sums, (s >> np.uint64(64 - SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["slot", "n"])

    out = np.zeros(1 << SLOTS, np.int64)
    found = mapped(texts.select("text"), run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (token, place, node, comp, n) of the rarest shingles of each set: sets as similar as `percent` share one of them."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(utf8(batch["text"]), size)
                first = [s[np.lexsort((s, often[(s >> np.uint64(64 - SLOTS)).astype(np.int64)]))][: (100 - percent) * len(s) // 100 + 1] for s in sets]
                sizes = [len(f) for f in first]
                flat = np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64)
                place = np.concatenate([*[np.arange(n) for n in sizes], np.zeros(0, np.int64)])
                own = [np.repeat(batch[c].to_numpy(), sizes) for c in ("node", "comp")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flat, place, *own, np.repeat([len(s) for s in sets], sizes))], names=["token", "place", "node", "comp", "n"])

    return mapped(texts.select("text", "node", "comp"), run, "token long, place long, node long, comp long, n long")


def _across(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that hold all as similar as `percent`: a prefix-filter join.

    The larger set of a pair (of equal ones that of the larger node) probes, the smaller one is found by its shorter
    prefix. Of a shingle, members of the component that holds it most often don't meet each other: `part` 0 takes
    probes of others to all, `part` 1 probes of that component to others. What many sets are found by is salted, and dealt
    by size as well: a probe meets the sizes that it can be similar to.
    """
    rows = kept(_prefixes(texts, size, percent))
    short = F.col("place") <= F.floor(F.col("n") * (100 - percent) / (100 + percent))
    by_comp = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum(short.cast("long")).alias("found"))
    of_token = by_comp.groupBy("token").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.sum("found").alias("found"), F.count(F.lit(1)).alias("comps"))
    of_token = of_token.where("comps > 1 and found > 0").select("token", "main", F.ceil(F.col("found") / SALTED).alias("salts"))
    rows = rows.join(of_token.hint("merge"), "token")
    # How small a set may be that a probe finds: from what must be common, and from where its shingle stands.
    low, high = F.ceil(percent * F.col("n") / 100), F.least("n", F.floor((100 + percent) * (F.col("n") - F.col("place")) / percent - F.col("n")))
    size_bin = lambda n: F.when(F.col("salts") > 1, F.floor(F.log(n.cast("double")) / F.log(F.lit(WIDTH)))).otherwise(0)
    parts = F.explode(F.when(F.col("comp") == F.col("main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    one = rows.where(short).select("token", parts.alias("part"), F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), size_bin(F.col("n")).alias("bin"), F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("ib"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    two = rows.where(low <= high).withColumn("bin", F.explode(F.sequence(size_bin(low), size_bin(high))))
    two = two.select("token", (F.col("comp") == F.col("main")).cast("int").alias("part"), salts.alias("salt"), "bin", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("place").alias("ia"))
    near = (F.col("ca") != F.col("cb")) & (F.struct("nb", "b") < F.struct("na", "a")) & (100 * F.col("nb") >= percent * F.col("na"))
    # What they share lies at or after the first shingle that both prefixes have.
    near &= (100 + percent) * F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= percent * (F.col("na") + F.col("nb"))
    return two.join(one, ["token", "part", "salt", "bin"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that links reach, for each node that has one."""
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "low").alias("next"))
        hop = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        step = step.join(hop, "next").select("node", "comp", F.least("next", "far").alias("next"))
        step, changed = kept_with(step, F.col("next") < F.col("comp"))
        labels = step.select("node", F.col("next").alias("comp"))
        if not changed:
            return labels


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after new links, worked out between components only."""
    of = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    lower = components(between)
    old = comps.join(lower.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return kept(old.unionByName(lower.join(comps, "node", "left_anti").select("node", "comp")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text)."""
    rows = kept(_summaries(docs.select("doc_id", "text"), size))
    same = ["k1", "k2", "n_shingles"]
    reps = kept(rows.where("n_shingles > 0").groupBy(*same).agg(F.min("__id").alias("node"), F.min("sketch").alias("sketch")))
    bands = _banded(reps)
    # Sums by key are written before their rows are joined with them: of a join of two plain shuffles a hot key can be split.
    light, drawn = F.min(F.struct("n", "node"))["node"], F.min(F.struct(F.xxhash64("node", "key"), "node"))["node"]
    crowd = bands.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.array_distinct(F.array(light, drawn)).alias("others"))
    crowd = kept(crowd.where("lead < last").select("key", "lead", "others"))
    members = kept(bands.join(crowd.hint("merge"), "key").select("key", "node", "lead", "others"))
    in_play = kept(reps.join(members.select("node").distinct(), "node", "left_semi"))
    least = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / M) ** 0.5
    whole = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("node"), "text")
    # Texts of all that shares a bucket, by representative; every comparison reads them from here.
    path = scratch(docs.sparkSession, "texts")
    whole.join(in_play.select("node"), "node", "left_semi").write.parquet(path)
    texts = docs.sparkSession.read.parquet(path)

    def linked(pairs: DataFrame) -> tuple[DataFrame, int]:
        return kept_with(_verified(_likely(pairs, in_play, least), texts, size, percent), F.lit(1))

    pair = lambda lead: (F.least("node", lead).alias("a"), F.greatest("node", lead).alias("b"))
    links, _ = linked(members.where("node <> lead").select(*pair("lead")).distinct())
    # An id that stands for several sets links their classes.
    of_id = rows.where("n_shingles > 0").join(reps.select(*same, F.col("node").alias("rep")), same)
    several = of_id.groupBy("__id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).where("a < high")
    more = of_id.join(several, "__id").where("a < rep").select("a", F.col("rep").alias("b"))
    comps = components(links.unionByName(more))

    def placed(rows: DataFrame, node: str, comp: str) -> DataFrame:
        of = comps.select(F.col("node").alias("__node"), F.col("comp").alias("__comp"))
        return rows.join(of, F.col(node) == F.col("__node"), "left").withColumn(comp, F.coalesce("__comp", node)).drop("__node", "__comp")

    others = members.select("node", F.explode("others").alias("other")).distinct()
    apart = placed(placed(others, "node", "ca"), "other", "cb").where("ca <> cb")
    new, found = linked(apart.select(*pair("other")).distinct())
    if found:
        comps = _joined(comps, new)
    now = placed(members.select("key", "node"), "node", "comp")
    mixed, left = kept_with(now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key"), F.lit(1))
    if left:
        of_node = kept(now.join(mixed.hint("merge"), "key", "left_semi").select("node", "comp").distinct())
        new, found = linked(_across(texts.join(of_node, "node"), size, percent))
        if found:
            comps = _joined(comps, new)
    remove(docs.sparkSession, path)
    of_set = reps.join(comps, "node", "left").select(*same, F.coalesce("comp", "node").alias("comp"))
    out = rows.join(of_set, same, "left")
    real = lambda c: F.when(c < NO_ID, c)
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "__id")).otherwise(F.col("__id"))
    return out.select(real(F.col("__id")).alias("doc_id"), "n_shingles", real(comp).alias("component_id"), (F.col("__id") == comp).alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest id; of rows that repeat an id, all. The threshold is op7's 0.85 (0.8 or more is asked)."""
    lone = near_duplicates(docs).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__keep")).distinct()
    return docs.join(lone, F.coalesce(docs["doc_id"], F.lit(NO_ID)) == lone["__keep"], "left_semi")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op7's contract."""
    return near_duplicates(docs)
