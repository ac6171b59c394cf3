"""Toxicity by class-conditional Kneser-Ney models of the bytes of words.

A gram is a byte of a word with up to 7 bytes before it in the word, its leading space included, packed in 64 bits.
One pass counts grams over all texts (`n`), and over the labelled ones by class. The shared model interpolates, with
Kneser-Ney continuation counts, the orders of `ORDERS`; it rests on all texts and grows with them. Each class backs
off to it:

    P_c(w | h) = (max(n_c(h w) - D, 0) + D * N1+_c(h .) * P(w | h)) / n_c(h),  P(w | h) where the class never saw h,

so a rare expression scores by what the classes share, unless a class gives evidence. Where neither class departs from
the shared model by `SIGMAS` standard deviations, or the two differ by less than a factor e^`FACTOR`, both take the shared
value: else the classes' share of languages would outweigh single words. A text's value is the difference of its
length-normalised log-likelihoods, on a logarithmic scale of unit `UNIT`. A logistic curve, fitted on a fold of labels
that the counts don't use, maps it to a score; empty texts get the curve's value for none.

Parameters: rows with crc32(doc_id) mod 5 = 0 are never learnt from, 4 is the calibration fold. At most about
`fit_rows` labels (those of the smallest hashes of ids) are used; their ids are broadcast. The table of log ratios that
scoring needs is broadcast in blocks of about 2^`slot_bits` entries, all of them; further blocks are further map-only
passes, and the rows are written between passes. Texts are never shuffled.

Edge cases: null and empty texts have no gram; null ids have no label; of labels that repeat an id the largest counts; a null
label is none; without labels of both classes, or documents for them, all scores are 0; an empty table gives an empty result; rows are scored each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, kept, mapped, slices, spared, utf8

ORDERS = (8, 5, 3, 1)
DISCOUNT = 0.75
SIGMAS, FACTOR, UNIT = 4.0, 0.7, 5e-4
_U = np.uint64


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of all texts in order, and the number of each text's."""
    flat = [b" " + b" ".join(w) + b" " if (w := t.translate(ALNUM).split()) else b"" for t in texts]
    sizes = np.array([max(len(x) - 1, 0) for x in flat], np.int64)
    x = np.frombuffer(b"".join(flat), np.uint8)
    if not len(x):
        return np.zeros(0, np.uint64), sizes
    place = np.arange(len(x), dtype=np.int32)
    last = np.maximum.accumulate(np.where(x == 32, place, np.int32(-1)))
    back = place.copy()
    back[1:] -= last[:-1]  # how far the space that began this word is
    back[0] = 0
    wide = x.astype(np.uint64)
    out = wide.copy()
    for k in range(1, 8):
        part = wide[:-k] << _U(8 * k)
        part[back[k:] < k] = 0
        out[k:] |= part
        del part
    first = np.cumsum([0, *[len(f) for f in flat[:-1]]])[[len(f) > 0 for f in flat]]
    keep = np.ones(len(x), bool)
    keep[first] = False  # the space before the first word is no gram
    return out[keep], sizes


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _labels(labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, toxic, fold) of at most about `fit_rows` rows outside the held-out fold."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = kept(rows.withColumn("fold", _fold(F.col("doc_id"))).where("fold <> 0"))
    n = rows.count()
    share = min(1.0, fit_rows / max(n, 1))
    return rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) | F.lit(share >= 1.0))


def _fold(id_col):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)).cast("int")


def count(docs: DataFrame, ids: np.ndarray, toxic: np.ndarray, limit: int = 3 << 19) -> DataFrame:
    """(gram, n, n0, n1): counts over all texts, and over those labelled 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = shared.value
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]

        def merged() -> pa.RecordBatch:
            cols = [_merge(p) if p else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for p in parts]
            keys = np.unique(np.concatenate([c[0] for c in cols]))
            out = [np.zeros(len(keys), np.int64) for _ in cols]
            for o, (k, c) in zip(out, cols, strict=True):
                o[np.searchsorted(keys, k)] = c
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sum(out)), pa.array(out[1]), pa.array(out[2])], names=["gram", "n", "n0", "n1"])

        for whole in batches:
            for batch in slices(whole):
                texts = utf8(batch["text"])
                own = batch["doc_id"].to_numpy(zero_copy_only=False)
                found = np.searchsorted(known, own) if len(known) else np.zeros(len(own), np.int64)
                group = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(found, len(known) - 1)
                    group = np.where(known[at] == own, classes[at] + 1, 0)
                for g in range(3):
                    x, _ = grams([t for t, k in zip(texts, group, strict=True) if k == g])
                    if len(x):
                        k, c = np.unique(x, return_counts=True)
                        parts[g].append((k, c.astype(np.int64)))
            for g in range(3):
                if len(parts[g]) > 8:
                    parts[g] = [_merge(parts[g])]
            if sum(len(k) for p in parts for k, _ in p) > limit:
                yield merged()
                parts = [[], [], []]
        yield merged()

    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("text"))
    raw = mapped(rows, run, "gram long, n long, n0 long, n1 long")
    return raw.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")])


def _mask(order: int) -> int:
    return (1 << (8 * order)) - 1


def shared_model(table: DataFrame) -> DataFrame:
    """(gram, p): interpolated Kneser-Ney probability of the gram's byte after its context, from `gram` and `n`."""
    levels = [table.select("gram", "n")]
    for order in ORDERS[1:]:
        levels.append(levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit(_mask(order))).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    total = levels[-1].agg(F.sum("n").alias("total"))
    below = levels[-1].crossJoin(F.broadcast(total)).select("gram", (F.col("n") / F.col("total")).alias("p"))  # at most 256 rows beside one
    for order, level in zip(ORDERS[-2::-1], levels[-2::-1], strict=True):
        lower = ORDERS[ORDERS.index(order) + 1]
        context = W.partitionBy("h")  # at most 256 rows each
        rows = level.withColumn("h", F.shiftrightunsigned("gram", 8)).select("gram", "n", F.sum("n").over(context).alias("of"), F.count(F.lit(1)).over(context).alias("kinds"))
        low = below.select(F.col("gram").alias("low"), F.col("p").alias("p_low"))
        rows = rows.withColumn("low", F.col("gram").bitwiseAND(F.lit(_mask(lower)))).join(low, "low")
        below = rows.select("gram", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("p_low")) / F.col("of")).alias("p"))
    return below


def log_ratios(table: DataFrame) -> DataFrame:
    """(gram, seen, ratio): log P_1 - log P_0 of the grams for which the classes differ; `seen` in labelled texts."""
    context = W.partitionBy("h")
    rows = table.withColumn("h", F.shiftrightunsigned("gram", 8)).select("*", *[F.sum(f"n{c}").over(context).alias(f"of{c}") for c in (0, 1)], *[F.sum((F.col(f"n{c}") > 0).cast("long")).over(context).alias(f"kinds{c}") for c in (0, 1)])
    rows = rows.where("of0 + of1 > 0").join(shared_model(table), "gram")
    p = lambda c: F.when(F.col(f"of{c}") > 0, (F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds{c}") * F.col("p")) / F.col(f"of{c}")).otherwise(F.col("p"))
    off = lambda c: F.abs(F.col(f"n{c}") - F.col(f"of{c}") * F.col("p")) / F.sqrt(F.col(f"of{c}") * F.col("p") * (1 - F.col("p")) + 0.25)
    rows = rows.select("gram", (F.col("n0") + F.col("n1")).alias("seen"), (F.log(p(1)) - F.log(p(0))).cast("float").alias("ratio"), F.greatest(off(0), off(1)).alias("off"))
    return rows.where((F.col("off") >= SIGMAS) & (F.abs("ratio") >= FACTOR)).drop("off")


def blocks(ratios: DataFrame, slot_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and their ratios, about 2^`slot_bits` at a time, at least one block."""
    rows = kept(ratios.select("gram", "ratio"))
    n = max(1, -(-rows.count() // (1 << slot_bits)))
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == i).toArrow()
        keys = part["gram"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        yield keys[order], part["ratio"].to_numpy()[order]


class Lookup:
    """An open hash table over sorted keys: from a key's mixed top bits to where to start."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.shift = _U(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.float32)
        self.depth = 0
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each round places the keys whose place is free
            free = self.keys[slot] == 0
            at, first = np.unique(slot[free], return_index=True)
            who = left[free][first]
            self.keys[at], self.values[at] = keys[who], values[who]
            done = self.keys[slot] == keys[left]
            left, slot = left[~done], (slot[~done] + 1) & ((1 << bits) - 1)
            self.depth += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        hit = self.keys[slot] == keys
        out = np.where(hit, self.values[slot], np.float32(0))
        left = np.flatnonzero(~hit & (self.keys[slot] != 0))
        slot = slot[left]
        for _ in range(self.depth):
            if not len(left):
                break
            slot = (slot + 1) & (len(self.keys) - 1)
            hit = self.keys[slot] == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (self.keys[slot] != 0)
            left, slot = left[go], slot[go]
        return out


_lookups: dict[str, Lookup] = {}


def _lookup(key: str, shared) -> Lookup:
    """A worker's table, built once; `key` names it, whatever objects the worker meets."""
    if key not in _lookups:
        _lookups.clear()
        _lookups[key] = Lookup(*shared.value)
    return _lookups[key]


def evidence(docs: DataFrame, tables: list[tuple]) -> DataFrame:
    """Adds `__value`, the difference of length-normalised log-likelihoods; other columns stay. `tables` holds (broadcast block, key)."""
    out = docs.withColumn("__value", F.lit(0.0))
    for n, (shared, key) in enumerate(tables):
        out = mapped(kept(out) if n else out, _pass(shared, key), T.StructType([*docs.schema.fields, T.StructField("__value", T.DoubleType())]))
    return out.withColumn("__value", F.signum("__value") * F.log1p(F.abs("__value") / UNIT))


def _pass(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = None
        for whole in batches:
            for batch in slices(whole):
                lookup = lookup or _lookup(key, shared)
                x, sizes = grams(utf8(batch["text"]))
                sums = np.append(0, np.cumsum(lookup(x), dtype=np.float64))
                ends = np.cumsum(sizes)
                mean = (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(batch["__value"].to_numpy() + mean)], names=batch.schema.names)

    return run


#: The calibration fold is summed in this many steps for each unit of the value, so that what is collected doesn't grow.
STEPS = 200


def logistic(values: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) by Newton's method with a small ridge; the slope isn't negative."""
    scale = max(float(np.sqrt(np.average(values**2, weights=weight))), 1e-9)
    x = np.stack([values / scale, np.ones(len(values))], 1)
    theta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (toxic - p)) - 1e-2 * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.0) / scale, float(theta[1])


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = 2_000_000, slot_bits: int = 20) -> DataFrame:
    """Adds `held_out`, `score` and `predicted` to the rows of `docs` (doc_id, text); other columns stay."""
    spark = docs.sparkSession
    known = _labels(labels, fit_rows).toArrow()
    ids, toxic, fold = (known[c].to_numpy() for c in ("doc_id", "toxic", "fold"))
    order = np.argsort(ids, kind="stable")
    ids, toxic, fold = ids[order].astype(np.int64), toxic[order], fold[order]
    learn, tune = fold != 4, fold == 4
    add = lambda df, value: df.withColumns({"held_out": F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)), "score": value, "predicted": (value >= 0.5).cast("int")})
    if any(not (toxic[part] == c).any() for part in (learn, tune) for c in (0, 1)):
        return add(docs, F.lit(0.0))
    table = kept(count(docs, ids[learn], toxic[learn].astype(np.int64)))
    tables = [(spark.sparkContext.broadcast(block), uuid.uuid4().hex) for block in blocks(log_ratios(table), slot_bits)]
    pairs = spark.createDataFrame(known.filter(pa.array(known["fold"].to_numpy() == 4)).select(["doc_id", "toxic"]))
    fitted = evidence(docs.where(_fold(F.col("doc_id")) == 4).select("doc_id", "text"), tables).select("doc_id", "__value").join(pairs, "doc_id")
    bins = fitted.groupBy(F.round(F.least(F.greatest(F.col("__value"), F.lit(-10.0)), F.lit(10.0)) * STEPS).alias("bin"), "toxic").agg(F.count(F.lit(1)).alias("n")).toArrow()
    if len(set(bins["toxic"].to_pylist())) < 2:  # no document of a class in the calibration fold
        return add(docs, F.lit(0.0))
    slope, intercept = logistic(bins["bin"].to_numpy() / STEPS, bins["toxic"].to_numpy(), bins["n"].to_numpy().astype(float))
    return add(evidence(docs, tables), F.lit(1.0) / (F.exp(-(F.col("__value") * slope + intercept)) + 1)).drop("__value")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op6's contract."""
    return score(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted to be toxic, with their own columns."""
    return spared(docs, ("held_out", "score", "predicted"), lambda own: score(own, labels).where("predicted = 0"))
