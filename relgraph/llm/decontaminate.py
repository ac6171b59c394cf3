"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items and texts are normalised alike (A-Z lower-cased, words of digits, letters and non-ASCII characters). Each
word of the items is coded as one character. Any window of `window` words holds a whole piece of half that length, rounded
up, that begins at a multiple of it in the item; these pieces, and items shorter than a window, go into one automaton,
whose size so is that of the items and not of all their windows. A text is scanned once; where a piece is met, the text
is compared with the item to both sides, and a run of `window` words or more is hit. Words that no item has are coded as a
character that no piece holds. Word positions map back to the original text: `spans` gives character ranges there.

The benchmark is broadcast in blocks of at most about `block_bytes` of item text and `WORDS_MOST` distinct words, gathered one
at a time; long items are divided into parts that overlap by a window. Each block is a map-only pass that carries the hits on,
and the rows are written between passes, so memory stays bounded for any benchmark and no row is shuffled.

Edge cases: null and empty texts have no words and aren't contaminated; items without words are ignored; items that
repeat an id count once; items with equal windows are all reported; repeated rows are scanned each; an empty
benchmark hits nothing; an empty table gives an empty result; columns named like an added one are replaced, others stay.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, kept, mapped, slices, spared, utf8

WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Distinct words of a block (codes are characters), and words of a part of a long item.
WORDS_MOST, PART = 900_000, 100_000
_built: dict[str, tuple] = {}


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ALNUM).split()


def compile_items(items: list[tuple[object, str | None]], size: int) -> tuple[dict[bytes, str], tuple[int, list[tuple[str, list[str]]]]]:
    """The words' codes, and the coded items, each once, with the ids of those that are equal."""
    codes: dict[bytes, str] = {}
    held: dict[str, set[str]] = {}
    for item, text in items:
        words = _words(text)
        for word in words:
            if word not in codes:
                n = len(codes) + 1
                codes[word] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
        if words:
            held.setdefault("".join([codes[w] for w in words]), set()).add(str(item))
    return codes, (size, [(k, sorted(v)) for k, v in held.items()])


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, size: int = 13) -> Iterator[list[tuple[object, str | None]]]:
    out: list[tuple[object, str | None]] = []
    held, distinct = 0, set()
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        words = _words(text)
        parts = [text] if len(words) <= PART else [b" ".join(words[i : i + PART + size - 1]).decode("utf-8", "replace") for i in range(0, len(words) - size + 1, PART)]
        for part in parts:
            n = len((part or "").encode())
            if out and (held + n > block_bytes or len(distinct) > WORDS_MOST):
                yield out
                out, held, distinct = [], 0, set()
            out.append((item, part))
            held += n
            distinct.update(_words(part))
    if out:
        yield out


class Matcher:
    """The automaton over pieces and short items, and the items that pieces are extended in."""

    def __init__(self, size: int, items: list[tuple[str, list[str]]]):
        self.size, self.items = size, items
        piece = (size + 1) // 2
        found: dict[str, tuple[list[str], list[tuple[int, int]]]] = {}
        for n, (coded, ids) in enumerate(items):
            if len(coded) < size:
                found.setdefault(coded, ([], []))[0].extend(ids)
            else:
                for at in range(0, len(coded) - piece + 1, piece):
                    found.setdefault(coded[at : at + piece], ([], []))[1].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for coded, (ids, places) in found.items():
            self.automaton.add_word(coded, (len(coded), ids, places))
        if found:
            self.automaton.make_automaton()

    def __call__(self, coded: str) -> tuple[list[list[int]], set[str]]:
        """Ranges of hit places, merged, and the items."""
        ranges: list[list[int]] = []
        found: set[str] = set()
        upto: dict[tuple[int, int], int] = {}  # of an item laid at a place, where its last run ended
        for end, (length, ids, places) in self.automaton.iter(coded) if len(self.automaton) else ():
            at = end - length + 1
            if ids:
                found.update(ids)
                ranges.append([at, end + 1])
            for n, offset in places:
                if upto.get((n, at - offset), 0) > at:
                    continue
                item, own = self.items[n]
                a, b, shift = at, end + 1, offset - at
                while a > 0 and a + shift > 0 and coded[a - 1] == item[a - 1 + shift]:
                    a -= 1
                while b < len(coded) and b + shift < len(item) and coded[b] == item[b + shift]:
                    b += 1
                upto[n, at - offset] = b
                if b - a >= self.size:
                    found.update(own)
                    ranges.append([a, b])
        return _merged(ranges), found


def _automaton(key: str, coded: tuple) -> tuple[dict[bytes, str], Matcher]:
    """A worker's matcher, built once and kept until another block's takes its place."""
    if key not in _built:
        _built.clear()
        _built[key] = coded[0], Matcher(*coded[1])
    return _built[key]


def find(text: bytes, codes: dict[bytes, str], matcher: Matcher) -> tuple[int, list[list[int]], set[str]]:
    """Number of words, the merged ranges of hit words, and the items."""
    words = text.translate(ALNUM).split()
    get = codes.get
    return len(words), *matcher("".join([get(w, "\0") for w in words]))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """Adds `n_words`, `hit_ranges` (word ranges, end exclusive) and `item_ids` to the rows; other columns stay."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    out = docs.drop(*[f.name for f in added])
    schema = T.StructType(out.schema.fields + added)
    sc = docs.sparkSession.sparkContext
    coded = None
    for block in blocks(benchmark, item_col, item_text_col, block_bytes, size):
        if coded:
            out = kept(out)
            coded.destroy()  # the rows it gave are written
        first, coded = coded is None, sc.broadcast(compile_items(block, size))
        out = mapped(out, _pass(coded, uuid.uuid4().hex, text_col, first), schema)
    return out if coded else mapped(out, _pass(sc.broadcast(compile_items([], size)), uuid.uuid4().hex, text_col, True), schema)


def _pass(coded, key: str, text_col: str, first: bool):
    """`key` names the automaton in a worker, whatever objects it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, matcher = _automaton(key, coded.value)
        for whole in batches:
            for batch in slices(whole, text_col):
                count, ranges, items = [], [], []
                old = [None] * len(batch) if first else list(zip(batch["hit_ranges"].to_pylist(), batch["item_ids"].to_pylist(), strict=True))
                for text, before in zip(utf8(batch[text_col]), old, strict=True):
                    n, r, i = find(text, codes, matcher)
                    if before:
                        r, i = _merged(r + before[0]), i | set(before[1])
                    count.append(n)
                    ranges.append(r)
                    items.append(sorted(i))
                names = [n for n in batch.schema.names if first or n not in ("n_words", "hit_ranges", "item_ids")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[n] for n in names), pa.array(count, pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
                    names=[*names, "n_words", "hit_ranges", "item_ids"],
                )

    return run


def _merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def spans(text: str, ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Character ranges of word ranges in the original text."""
    raw = text.encode()
    at = [m.span() for m in WORDS.finditer(raw)]
    return [(len(raw[: at[a][0]].decode()), len(raw[: at[b - 1][1]].decode())) for a, b in ranges]


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + F.get(r, 1) - F.get(r, 0))
    return scan(docs, benchmark).withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of op5's contract."""
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return _judged(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    added = ("n_words", "hit_ranges", "item_ids", "n_hit", "contaminated")
    return spared(docs, added, lambda own: _judged(own, benchmark).where(~F.col("contaminated")))


def sha_of(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
