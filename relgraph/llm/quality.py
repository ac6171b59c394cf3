"""Quality rules on repetition, from a suffix array of each text's words.

Texts are handled a few megabytes at a time: their words become integers, each text ends in a separator of its own, and
one suffix array over all of them is built by prefix doubling, which sorts again only the suffixes whose rank is
still shared. The ranks of each level give the longest common prefix of neighbours in the array by binary lifting.
A suffix's deepest LCP interval has the value m = max(LCP with the neighbour before, with the one after), so the
union of spans [i, i + m) over suffixes with m of `least` words or more is the union of all occurrences of all
maximal repeated substrings, and the largest m is the longest repeat.

A text passes if the spans cover at most `cover` of its words and the longest repeat is at most `longest` words.

Edge cases: null and empty texts have no words and fail the base rule on length; a text of one repeated word is all
covered; repeated rows are judged each; an empty table gives an empty result; other columns stay. Map-only: nothing is
shuffled, memory is bounded by one slice or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped, slices, utf8

SYMBOLS = b"#*$%&|<>"
WHITE_BYTES = b" \t\n\x0b\x0c\r"


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP with the suffix before, of integers in which the last is unique.

    Each text ends in a unique separator, so no common prefix passes the end of a text.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        shared = np.zeros(n, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        if not shared.any():
            break
        at = np.flatnonzero(shared)
        who = order[at]
        second = rank[np.minimum(who + step, n - 1)]  # a shared suffix has no separator in its first `step` tokens
        mine = rank[who]
        again = np.lexsort((second, mine))
        who, mine, second = who[again], mine[again], second[again]
        order[at] = who  # groups are contiguous, so each stays in its place
        fresh = np.ones(len(at), bool)
        fresh[1:] = (mine[1:] != mine[:-1]) | (second[1:] != second[:-1])
        new = rank.copy()
        new[who] = np.maximum.accumulate(np.where(fresh, at, 0))  # a group's rank: its first place
        # Unshared suffixes keep ranks of the old scale: places, too, once the first round is done.
        if step == 1:
            alone = np.flatnonzero(~shared)
            new[order[alone]] = alone
        rank = new
        levels.append(rank)
        step *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(n - 1, np.int64)
    live = np.arange(n - 1)
    for k in range(len(levels) - 1, -1, -1):
        # As 2^k tokens agree at most once per level once the higher ones have failed, each level is tried once.
        eq = levels[k][a[live]] == levels[k][b[live]]
        hit = live[eq]
        got[hit] += 1 << k
        a[hit] = np.minimum(a[hit] + (1 << k), n - 1)
        b[hit] = np.minimum(b[hit] + (1 << k), n - 1)
    lcp[1:] = got
    return order, lcp


def repeats(tokens: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring that starts there and also elsewhere."""
    order, lcp = suffix_array(tokens)
    deep = np.maximum(lcp, np.append(lcp[1:], 0))
    out = np.empty(len(tokens), np.int64)
    out[order] = deep
    return out


def covered(lengths: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Marks the places that spans of at least `least` cover; with `width`, each span counts that long only."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, np.minimum(at + (lengths[at] if width is None else width), n), -1)
    return np.cumsum(marks[:-1]) > 0


def measure(texts: list[bytes], least: int = 3, window: int = 5) -> pd.DataFrame:
    """The figures of each text."""
    split = [t.split() for t in texts]  # of bytes: at `[\x20\x09-\x0D]`
    counts = np.array([len(w) for w in split], np.int64)
    flat = [w for words in split for w in words]
    codes = pd.factorize(np.array([*flat, None], dtype=object)[:-1])[0].astype(np.int64) if flat else np.zeros(0, np.int64)
    docs = len(texts)
    # Words of different texts must differ, as repeats across texts don't count: the first rank is of (text, word).
    ends = np.cumsum(counts) + np.arange(docs)  # places of the separators
    total = int(counts.sum()) + docs
    owner = np.repeat(np.arange(docs), counts + 1)
    tokens = np.full(total, -1, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    vocabulary = int(codes.max()) + 1 if len(codes) else 1
    tokens[inside] = codes
    tokens = owner * (vocabulary + 1) + tokens + 1
    deep = repeats(tokens) if total else np.zeros(0, np.int64)
    deep[ends] = 0
    begins = ends - counts
    sums = lambda marks: np.add.reduceat(np.append(marks & inside, False).astype(np.int64), np.ravel([begins, ends], "F"))[::2] if docs else np.zeros(0, np.int64)
    some = counts > 0
    rows = {
        "n_words": counts,
        "n_repeat_words": np.where(some, sums(covered(deep, window, window)), 0),
        "covered_words": np.where(some, sums(covered(deep, least)), 0),
        "longest_repeat": np.maximum.reduceat(deep, begins) if docs else counts,
    }
    chars, symbols, dup = [], [], []
    for t in texts:
        flat_text = t.translate(None, WHITE_BYTES)
        chars.append(len(flat_text.decode("utf-8", "replace")) if not flat_text.isascii() else len(flat_text))
        symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return pd.DataFrame(rows | {"word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup})


ADDED = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "covered_words": pa.int64(), "longest_repeat": pa.int64(),
}
SPARK = {"int64": T.LongType(), "bool": T.BooleanType()}


def judge(docs: DataFrame, least: int = 8, cover: float = 0.2, longest: int = 100, text_col: str = "text") -> DataFrame:
    """Adds the columns of `ADDED` (of equal names, the new ones stay); other columns stay."""
    rest = docs.drop(*ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                m = measure(utf8(batch[text_col]), least)
                m["base_failed"] = (m.n_words < 10) | (100 * m.n_repeat_words > 20 * m.n_words)
                m["kept"] = ~m.base_failed & (m.covered_words <= cover * m.n_words) & (m.longest_repeat <= longest)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m[k].to_numpy(), kind) for k, kind in ADDED.items())], names=[*batch.schema.names, *ADDED])

    return mapped(rest, run, T.StructType(rest.schema.fields + [T.StructField(k, SPARK[str(v)]) for k, v in ADDED.items()]))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op4's contract, and what the verdict rests on."""
    return judge(docs.select("doc_id", "text")).select("doc_id", *ADDED)
