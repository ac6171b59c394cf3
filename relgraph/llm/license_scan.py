"""Licence scans: one Aho-Corasick automaton over notice phrases, and a shunting-yard parser of licence expressions.

Texts are normalised to words as for decontamination. The automaton holds the phrases as words between single
spaces, so a match starts and ends at word borders, overlapping ones included. Where it meets an identifier tag
(`SPDX-License-Identifier`), the rest of that line in the original text is read as an expression: identifiers,
`and`, `or`, `with` (binding tightest in the order with, and, or) and parentheses. What can't be parsed, or names
what isn't an identifier (a known family and form, `LicenseRef-...`, after `with` an exception), gives no label. Of
further phrases that begin at one word only the longest counts; the contract's base phrases all count. Labels are those of the phrases, and the method's own ones: identifiers of expressions as `spdx:<id>`, the
most permissive choice as `choice:<id and ...>`, and further notices (`bsd`, `cc-by`, `mpl`, `isc`, `unlicense`).

The score is how surely the text carries a licence: 1 - product of (1 - weight) over distinct evidence, a tag
weighing 0.95, a phrase of four words or more 0.8, a shorter one 0.6; 0 without evidence.

Edge cases: null and empty texts have no words, no label and score 0; a tag without a valid expression weighs 0.3;
repeated rows are scanned each; an empty table gives an empty result; other columns stay. Map-only: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ALNUM, mapped, slices, utf8

#: Phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of further notices, and the tag.
MORE = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"(?i)spdx-license-identifier[ \t]*:?[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
RANK = {"or": 1, "and": 2, "with": 3}
#: Identifiers are a family, mostly with a version and a form; these are the common ones of the public list.
FAMILIES = (
    r"0bsd|afl|agpl|apache|apsl|artistic|beerware|blueoak|bsd|bsl|bzip2|cc-by|cc-by-sa|cc-by-nc|cc-by-nd|cc-by-nc-sa|cc-by-nc-nd|cc0|cddl|cecill|cecill-b|cecill-c|cpal|cpl|curl|ecl|efl|epl|eupl|ftl"
    r"|gfdl|gpl|hpnd|ijg|ipl|isc|lgpl|libpng|lppl|mit|mit-cmu|mpl|ms-pl|ms-rl|mulanpsl|ncsa|nposl|odbl|ofl|openssl|osl|php|postgresql|psf|python|qpl|ruby|sgi-b|sleepycat|ssh|sspl|unicode|unicode-dfs|unlicense|upl|vim|w3c|wtfpl|x11|xfree86|zlib|zpl"
)
IDENTIFIER = re.compile(rf"(?:(?:{FAMILIES})(?:-\d+(?:\.\d+)*)?(?:-(?:only|or-later|clause(?:-[a-z]+)*))?\+?|bsd-\d-clause(?:-[a-z]+)*|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|none|noassertion)")
EXCEPTION = re.compile(r"[a-z0-9.-]*exception(?:-\d+(?:\.\d+)*)?|llvm-exception|linux-syscall-note|additionref-[a-z0-9.-]+")
#: Identifiers by how little they ask, first the most permissive; others rank last.
PERMISSIVE = ("0bsd", "unlicense", "cc0-1.0", "mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0", "mpl-2.0", "lgpl-2.1-only", "lgpl-3.0-only", "gpl-2.0-only", "gpl-3.0-only", "agpl-3.0-only")


def parse(text: str) -> list[str] | None:
    """Postfix order of an expression by the shunting-yard algorithm; None if it isn't one."""
    out: list[str] = []
    ops: list[str] = []
    operand = True  # whether one is due
    cut = re.sub(r"(\*/|-->|#|//).*", "", text)
    for raw in TOKEN.findall(cut):
        token = raw.lower().rstrip(".:")
        if token in RANK and not operand:
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[token]:
                out.append(ops.pop())
            ops.append(token)
            operand = True
        elif raw == "(" and operand:
            ops.append(raw)
        elif raw == ")" and not operand:
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif token and token not in RANK and raw not in "()" and operand:
            out.append(token)
            operand = False
        elif not operand and "(" not in ops and token not in RANK and raw not in "()":
            break  # prose after the expression
        else:
            return None
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def known(postfix: list[str]) -> bool:
    """Whether all operands are identifiers, those right of `with` exceptions."""
    stack: list[bool | str] = []
    for token in postfix:
        if token not in RANK:
            stack.append(token)
            continue
        b, a = stack.pop(), stack.pop()
        good = lambda x, form: x is True or isinstance(x, str) and form.fullmatch(x) is not None
        stack.append(good(a, IDENTIFIER) and good(b, EXCEPTION if token == "with" else IDENTIFIER))
    return stack[0] is True or isinstance(stack[0], str) and IDENTIFIER.fullmatch(stack[0]) is not None


def evaluate(postfix: list[str]) -> tuple[set[str], tuple[str, ...]]:
    """All identifiers, and the choice that asks least: `or` chooses, `and` and `with` join."""
    rank = {x: i for i, x in enumerate(PERMISSIVE)}
    stack: list[tuple[str, ...]] = []
    ids: set[str] = set()
    for token in postfix:
        if token not in RANK:
            ids.add(token)
            stack.append((token,))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "or":
            stack.append(min(a, b, key=lambda x: (max(rank.get(y, 99) for y in x), len(x), x)))
        elif token == "and":
            stack.append(tuple(sorted({*a, *b})))
        else:
            stack.append((*a[:-1], f"{a[-1]} with {b[0]}"))
    return ids, stack[0]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in {**BASE, **MORE, TAG: ""}:
        a.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    a.make_automaton()
    return a


def scan_text(text: bytes, a: ahocorasick.Automaton) -> dict:
    words = text.translate(ALNUM).split()
    flat = b" ".join(words).decode("utf-8", "replace")
    joined = f" {flat} "
    base: list[tuple[int, str]] = []
    seen: set[str] = set()
    labels: set[str] = set()
    weights: dict[str, float] = {}
    places = [(end, phrase, n) for end, (phrase, n) in a.iter(joined)]
    last, spaces = 0, 0
    longest: dict[int, int] = {}  # by where they begin
    for end, phrase, n in places:
        begin = end - len(phrase) - 1
        longest[begin] = max(longest.get(begin, 0), n)
    for end, phrase, n in places:
        spaces += joined.count(" ", last, end)  # ends rise; the space at `end` isn't counted
        last = end
        if phrase not in BASE and n < longest[end - len(phrase) - 1]:
            continue
        seen.add(phrase)
        if phrase in BASE:
            base.append((spaces - n, BASE[phrase]))
        elif phrase != TAG:
            labels.add(MORE[phrase])
        if phrase != TAG:
            weights[phrase] = 0.8 if n >= 4 else 0.6
    if TAG in seen:
        weights[TAG] = 0.3
        for m in TAG_LINE.finditer(text):
            postfix = parse(m[1].decode("utf-8", "replace"))
            if postfix and known(postfix):
                ids, choice = evaluate(postfix)
                labels |= {f"spdx:{x}" for x in ids}
                labels.add("choice:" + " and ".join(choice))
                weights[TAG] = 0.95
    base_labels = {x for _, x in base}
    rest = 1.0
    for phrase in sorted(weights):
        rest *= 1 - weights[phrase]
    starts = [x for x, _ in base]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | labels)), "score": round(1 - rest, 6) if weights else 0.0,
    }


ADDED = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
]
ARROW = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the columns of `ADDED` (of equal names, the new ones stay); other columns stay."""
    rest = docs.drop(*ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for whole in batches:
            for batch in slices(whole, text_col):
                found = [scan_text(t, a) for t in utf8(batch[text_col])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], kind) for k, kind in ARROW.items())], names=[*batch.schema.names, *ARROW])

    return mapped(rest, run, T.StructType(rest.schema.fields + ADDED))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op8's contract."""
    return scan(docs.select("doc_id", "text")).select("doc_id", *ARROW)
