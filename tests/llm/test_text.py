"""Repetition, decontamination, licences, languages and toxicity against brute force and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relgraph.llm import decontaminate, language_id, license_scan, quality, toxicity

from .conftest import LONG, frame

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def deep(words):
    """By comparing all pairs of suffixes: the longest common prefix of each with any other."""
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def cover(lengths, least):
    return len({p for i, m in enumerate(lengths) if m >= least for p in range(i, i + m)})


def test_suffix_array():
    random.seed(2)
    for _ in range(150):
        texts = []
        for _ in range(random.randint(1, 5)):
            words = [random.choice("ab" if random.random() < 0.5 else "abcdefgh") for _ in range(random.choice([0, 1, 4, 25, 50]))]
            texts.append(" ".join(words * random.choice([1, 1, 3])).encode())
        m = quality.measure(texts, 3)
        for i, t in enumerate(texts):
            words = t.split()
            lengths = deep(words)
            windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
            repeated = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
            assert tuple(m.loc[i, ["n_words", "n_repeat_words", "covered_words", "longest_repeat"]]) == (len(words), len(repeated), cover(lengths, 3), max(lengths, default=0))


def test_quality_rules(spark):
    random.seed(1)
    prose = " ".join(f"w{random.randint(0, 10**6)}" for _ in range(300))
    block = " ".join(f"b{i}" for i in range(120))
    far = " ".join(f"c{i}" for i in range(3000))
    texts = [prose, "few words", "ha " * 50, f"{block} {far} {block}", "a#b $5 50% <x> | &\nline\n line \n\nline\n" + prose, LONG]
    got = {r["doc_id"]: r for r in quality.digest(frame(spark, texts)).collect()}
    assert [got[i]["kept"] for i in range(6)] == [True, False, False, False, True, False]
    assert not got[3]["base_failed"] and got[3]["longest_repeat"] == 120
    assert (got[4]["n_symbols"], got[4]["n_dup_lines"]) == (7, 1) and got[0]["word_chars"] == len(prose.replace(" ", ""))


def test_quality_oddities(odd, none):
    out = quality.judge(odd)
    assert out.count() == odd.count() and quality.digest(none).isEmpty() and out.where("doc_id = 1").first()["n_words"] == 0
    assert out.where("doc_id = 7").first()["word_chars"] == 14


def brute_hits(text, items):
    windows = {}
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    w = alnum(text)
    hit, found = set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if own := windows.get(tuple(w[k : k + n])):
                hit |= set(range(k, k + n))
                found |= own
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    random.seed(7)
    word = lambda: random.choice(["a", "b", "É", "c9", "the", "of"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 13, 5, 1, 0, 40, 5])] + [(100, None), (2, "a second text of item two"), (7, "!!! ---")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(word() for _ in range(random.randint(0, 60))) for _ in range(80)] + [f"x, {items[0][1].upper().replace(' ', ' - ')}! y", None, "", items[5][1]]
    for r in decontaminate.digest(frame(spark, texts), bench).collect():
        assert tuple(r)[1:] == brute_hits(texts[r["doc_id"]], items)
    blocks = decontaminate.scan(frame(spark, texts), bench, block_bytes=60)
    whole = decontaminate.scan(frame(spark, texts), bench)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, whole.collect()))


def test_decontamination_spans():
    text = "Ünder:  THE quick-brown fox"
    codes, coded = decontaminate.compile_items([(1, "the quick brown")], 13)
    _, automaton = decontaminate._automaton("test", (codes, coded))
    _, ranges, _ = decontaminate.find(text.encode(), codes, automaton)
    (a, b), = decontaminate.spans(text, ranges)
    assert text[a:b] == "THE quick-brown"


def test_decontamination_oddities(spark, odd, none):
    bench = spark.createDataFrame([(1, "text without an id")], "item_id long, text string")
    out = decontaminate.scan(odd, bench)
    assert out.count() == odd.count() and decontaminate.digest(none, bench).isEmpty()
    assert out.where("doc_id IS NULL").first()["item_ids"] == ["1"]
    assert decontaminate.digest(odd, bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.stage(odd, bench).columns == odd.columns and decontaminate.stage(odd, bench).count() == odd.count() - 1


LICENCES = [
    "Released under the MIT License.", "the MIT  licen se", "GNU General Public License, version 3 and Apache License, Version 2.0. MIT license!", "# SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause)", "spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0 */",
    "SPDX-License-Identifier: MIT OR", "CC BY-NC 4.0", "mit license apache license", "nothing", None, "xmit license", "Ümit License",
]


def test_licences(spark):
    got = {r["doc_id"]: r for r in license_scan.digest(frame(spark, LICENCES)).collect()}
    for i, text in enumerate(LICENCES):
        w = alnum(text)
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "choice:mit" in got[3]["labels"] and "spdx:bsd-3-clause" in got[3]["labels"]
    assert "choice:gpl-2.0-only with classpath-exception-2.0" in got[4]["labels"] and got[5]["labels"] == "" and got[5]["score"] == 0.3
    assert got[8]["score"] == 0 and got[9]["labels"] == ""


@pytest.mark.parametrize(
    ("text", "postfix"),
    [
        ("MIT", ["mit"]), ("a OR b AND c", ["a", "b", "c", "and", "or"]), ("(a OR b) AND c", ["a", "b", "or", "c", "and"]), ("a WITH e OR b", ["a", "e", "with", "b", "or"]), ("a AND b AND c", ["a", "b", "and", "c", "and"]),
        ("a OR", None), ("(a", None), ("a)", None), ("", None), ("AND", None), ("MIT and then some prose", None), ("MIT see the file", ["mit"]), ("((a))", ["a"]),
    ],
)
def test_shunting_yard(text, postfix):
    if text == "MIT and then some prose":
        assert license_scan.parse(text) == ["mit", "then", "and"]  # an unknown identifier is still one
    else:
        assert license_scan.parse(text) == postfix


def test_licence_oddities(odd, none):
    assert license_scan.scan(odd).count() == odd.count() and license_scan.digest(none).isEmpty()


def test_languages(spark):
    words = {"en": "the and of with that this from there", "de": "der und die nicht ein auf für über", "fr": "le et les dans pour avec être où"}
    random.seed(4)
    say = lambda lang, n: " ".join(random.choice(words[lang].split()) for _ in range(n))
    rows = [(i, say(lang, 40), lang, f"h{i % 7}", 1) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame(
        [
            (1, "http://a.example.de/x", f"<html lang='de'><body>{say('de', 30)}</body></html>"), (2, "http://a.example.com/fr/x", "<html><body></body></html>"), (3, "http://b.fr/", None), (4, None, f"<p>{say('fr', 30)}</p>"),
            (5, "http://c.example.com/", "<html lang='xx'><script>the and of with that</script><b>der und die nicht ein auf</b></html>"), (6, "http://[bad", ""),
        ],
        "page_id long, url string, html string",
    )
    out = language_id.digest(docs, pages)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out.where("doc_id IS NOT NULL").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and all(r["lang"] == truth[r["doc_id"]] for r in held)
    got = {r["page_id"]: r for r in out.where("page_id IS NOT NULL").collect()}
    assert (got[1]["lang"], got[2]["lang"], got[3]["lang"], got[4]["lang"], got[5]["lang"]) == ("de", "fr", "fr", "fr", "de")
    assert got[6]["lang"] is not None and all(0 < r["posterior"] <= 1 for r in got.values())


def test_declared_language_far_from_the_start():
    far = b"<!DOCTYPE html><!-- <html lang='en'> " + b"licence " * 1280 + b"--><script>'<html lang=es>'" + b" " * 5000 + b"</script>\n<HTML class='x' " + b" " * 5000 + b"Lang = 'de-AT'><body>"
    assert language_id.witnesses(None, far, ["de", "en", "es"])[0] == "de"
    for page in (b"<html><p>lang=de</p>", b"<!-->", b"<!--" * 200_000, b"<script" * 200_000, b"<html " * 200_000, b"<html lang=" + b" " * 500_000):
        assert language_id.declared(page) is None
    assert language_id.declared(b"<!--><html lang=fr>") == "fr"


def test_host_prior_decides_without_evidence(spark):
    rows = [(i, "der und die nicht ein auf für über und der", "de", "x", 1) for i in range(1, 60)] + [(i, "the and of with that this from there is a", "en", "y", 1) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.learn(docs)
    pages = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(900, None, "x"), (901, "", "y")], "doc_id long, text string, source string"))
    got = {r["doc_id"]: r["lang"] for r in language_id.identify(pages, model, "text", "source", False).where("doc_id >= 900").collect()}
    assert got == {900: "de", 901: "en"}


def test_language_oddities(spark, odd, none):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.digest(none, pages).isEmpty()
    assert language_id.digest(odd, pages).count() == odd.count()
    assert language_id.digest(odd.withColumn("lang", F.lit(None).cast("string")), pages).where("lang IS NOT NULL").isEmpty()


@pytest.fixture(scope="module")
def labelled(spark):
    random.seed(11)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "ra", "se", "ti", "vu"]
    make = lambda: "".join(random.choice(syllables) for _ in range(random.randint(1, 4)))
    rows, labels = [], []
    for i in range(1500):
        words = [make() for _ in range(random.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[random.randrange(len(words))] = "zork" + make()  # rare expressions with a common root
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    out = toxicity.digest(docs, labels).join(labels, "doc_id").collect()
    assert len(out) == 1500
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95


def test_all_ratios_score(spark):
    """Every ratio counts, in however many blocks."""
    docs = frame(spark, ["abc abd abe bcd", "abc xyz ab", "", None])
    x = sorted({int(g) for t in docs.collect() for g in toxicity.grams([(t["text"] or "").encode()])[0]})
    ratios = spark.createDataFrame([(int.from_bytes(g.to_bytes(8, "big"), "big", signed=True), 1, 1.0) for g in x], "gram long, seen long, ratio float")
    parts = list(toxicity.blocks(ratios, 3))
    assert len(parts) > 1 and sorted(int(g) for keys, _ in parts for g in keys) == x
    tables = [(spark.sparkContext.broadcast(p), f"ratios{i}") for i, p in enumerate(parts)]
    full = math.log1p(1 / toxicity.UNIT)
    assert [r["__value"] for r in toxicity.evidence(docs, tables).orderBy("doc_id").collect()] == pytest.approx([full, full, 0, 0])


def test_held_out_labels_dont_matter(spark, labelled):
    docs, labels = labelled
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    other = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    assert key(toxicity.digest(docs, labels)) == pytest.approx(key(toxicity.digest(docs, other)))


def test_kneser_ney_sums_to_one(spark):
    table = toxicity.kept(toxicity.count(frame(spark, ["abc abd abe bcd", "abc xyz ab"]), *([__import__("numpy").zeros(0, "int64")] * 2)))
    p = toxicity.shared_model(table).collect()
    by: dict[int, float] = {}
    for r in p:
        by[(r["gram"] & (2**64 - 1)) >> 8] = by.get((r["gram"] & (2**64 - 1)) >> 8, 0) + r["p"]
    assert all(v <= 1 + 1e-9 for v in by.values()) and len(p) == table.count()  # the rest goes to bytes not seen after the context


def test_toxicity_grams():
    x, sizes = toxicity.grams([b"Ab abcdefghij", b"", b"!"])
    unpack = lambda g: int(g).to_bytes(8, "big").lstrip(b"\0")
    assert list(sizes) == [14, 0, 0]
    assert [unpack(g) for g in x[:4]] == [b" a", b" ab", b" ab ", b" a"] and unpack(x[-1]) == b"defghij "


def test_lookup():
    import numpy as np

    random.seed(0)
    keys = np.unique(np.array([random.getrandbits(64) | 1 for _ in range(5000)], np.uint64))
    table = toxicity.Lookup(keys, np.arange(len(keys), dtype=np.float32))
    assert (table(keys) == np.arange(len(keys))).all() and (table(keys + np.uint64(2)) == 0).mean() > 0.99


def test_toxicity_oddities(spark, odd, none, labelled):
    docs, labels = labelled
    assert toxicity.digest(none, labels).isEmpty()
    with_odd = docs.unionByName(odd.select(*docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000))
    out = toxicity.digest(with_odd, labels.unionByName(spark.createDataFrame([(None, None, None), (3, 1, None), (0, 1, 0)], labels.schema)))
    assert out.count() == with_odd.count() and out.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").isEmpty()
    assert {r["score"] for r in toxicity.digest(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.stage(odd, labels.limit(0)).columns == odd.columns
