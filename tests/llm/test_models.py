"""Language models, fusion, quality figures and licence labels, each recomputed plainly; callers' columns and bounds."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from relgraph.llm import decontaminate, language_id, license_scan, line_dedup, mixing, near_dedup, quality, secret_scan, toxicity, warc

from .conftest import frame
from .test_text import alnum, brute_hits, deep

WHITE = r"[^\x20\x09-\x0D]+"


def plain_grams(text, most):
    """Each byte of a word but the space before the first, after up to `most` - 1 bytes from the word's leading space on."""
    words = [w.encode() for w in alnum(text)]
    flat = b" " + b" ".join(words) + b" " if words else b""
    out = []
    for i in range(1, len(flat)):
        begin = flat.rfind(b" ", 0, i)
        out.append(flat[max(begin, i - most + 1) : i + 1])
    return out


def kneser_ney(counts):
    """P of each gram by interpolated Kneser-Ney over the orders 8, 5, 3, 1."""
    levels = [counts]
    for order in (5, 3, 1):
        levels.append(Counter(g[-order:] for g in levels[-1]))
    p = {g: n / sum(levels[-1].values()) for g, n in levels[-1].items()}
    for level, order in zip(levels[-2::-1], (1, 3, 5), strict=True):
        of, kinds = Counter(), Counter()
        for g, n in level.items():
            of[g[:-1]] += n
            kinds[g[:-1]] += 1
        p = {g: (max(n - 0.75, 0) + 0.75 * kinds[g[:-1]] * p[g[-order:]]) / of[g[:-1]] for g, n in level.items()}
    return p


TEXTS = ["abc abd abe bcd", "abc xyz ab", "abc abc abc abd", "zork zorkolo zork", "zorka zork abc", "Ünï abc 12", "", "zork zork zork abd xyz"]
TOXIC = {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 7: 1}


def test_class_models_against_a_plain_recomputation(spark):
    ids = np.array(sorted(TOXIC), np.int64)
    table = toxicity.kept(toxicity.count(frame(spark, TEXTS), ids, np.array([TOXIC[i] for i in ids.tolist()], np.int64)))
    unpack = lambda g: (g & (2**64 - 1)).to_bytes(8, "big").lstrip(b"\0")
    every = Counter(g for t in TEXTS for g in plain_grams(t, 8))
    by_class = [Counter(g for i, t in enumerate(TEXTS) if TOXIC.get(i) == c for g in plain_grams(t, 8)) for c in (0, 1)]
    assert {unpack(r["gram"]): (r["n"], r["n0"], r["n1"]) for r in table.collect()} == {g: (n, by_class[0][g], by_class[1][g]) for g, n in every.items()}
    p = kneser_ney(every)
    got = {unpack(r["gram"]): r["p"] for r in toxicity.shared_model(table).collect()}
    assert got == pytest.approx(p)
    want = {}
    for g in every:
        logs, off = [], []
        for n in by_class:
            of = sum(m for x, m in n.items() if x[:-1] == g[:-1])
            kinds = sum(x[:-1] == g[:-1] for x in n)
            logs.append(math.log((max(n[g] - 0.75, 0) + 0.75 * kinds * p[g]) / of if of else p[g]))
            off.append(abs(n[g] - of * p[g]) / math.sqrt(of * p[g] * (1 - p[g]) + 0.25))
        if max(off) >= toxicity.SIGMAS and abs(logs[1] - logs[0]) >= toxicity.FACTOR:
            want[g] = logs[1] - logs[0]
    ratios = {unpack(r["gram"]): r["ratio"] for r in toxicity.log_ratios(table).collect()}
    assert ratios == pytest.approx(want, rel=1e-5)


def test_language_posteriors_against_a_plain_recomputation(spark):
    rows = [(1, "der hund und die katze", "de", "a.x.de"), (2, "the dog and the cat", "en", "b.x.de"), (3, "un chien et le chat", "fr", "c.org"), (4, "the house", "en", "a.x.de"), (5, None, "en", None), (6, "die", "de", "b.x.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["de", "en", "fr"]
    slot = lambda g: ((int.from_bytes(g, "big") * 0x9E3779B97F4A7C15) % 2**64) >> 48
    seen = {lang: Counter(slot(g) for _, t, x, _ in rows if x == lang for g in plain_grams(t, 3)) for lang in names}
    size = 1 << language_id.BITS
    pages = [(1, "http://a.x.de/fr/q", "<html lang='de'><body>the dog</body></html>"), (2, "http://b.x.de/", "<script>der hund</script>"), (3, None, None), (4, "http://c.org/", "le chat et un chien " * 9), (5, "http://d.uk/en-GB/", "<p>katze</p>")]
    like = {}
    for i, url, html in pages:
        grams = plain_grams(language_id.visible((html or "").encode()).decode(), 3)
        like[i] = [sum(math.log((seen[x][slot(g)] + 0.5) / (sum(seen[x].values()) + 0.5 * size)) for g in grams) / max(len(grams), 1) * min(len(grams), language_id.EVIDENCE) for x in names]
        for lang, trust in {1: [("de", 0.9), ("fr", 0.8), ("de", 0.7)], 2: [("de", 0.7)], 5: [("en", 0.8), ("en", 0.7)]}.get(i, []):
            like[i] = [v + math.log(trust if x == lang else (1 - trust) / 2) for v, x in zip(like[i], names, strict=True)]
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    host = {1: ("a.x.de", "x.de"), 2: ("b.x.de", "x.de"), 3: ("", ""), 4: ("c.org", "c.org"), 5: ("d.uk", "d.uk")}
    by_host, by_domain, total = defaultdict(lambda: [0.0] * 3), defaultdict(lambda: [0.0] * 3), [0.0] * 3
    for i, v in like.items():
        for counts in (by_host[host[i]], by_domain[host[i][1]], total):
            for k, x in enumerate(soft(v)):
                counts[k] += x
    smooth = lambda n, mass, under: [(x + mass * u) / (sum(n) + mass) for x, u in zip(n, under, strict=True)]
    every = [(x + 1) / (sum(total) + 3) for x in total]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), language_id.learn(docs), "html", "url", True).collect()}
    for i, v in like.items():
        prior = smooth(by_host[host[i]], language_id.HOST_MASS, smooth(by_domain[host[i][1]], language_id.DOMAIN_MASS, every))
        post = soft([x + math.log(p) for x, p in zip(v, prior, strict=True)])
        assert got[i]["lang"] == names[post.index(max(post))] and got[i]["posterior"] == pytest.approx(max(post), rel=1e-4)


def test_quality_against_brute_force(spark):
    random.seed(8)
    texts = [None, "", " \n\t", "one line\none line\n\n \none line"]
    for _ in range(60):
        words = [random.choice(["a", "b#", "c|$", "Ünï", "d", "e", "<f>"] + [f"w{random.randint(0, 99)}"] * 20) for _ in range(random.choice([3, 12, 60]))]
        texts.append("".join(w + random.choice([" ", " ", "\n", "\t", "\x0b"]) for w in words * random.choice([1, 1, 2])))
    got = {r["doc_id"]: r for r in quality.digest(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words = re.findall(WHITE, text)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = len({p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)})
        lines = [x for x in text.split("\n") if re.search(WHITE, x)]
        spans = deep(words)
        span = len({p for k, m in enumerate(spans) if m >= 8 for p in range(k, k + m)})
        failed = len(words) < 10 or 100 * repeated > 20 * len(words)
        kept = not failed and span <= 0.2 * len(words) and max(spans, default=0) <= 100
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, failed, kept)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) == want


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: see LICENSE file", "", 0.3), ("SPDX-License-Identifier: MIT AND then", "", 0.3), ("CC BY-NC 4.0", "cc-by-nc", 0.6), ("cc by and cc by sa", "cc-by,cc-by-sa", 0.84), ("SPDX-License-Identifier: LicenseRef-Mine", "choice:licenseref-mine,spdx:licenseref-mine", 0.95),
        ("GNU Lesser General Public License", "gpl,lgpl", 0.92), ("SPDX-License-Identifier: MIT WITH GPL-2.0-only", "", 0.3), ("SPDX-License-Identifier: GPL-2.0+", "choice:gpl-2.0+,spdx:gpl-2.0+", 0.95),
    ],
)
def test_licence_labels_and_scores(text, labels, score):
    found = license_scan.scan_text(text.encode(), license_scan.automaton())
    assert found["labels"] == labels and found["score"] == pytest.approx(score)


CLASHES = ("left", "share", "edge", "passes", "among", "n", "b", "w", "cap", "rest", "name", "none", "hashes", "run", "source_size", "at", "key", "node", "comp", "lead", "token", "part", "salt")


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns called like anything the operators use inside, each with a value of its own."""
    rows = frame(spark, ["a word or two\nand a line of text", "a token=abcdefghijklmnop here", None, "", "a line of text that is long enough\nmore", "a line of text that is long enough\nother"])
    mine = (*CLASHES, "n_lines", "n_dropped", "kept_text", "n_words", "n_hit", "contaminated", "hit_ranges", "item_ids", "held_out", "score", "predicted")
    return rows.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in mine})


def values(df, columns):
    return sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect())


def test_callers_columns_keep_their_values(spark, clashing):
    bench = spark.createDataFrame([(1, "nothing of this sort")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rest = [c for c in clashing.columns if c != "text"]
    for out in (line_dedup.stage(clashing), decontaminate.stage(clashing, bench), toxicity.stage(clashing, labels)):
        assert out.columns == clashing.columns and values(out, rest) == values(clashing, rest)
    assert near_dedup.stage(clashing).columns == clashing.columns
    free = [c for c in clashing.columns if c not in ("source_size", "size", "target", "taken")]
    assert values(mixing.mix(clashing), free) == values(clashing, free)
    assert values(secret_scan.scan(clashing), rest) == values(clashing, rest)
    free = [c for c in clashing.columns if c not in license_scan.ARROW]
    assert values(license_scan.scan(clashing), free) == values(clashing, free)
    free = [c for c in clashing.columns if c not in quality.ADDED]
    assert values(quality.judge(clashing), free) == values(clashing, free)


def test_mix_by_salts(spark):
    """A table of sources beyond the size that is broadcast gives the same mix."""
    random.seed(2)
    rows = frame(spark, ["w " * random.randint(0, 30) for _ in range(200)]).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("s"), F.col("doc_id") % 5)))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert values(mixing.mix(rows, small=-1), columns) == values(mixing.mix(rows), columns)


def test_decontamination_in_parts_and_blocks(spark, monkeypatch):
    """Long items are divided, blocks end at many distinct words, and nothing is lost at the seams."""
    random.seed(12)
    word = lambda: random.choice(["x", "y", "z", "ä"] + [f"v{random.randint(0, 300)}" for _ in range(3)])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([300, 13, 14, 12, 25, 26, 90, 3])]
    long = items[0][1].split()
    texts = [" ".join([word() for _ in range(9)] + long[a : a + n] + [word() for _ in range(9)]) for a, n in [(0, 13), (5, 12), (18, 30), (287, 13), (40, 200), (33, 13)]]
    texts += [" ".join(word() for _ in range(120)) for _ in range(20)] + [items[1][1] + " " + items[1][1], " ".join(["x"] * 60)]
    items.append((99, " ".join(["x"] * 40)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PART", 40)
    monkeypatch.setattr(decontaminate, "WORDS_MOST", 60)
    assert len(list(decontaminate.blocks(bench, "item_id", "text", 1 << 20))) > 2
    for r in decontaminate.digest(frame(spark, texts), bench).collect():
        assert tuple(r)[1:] == brute_hits(texts[r["doc_id"]], items)


def test_more_distinct_words_than_characters():
    """Codes are characters; a block ends before they run out, whatever the size of an item."""
    class Rows:
        def select(self, *columns):
            return self

        def toLocalIterator(self):  # noqa: N802
            yield 1, " ".join(map(str, range(1_200_000)))

    made = list(decontaminate.blocks(Rows(), "item_id", "text", 1 << 30))
    codes, (size, coded) = decontaminate.compile_items(made[0], 13)
    assert len(made) == 2 and size == 13 and len(codes) > 900_000 and max(map(ord, codes.values())) <= 0x10FFFF


def test_runs_are_read_where_they_lie(spark, tmp_path):
    """A batch meets the runs by their buckets: only its own hashes are dealt out."""
    store = line_dedup.RunStore(spark, f"file://{tmp_path}/s", fanout=4)
    make = lambda *hs: spark.createDataFrame([(h, 0, 1) for h in hs], "__h1 long, __h2 long, __owner long").groupBy("__h1", "__h2").agg(F.min("__owner").alias("__owner"))
    store.add(make(1, 2))
    store.add(make(2, 3))
    own = make(3, 4)
    for run in store.runs():
        own = own.join(run.select("__h1", "__h2").hint("merge"), ["__h1", "__h2"], "left_anti")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2
    assert [r["__h1"] for r in own.collect()] == [4]
    store.close()


def test_ranges_of_an_index_have_a_bound(spark, tmp_path, monkeypatch):
    """Many small ranges of captures at real times, in the order of a full sort."""
    monkeypatch.setattr(warc, "RANGE", 100)
    df = spark.range(5000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.example/").otherwise(F.concat(F.lit("http://h"), F.col("id") % 13, F.lit(".example/é"))).alias("url"), F.col("id").cast("string").alias("html"), F.timestamp_seconds(F.lit(1_700_000_000) + F.xxhash64("id") % 1000).alias("ts"))
    warc.write(df.repartition(5), f"file://{tmp_path}/w", date_col="ts")
    out = warc.index(warc.read(spark, f"file://{tmp_path}/w"))
    keys = [(r["url_key"], r["date"], r["page_id"]) for r in out.collect()]
    assert len(set(keys)) == 5000 and keys == sorted(keys)
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 1000
