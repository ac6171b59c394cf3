"""Language identification by Bayesian fusion of the text, the declared markup language, the address and the host.

    log P(lang | all) = log prior(lang | host) + text(lang) + declared(lang) + suffix(lang) + const

- text: naive Bayes over hashed byte grams of words (2^`BITS` slots for each language, add-half smoothing), learnt from
  labelled documents; the likelihood of a text counts as that of at most `EVIDENCE` grams, since neighbours depend.
- declared: the `lang` of the markup's root, trusted with odds; suffix: a language in the path (`/fr/`) or a national
  top-level domain. Both have the likelihood of a witness that is right with a given chance.
- prior: shares of languages by host, smoothed towards those of its domain, and these towards all: grouped
  aggregations over (host, language) counts of the text's own posterior means. Counts of a host are sums, so a host with
  a third of all rows is one row per task after partial aggregation.

Edge cases: null or empty texts, markup and addresses are no evidence; without any the posterior is the prior; ties go to
the first language by name; unknown declared languages are ignored; no languages in the labels give null; repeated
rows are scored each; an empty table gives an empty result; labels of more than `MOST` languages are refused; columns named `lang`
or `posterior` are replaced, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, mapped, slices, utf8
from .toxicity import grams

BITS, EVIDENCE = 16, 40
#: Languages that a model may have: it is broadcast, 2^`BITS` numbers of four bytes for each.
MOST = 256
#: Chances that a witness names the right language.
DECLARED, PATH, DOMAIN = 0.9, 0.8, 0.7
#: Pseudo-counts of a domain's shares under its hosts', and of the overall shares under the domain's.
HOST_MASS, DOMAIN_MASS = 20.0, 50.0
#: National suffixes, each beside the language that most of its pages use.
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "nl": "nl", "pl": "pl", "pt": "pt", "br": "pt", "se": "sv", "jp": "ja", "ru": "ru", "cn": "zh"}
OPENS = re.compile(rb"(?i)<(?:!--|(script|style)\b|html\b)")
LANG = re.compile(rb"(?i)\blang\s*=\s*(?:[\"']\s*)?([a-z]{2,3})\b")
SKIP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;")
_U = np.uint64


def visible(html: bytes) -> bytes:
    return SKIP.sub(b" ", html)


def declared(html: bytes) -> str | None:
    """The language that a root tag outside of comments, scripts and styles names, wherever it stands; each byte is passed a few times at most."""
    low, at = html.lower(), 0
    while m := OPENS.search(low, at):
        if m[1] or low.startswith(b"<!--", m.start()):
            end = low.find(b"</" + m[1] if m[1] else b"-->", m.end() - 2)
            if end < 0:
                return None
            at = end + 3
            continue
        at = low.find(b">", m.end())
        if at < 0:
            at = len(low)
        if lang := LANG.search(low[m.end() : at]):
            return lang[1].decode()
    return None


def _slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams of up to 3 bytes (with the space that begins a word) of all texts, and how many each has."""
    packed, sizes = grams(texts)
    return (((packed & _U(0xFFFFFF)) * _U(0x9E3779B97F4A7C15)) >> _U(64 - BITS)).astype(np.int64), sizes


def learn(docs: DataFrame, lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name, and their log-probabilities of each slot: counts over all labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole):
                langs = batch["lang"].to_pylist()
                texts = utf8(batch["text"])
                for lang in set(langs):
                    slots, _ = _slots([t for t, x in zip(texts, langs, strict=True) if x == lang])
                    sums[lang] = sums.get(lang, 0) + np.bincount(slots, minlength=1 << BITS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "slot", "n"])

    counted = mapped(docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), "text"), run, "lang string, slot long, n long")
    found = kept(counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    kinds = found.agg(F.count_distinct("lang")).first()[0]
    if kinds > MOST:
        raise ValueError(f"{kinds} languages in {lang_col}, at most {MOST} fit in a model")
    found = found.toArrow()  # at most 2^BITS rows for each language
    names = sorted(set(found["lang"].to_pylist()))
    table = np.full((len(names), 1 << BITS), 0.5)
    place = {x: i for i, x in enumerate(names)}
    table[[place[x] for x in found["lang"].to_pylist()], found["slot"].to_numpy()] += found["n"].to_numpy()
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if names else table


def address(url: str | None) -> tuple[str | None, str | None]:
    """Host without port, and its last two labels."""
    try:
        host = urlsplit(url or "").hostname
    except ValueError:
        host = None
    if not host:
        return None, None
    return host, ".".join(host.split(".")[-2:])


def witnesses(url: str | None, html: bytes, names: list[str]) -> tuple[str | None, str | None, str | None]:
    """Languages that the markup, the path and the top-level domain name, where they are among `names`."""
    known = lambda x: x if x in names else None
    try:
        parts = urlsplit(url or "")
        path, host = parts.path, parts.hostname or ""
    except ValueError:
        path, host = "", ""
    first = next((x for x in path.lower().split("/") if x), "")
    return known(declared(html)), known(re.split("[-_]", first)[0]) if len(first) in (2, 5) else None, known(COUNTRIES.get(host.rsplit(".", 1)[-1]))


def likelihoods(rows: DataFrame, names: list[str], table: np.ndarray, markup: bool) -> DataFrame:
    """Adds `__like` (log-likelihood of all evidence but the host, for each language), `__host`, `__domain`; other columns stay."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    fields = [T.StructField("__like", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.StringType()) for c in ("__host", "__domain")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for batch in slices(whole, "__text"):
                raw = utf8(batch["__text"])
                slots, sizes = _slots([visible(x) for x in raw] if markup else raw)
                sums = np.concatenate([np.zeros((len(names), 1)), np.cumsum(table[:, slots], axis=1, dtype=np.float64)], axis=1)
                ends = np.cumsum(sizes)
                like = ((sums[:, ends] - sums[:, ends - sizes]) / np.maximum(sizes, 1) * np.minimum(sizes, EVIDENCE)).T
                hosts = []
                for i, (url, html) in enumerate(zip(batch["__url"].to_pylist(), raw, strict=True)):
                    hosts.append(address(url))
                    if markup:
                        for lang, trust in zip(witnesses(url, html, names), (DECLARED, PATH, DOMAIN), strict=True):
                            if lang is not None:
                                like[i] += np.where(np.array(names) == lang, np.log(trust), np.log((1 - trust) / max(len(names) - 1, 1)))
                    else:
                        hosts[-1] = (url, url)
                rest = [n for n in batch.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[n] for n in rest), pa.array(list(like), pa.list_(pa.float64())), pa.array([h for h, _ in hosts], pa.string()), pa.array([d for _, d in hosts], pa.string())],
                    names=[*rest, "__like", "__host", "__domain"],
                )

    keep = [f for f in rows.schema.fields if f.name != "__text"]
    return mapped(rows, run, T.StructType(keep + fields))


def _softmax(x):
    return F.transform(x, lambda v: F.exp(v - F.array_max(x)) / F.aggregate(x, F.lit(0.0), lambda a, b: a + F.exp(b - F.array_max(x))))


def fuse(rows: DataFrame, names: list[str]) -> DataFrame:
    """From `__like`, `__host`, `__domain`: adds `lang` and `posterior`; other columns stay."""
    k = len(names)
    if not k:
        return rows.withColumns({"lang": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double")}).drop("__like", "__host", "__domain")
    own = rows.withColumns({"__h": F.coalesce("__host", F.lit("")), "__d": F.coalesce("__domain", F.lit(""))}).withColumn("__p", _softmax(F.col("__like")))
    sums = [F.sum(F.get("__p", i)).alias(f"s{i}") for i in range(k)]
    hosts = kept(own.groupBy("__h", "__d").agg(*sums))
    part = lambda df, keys, tag: df.groupBy(*keys).agg(F.array(*[F.sum(f"s{i}") for i in range(k)]).alias(tag))
    every, domains = part(hosts, [], "__all"), part(hosts, ["__d"], "__dom")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    smooth = lambda counts, mass, under: F.zip_with(counts, under, lambda n, p: (n + mass * p) / (total(counts) + mass))
    domains = domains.crossJoin(F.broadcast(every)).withColumn("__all", F.transform("__all", lambda v: (v + 1) / (total(F.col("__all")) + k)))  # one row
    domains = domains.select("__d", smooth(F.col("__dom"), F.lit(DOMAIN_MASS), F.col("__all")).alias("__dom"))
    priors = hosts.select("__h", "__d", F.array(*[f"s{i}" for i in range(k)]).alias("__n")).join(domains, "__d")
    priors = priors.select("__h", "__d", F.transform(smooth(F.col("__n"), F.lit(HOST_MASS), F.col("__dom")), lambda v: F.log(v)).alias("__prior"))
    priors = kept(priors)  # a row for each host; of a join of two plain shuffles a hot host can be split
    out = own.join(priors, ["__h", "__d"]).withColumn("__sum", F.zip_with("__like", "__prior", lambda a, b: a + b)).withColumn("__post", _softmax(F.col("__sum")))
    best = F.array_position("__post", F.array_max("__post")).cast("int")
    out = out.withColumns({"lang": F.element_at(F.array(*map(F.lit, names)), best), "posterior": F.array_max("__post")})
    return out.drop("__like", "__host", "__domain", "__h", "__d", "__p", "__prior", "__sum", "__post")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], text_col: str, url_col: str | None, markup: bool) -> DataFrame:
    """Adds `lang` and `posterior` to the rows, whose text column goes. `url_col` may be a bare host or source."""
    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    inner = rows.drop("lang", "posterior").withColumns({"__url": url, "__text": F.col(text_col)}).drop(text_col)
    return fuse(kept(likelihoods(inner, *model, markup)), model[0]).drop("__url")  # texts are read once


def digest(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of all documents (by text and source) and all pages (by text, markup, address and host).

    Learnt from the `lang` of documents whose crc32(doc_id as text) mod 5 isn't 0; the rest are held out.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = learn(docs.where(~held))
    d = identify(docs.select("doc_id", "text", "source"), model, "text", "source", False).select("doc_id", F.lit(None).cast("long").alias("page_id"), "lang", "posterior")
    p = identify(pages.select("page_id", "html", "url"), model, "html", "url", True).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "lang", "posterior")
    return d.unionByName(p)
