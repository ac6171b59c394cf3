"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression the driver derives a Boolean query over trigrams in disjunctive form: a
match must hold all trigrams of at least one clause. The index has a posting (gram, document) for each gram of
the rules' vocabulary. Postings are intersected by counting, per document and clause, the clause's grams; a
document with all of them is a candidate, and only candidates are verified with the expression. Rules without
mandatory trigrams (runs of hex digits, say) scan every text. Texts that satisfy no clause can't be candidates, so they
are never shuffled; what the index has of the others is joined to them.

Edge cases: a null text is empty and gives no span; repeated rows and repeated ids are scanned row by row
(candidates are a filter, the verification decides on the row's own text); null ids are joined null-safely;
an empty table gives an empty result; matches that tie on the start are ordered by their rule's place; a column named
`spans` is replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_of

try:  # the standard library's own parser of expressions
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as C
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """`pattern` must mean the same in Java and Python; `group` is the part whose length must reach `least`."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three kinds of the contract, in its order. Hex digits and access keys are maximal runs, so
#: their least length is part of the expression; an assignment that fails still hides what it covers.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further kinds of widely documented credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("bearer", r"(?i:authorization):\x20*(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{16,})"),
    Rule("userinfo", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE + MORE

#: Sets of alternatives beyond this size are given up for what stands before and after them.
WIDE = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, of which any match holds one entirely; None: no gram is mandatory."""
    found: list[list[frozenset[str]]] = []

    def flush(held: set[str]) -> set[str]:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in held}
        if frozenset() not in grams:
            found.append([g for g in grams if not any(h < g for h in grams)])
        return {""}

    def chars(options) -> set[str] | None:
        out: set[str] = set()
        for op, x in options:
            if op is C.LITERAL:
                out.add(chr(x).lower())
            elif op is C.RANGE and x[1] - x[0] < WIDE:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None

    def exact(items) -> set[str] | None:
        """All strings the items can match, lower-cased, if they are few."""
        out = {""}
        for op, x in items:
            if op is C.LITERAL:
                more = {chr(x).lower()}
            elif op is C.IN:
                more = chars(x)
            elif op is C.SUBPATTERN:
                more = exact(x[3])
            elif op is C.BRANCH:
                parts = [exact(b) for b in x[1]]
                more = None if None in parts else set().union(*parts)
            elif op is C.MAX_REPEAT and x[0] in (0, 1) and x[1] == 1:
                more = exact(x[2])
                more = more and (more | {""} if x[0] == 0 else more)
            else:
                return None
            if not more or len(out) * len(more) > WIDE:
                return None
            out = {a + b for a, b in product(out, more)}
        return out

    def walk(items, held: set[str]) -> set[str]:
        for item in items:
            more = exact([item])
            if more is not None and len(held) * len(more) <= WIDE:
                held = {a + b for a, b in product(held, more)}
                continue
            op, x = item
            once = exact(x[2]) if op is C.MAX_REPEAT and x[0] >= 1 else None
            if once and len(held) * len(once) <= WIDE:  # one of the repeats follows, one of them comes before the rest
                flush({a + b for a, b in product(held, once)})
                held = once
                continue
            held = flush(held)
            if op is C.SUBPATTERN:
                held = walk(x[3], held)
            elif op is C.MAX_REPEAT and x[0] >= 1:
                flush(walk(x[2], {""}))
        return held

    flush(walk(parser.parse(pattern), {""}))
    if not found:
        return None
    return min(found, key=lambda clauses: (-min(map(len, clauses)), len(clauses)))  # the most selective condition


def _spans(text: Column, rule: Rule) -> Column:
    """Structs (at, rank, kind, upto) of the rule's matches: pieces between and lengths of the matches give offsets."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    before = F.split(text, rule.pattern, -1)
    rows = F.zip_with(
        F.zip_with(F.slice(before, 1, F.size(whole)), whole, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m"))),
        part,
        lambda x, g: F.struct(x["p"].alias("p"), x["m"].alias("m"), F.length(g).alias("g")),
    )
    kind = "array<struct<at:int,upto:int,g:int>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + x["p"]
        one = F.struct(at.alias("at"), (at + x["m"]).alias("upto"), x["g"].alias("g"))
        return F.struct((at + x["m"]).alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.filter(F.aggregate(rows, start, step, lambda acc: acc["out"]), lambda s: s["g"] >= rule.least)


def _folded(text_col: str) -> Column:
    """An array of the lower-cased text alone: as a lambda's argument it is computed once, however often it is used."""
    return F.array(F.lower(text_of(text_col)))


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index, restricted to a vocabulary: rows (gram, id), gram being a place in `grams`."""
    found = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return docs.select(F.col(id_col).alias("__id"), F.explode(F.flatten(F.transform(_folded(text_col), found))).alias("gram"))


def candidates(index: DataFrame, grams: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Documents whose postings satisfy a rule's query: (id, kinds)."""
    place = {g: i for i, g in enumerate(grams)}
    clauses = [(kind, clause) for kind, q in queries.items() for clause in q]
    of_gram = [[c for c, (_, clause) in enumerate(clauses) if g in clause] for g in grams]
    assert len(place) == len(grams)
    lookup = F.array(*[F.array(*map(F.lit, cs)) for cs in of_gram])
    need = F.array(*[F.lit(len(clause)) for _, clause in clauses])
    kinds = F.array(*[F.lit(kind) for kind, _ in clauses])
    met = (
        index.dropDuplicates(["__id", "gram"])
        .select("__id", F.explode(F.element_at(lookup, F.col("gram") + 1)).alias("clause"))
        .groupBy("__id", "clause")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == F.element_at(need, F.col("clause") + 1))
    )
    return met.groupBy("__id").agg(F.collect_set(F.element_at(kinds, F.col("clause") + 1)).alias("__kinds"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds `spans`, an array of (at, rank, upto): code points, `rank` the place in `rules`; other columns stay."""
    prepare(docs.sparkSession)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted(set().union(*(c for q in queries.values() for c in q)))
    text = text_of(text_col)
    none = F.lit(None).cast("array<string>")
    if grams:
        held = lambda low, clause: reduce(lambda a, b: a & b, [F.contains(low, F.lit(g)) for g in sorted(clause)])
        met = F.exists(_folded(text_col), lambda low: reduce(lambda a, b: a | b, [held(low, c) for q in queries.values() for c in q]))
        hits = candidates(postings(docs, grams, id_col, text_col), grams, queries).withColumnRenamed("__id", "__key")
        inside = docs.where(met)
        inside = inside.join(hits, inside[id_col].eqNullSafe(hits["__key"]), "left").drop("__key")
        docs = inside.unionByName(docs.where(~met).withColumn("__kinds", none))
    else:
        docs = docs.withColumn("__kinds", none)

    def one(rank: int, rule: Rule) -> Column:
        ok = F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False)) if rule.kind in queries else text.rlike(rule.pattern)
        spans = F.transform(_spans(text, rule), lambda s: F.struct(s["at"].alias("at"), F.lit(rank).alias("rank"), s["upto"].alias("upto")))
        return F.when(ok, spans).otherwise(F.array().cast("array<struct<at:int,rank:int,upto:int>>"))

    found = F.array_sort(F.concat(*[one(i, r) for i, r in enumerate(rules)]))
    return docs.withColumn("spans", found).drop("__kinds")


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["at"], s["upto"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op1's contract."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
