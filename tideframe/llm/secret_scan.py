"""Secret scan over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over mandatory trigrams (alternatives of conjunctions,
read off the parsed pattern). The index holds, for each trigram that any rule needs, the ids of the documents with it,
in posting blocks of a bounded id range. A rule's candidates are the union over its alternatives of the
intersected postings; only these are matched against the pattern. A rule without a mandatory trigram
(the long hexadecimal run) scans all texts. Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import written

#: Ids in a posting block: id div BLOCK names the block, so that a posting never holds more ids than this.
BLOCK = 4096
#: Limits of the query derivation; beyond them a query gets weaker, never wrong.
MAX_STRINGS, MAX_CLASS, MAX_ALTERNATIVES = 64, 4, 64
#: Up to so many candidates (about 100 bytes each) are broadcast to the texts; beyond that both are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the pattern, and the length that the given group must have at least."""

    kind: str
    pattern: str
    min_length: int = 1
    group: int = 0


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

_TRUE = frozenset({frozenset()})


def _absorb(dnf: frozenset) -> frozenset:
    return frozenset(x for x in dnf if not any(y < x for y in dnf))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > MAX_ALTERNATIVES:
        return max(a, b, key=lambda q: (min(map(len, q)), -len(q)))
    return _absorb(frozenset(x | y for x in a for y in b))


def _query_of(strings: frozenset) -> frozenset:
    return _absorb(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(tokens) -> tuple[frozenset | None, frozenset]:
    """(all strings that the part can be, or None if too many; query that any text with a match satisfies)."""
    run, query = frozenset({""}), _TRUE
    for op, arg in tokens:
        exact, inner = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= MAX_STRINGS:
            run = frozenset(x + y for x in run for y in exact)
            continue
        query = _both(query, _query_of(run))
        if exact is not None:
            run, exact = exact, None
            continue
        query, run = _both(query, inner), frozenset({""})
        tokens = None
    if tokens is not None:
        return run if query == _TRUE else None, _both(query, _query_of(run))
    return None, _both(query, _query_of(run))


def _node(op, arg) -> tuple[frozenset | None, frozenset]:
    if op is sre.LITERAL:
        return frozenset({chr(arg).lower()}), _TRUE
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        exact = frozenset().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
        query = _absorb(frozenset().union(*(p[1] for p in parts)))
        return (exact if exact is not None and len(exact) <= MAX_STRINGS else None), (query if len(query) <= MAX_ALTERNATIVES else _TRUE)
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MAX_CLASS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, _TRUE
        return (frozenset(chars) if len(chars) <= MAX_CLASS + 2 else None), _TRUE
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, query = _walk(inner)
        if high == 1 and exact is not None:
            return (exact | {""} if low == 0 else exact), _TRUE
        if low == 0:
            return None, _TRUE
        return None, query if exact is None else _query_of(exact)
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return frozenset({""}), _TRUE
    return None, _TRUE


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Alternatives of sets of lower-cased trigrams: a text that matches has all of at least one set.

    An empty set among them means that the pattern has no mandatory trigram.
    """
    return _walk(parser.parse(pattern))[1]


def build_index(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``(block, gram, ids)`` of the given lower-cased trigrams; a posting holds at most BLOCK distinct ids.

    Rows without an id or a text are not indexed. Repeated ids appear once.
    """
    low = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("low")).where("id is not null and low is not null")
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]))
    rows = low.select("id", F.floor(F.col("id") / F.lit(BLOCK)).alias("block"), F.explode(found).alias("gram"))
    return rows.groupBy("block", "gram").agg(F.collect_set("id").alias("ids"))


def candidates(index: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """``(id, kinds)``: the documents whose postings satisfy a query, with the kinds of these queries."""
    block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("by"))
    none = F.array().cast("array<bigint>")

    def ids(query: frozenset) -> Column:
        out = None
        for gramset in sorted(query, key=sorted):
            one = None
            for g in sorted(gramset):
                p = F.coalesce(F.try_element_at("by", F.lit(g)), none)
                one = p if one is None else F.array_intersect(one, p)
            out = one if out is None else F.array_union(out, one)
        return out

    each = F.array(*[F.struct(F.lit(k).alias("kind"), ids(q).alias("ids")) for k, q in queries.items()])
    rows = block.select(F.explode(each).alias("x")).select("x.kind", F.explode("x.ids").alias("id"))
    return rows.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


#: Matches whose positions are added up in one go; longer lists are summed piece by piece.
PIECE = 256


def _spans(pieces: Column, matches: Column, lengths: Column, at: int, rule: Rule) -> Column:
    """Array of (start, at, kind, end) from the texts between the matches, the matches and the lengths to test."""
    n = F.size(matches)
    parts = F.zip_with(F.zip_with(F.slice(pieces, 1, n), matches, lambda p, m: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("m"))), lengths, lambda x, g: F.struct(x.p.alias("p"), x.m.alias("m"), g.alias("g")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(PIECE)).cast("int")), lambda i: F.slice(parts, i * PIECE + 1, PIECE))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x.p + x.m))
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<bigint>").alias("out"))
    offsets = F.aggregate(sums, zero, lambda a, s: F.struct((a.pos + s).alias("pos"), F.concat(a.out, F.array(a.pos)).alias("out")), lambda a: a.out)
    kind = f"array<struct<start:bigint,at:int,kind:string,end:bigint>>"

    def within(chunk: Column, start: Column) -> Column:
        first = F.struct(start.alias("pos"), F.array().cast(kind).alias("out"))

        def step(a: Column, x: Column) -> Column:
            s = a.pos + x.p
            one = F.array(F.struct(s.alias("start"), F.lit(at).alias("at"), F.lit(rule.kind).alias("kind"), (s + x.m).alias("end")))
            return F.struct((s + x.m).alias("pos"), F.when(x.g >= rule.min_length, F.concat(a.out, one)).otherwise(a.out).alias("out"))

        return F.aggregate(chunk, first, step, lambda a: a.out)

    return F.when(n > 0, F.flatten(F.zip_with(chunks, offsets, within))).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: ``id_col`` and ``spans``, an array of (start, at, kind, end) by start, then rule.

    Positions count code points, the end is exclusive; matches of one rule are leftmost and do not overlap, and a
    match whose group is too short is dropped after it has taken its place. A null or empty text has no spans. Repeated
    rows each get a row. A row with a null id is scanned for every rule without the index. Other columns are not read.
    A text is matched whole, however long. The candidates are written and counted first; no more than ``broadcast_rows``
    of them are broadcast, so that the texts stay where they lie.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if frozenset() not in q}
    docs = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    rows = docs.select(F.col("__id"), F.coalesce("__text", F.lit("")).alias("__text"))
    if indexed:
        grams = sorted({g for q in indexed.values() for s in q for g in s})
        found = candidates(build_index(docs, grams, "__id", "__text"), indexed).select(F.col("id").alias("__id"), F.col("kinds").alias("__kinds"))
        found = written(found, "secret-candidates")
        found = F.broadcast(found) if found.count() <= broadcast_rows else found.hint("merge")
        rows = rows.join(found, "__id", "left")
    else:
        rows = rows.withColumn("__kinds", F.lit(None).cast("array<string>"))
    text, none = F.col("__text"), F.array().cast("array<string>")
    taken = []
    for r in rules:
        # the spelling with a bound finds the same long runs and skips the short ones inside the matcher
        pattern = r.pattern[:-1] + f"{{{r.min_length},}}" if r.kind == "hex" else r.pattern
        hit = F.lit(True) if r.kind not in indexed else F.col("__id").isNull() | F.coalesce(F.array_contains("__kinds", r.kind), F.lit(False))
        taken.append((r, pattern, hit))
    first = rows.select("__id", "__text", *[F.when(hit, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"__m{i}") for i, (r, p, hit) in enumerate(taken)])
    more = [F.when(F.size(f"__m{i}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"__p{i}") for i, (r, p, _) in enumerate(taken)]
    more += [F.transform(F.when(F.size(f"__m{i}") > 0, F.regexp_extract_all(text, F.lit(p), F.lit(r.group))).otherwise(none) if r.group else F.col(f"__m{i}"), F.length).alias(f"__g{i}") for i, (r, p, _) in enumerate(taken)]
    second = first.select("__id", *[f"__m{i}" for i in range(len(taken))], *more)
    spans = [_spans(F.col(f"__p{i}"), F.col(f"__m{i}"), F.col(f"__g{i}"), i, r) for i, (r, _, _) in enumerate(taken)]
    return second.select(F.col("__id").alias(id_col), F.array_sort(F.concat(*spans)).alias("spans"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract from the spans of :func:`scan`."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return scanned.select(F.col(id_col).alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
