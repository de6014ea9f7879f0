"""Cleaning: text canonicalisation, exact and near de-duplication, entity resolution, survivorship, outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.core import clean, div
from tideframe.sources.tables import checkpointed


def normalize_text(c: Column, casefold: bool = True, punctuation: bool = True) -> Column:
    """Lower case, punctuation as spaces, single spaces, trimmed. For Unicode forms see :func:`unicode_form`."""
    c = F.lower(c) if casefold else c
    c = F.regexp_replace(c, r"[^\p{L}\p{N}\s]", " ") if punctuation else c
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unicode_form(form: str = "NFKC"):
    """A vectorised function that brings strings into a Unicode normal form; Spark has none built in."""
    import unicodedata

    def f(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return F.pandas_udf(f, "string", F.PandasUDFType.SCALAR)


def fingerprint(c: Column) -> Column:
    """Key collision: the distinct words of the normalised text in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(normalize_text(c), " "))), " ")


def ngram_fingerprint(c: Column, n: int = 2) -> Column:
    t = F.regexp_replace(normalize_text(c), " ", "")
    grams = F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array(t))
    return F.array_join(F.array_sort(F.array_distinct(grams)), "")


def shingles(c: Column, words: int = 3) -> Column:
    """Distinct word n-grams of the normalised text; a text of fewer words is one."""

    def made(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, words), " "))

    # the words are bound as a variable: as an expression, the text would be split anew for every shingle
    return F.array_distinct(F.element_at(F.transform(F.array(F.split(normalize_text(c), " ")), made), 1))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(normalize_text(a), " ")), F.array_distinct(F.split(normalize_text(b), " "))
    return div(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(1 - div(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.when(a.isNotNull() & b.isNotNull(), 1.0))


def jaro_winkler(prefix: float = 0.1):
    """A vectorised Jaro-Winkler similarity; Spark has none built in."""
    import pandas as pd

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        if a == b:
            return 1.0
        reach = max(max(len(a), len(b)) // 2 - 1, 0)
        used, pairs = [False] * len(b), []
        for i, ch in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if not used[j] and b[j] == ch:
                    used[j] = True
                    pairs.append((ch, j))
                    break
        m = len(pairs)
        if not m:
            return 0.0
        other = [b[j] for j in sorted(j for _, j in pairs)]
        t = sum(x != y for (x, _), y in zip(pairs, other, strict=True)) / 2
        jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
        same = 0
        for x, y in zip(a[:4], b[:4], strict=False):
            if x != y:
                break
            same += 1
        return jaro + same * prefix * (1 - jaro)

    def f(a, b):
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(f, "double", F.PandasUDFType.SCALAR)


def exact_unique(df: DataFrame, subset: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """The first (or last) row of each group of equal rows, by an explicit order; nulls are equal."""
    keys = [F.col(c).asc_nulls_last() if keep == "first" else F.col(c).desc_nulls_last() for c in order]
    w = Window.partitionBy(*subset).orderBy(*keys)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def minhash_bands(tokens: Column, bands: int, rows: int, seed: int = 1) -> Column:
    """Band keys of a set of tokens: each band hashes the smallest of ``rows`` seeded hashes."""

    def least(s: int) -> Column:  # the lambda takes one argument: Spark would give a second one the token's place
        return F.array_min(F.transform(tokens, lambda t: F.xxhash64(F.lit(s), t)))

    mins = [[least(seed + b * rows + r) for r in range(rows)] for b in range(bands)]
    return F.array(*[F.xxhash64(F.lit(b), *m) for b, m in enumerate(mins)])


def bucket_pairs(left: DataFrame, right: DataFrame, key: str, chunk: int = 1024) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, all with all: rows of a crowded key are dealt over tasks in chunks of the left side."""
    parts = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("__n"))
    dealt = left.join(parts, key).withColumn("__c", F.pmod(F.xxhash64(*left.columns), F.col("__n")).cast("int")).drop("__n")
    copied = right.join(parts, key).withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    return dealt.join(copied, [key, "__c"]).drop("__c")


def near_duplicates(df: DataFrame, id_col: str, text: str, threshold: float = 0.8, words: int = 3, bands: int = 16, rows: int = 4) -> DataFrame:
    """Candidate pairs (a, b) of MinHash bands, verified by exact Jaccard of their shingles.

    Texts with the same shingles are one class: each copy is linked to the smallest id of its class, and the classes are
    compared by these ids, every one with every other of its bucket.
    """
    held = df.select(F.col(id_col).alias("id"), F.array_sort(shingles(F.col(text), words)).alias("s")).where("s is not null")
    held = held.select("id", "s", F.min("id").over(Window.partitionBy("s")).alias("a"))
    copies = held.where("a < id").select("a", F.col("id").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    sets = held.where("a = id").select("id", "s").dropDuplicates(["id"])
    keys = sets.select("id", F.explode(F.array_distinct(minhash_bands(F.col("s"), bands, rows))).alias("k"))
    pairs = bucket_pairs(keys.withColumnRenamed("id", "a"), keys.withColumnRenamed("id", "b"), "k").where("a < b").select("a", "b").distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    sim = div(F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb")))
    return both.select("a", "b", sim.alias("jaccard")).where(F.col("jaccard") >= threshold).unionByName(copies)


def simhash(tokens: Column, bits: int = 64) -> Column:
    """Sign of the sum of the tokens' hash bits, bit by bit."""
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    out = F.lit(0).cast("long")
    for b in range(bits):
        votes = F.aggregate(hashes, F.lit(0), lambda s, h, b=b: s + F.when(F.shiftright(h, b).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))
        out = out.bitwiseOR(F.when(votes > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return out


SURVIVORS = {
    "first": lambda c, o: F.min_by(c, o),
    "last": lambda c, o: F.max_by(c, o),
    "first_non_null": lambda c, o: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(o))),
    "last_non_null": lambda c, o: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(o))),
    "most_frequent": lambda c, o: F.mode(c, True),
    "longest": lambda c, o: F.max_by(c, F.struct(F.length(F.col(c).cast("string")), F.col(c))),
    "max": lambda c, o: F.max(c),
    "min": lambda c, o: F.min(c),
}


def survivors(df: DataFrame, group: str, order: str, rules: Mapping[str, str]) -> DataFrame:
    """One golden record per group: each column by its rule, with partial aggregation."""
    return df.groupBy(group).agg(*[SURVIVORS[r](c, order).alias(c) for c, r in rules.items()])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each node of the edges reaches. Loops and repeated edges do no harm; null ends are dropped.

    Each round links every node's larger neighbours to its smallest one and then cuts each node down to its smallest neighbour;
    both are pre-aggregated minima and joins on the node. Lineage is cut by reliable checkpoints.
    """
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
        before = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u > v").distinct())
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def _prefix_tokens(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, n, k, x): a key for each of the rarest words of a class, of which two classes of that Jaccard similarity share one at least.

    The order by frequency is the same for all, as the filter needs; a word that most names have is not among the keys of those
    that have a rarer one.
    """
    words = classes.select("id", "n", "k", F.size("w").alias("m"), F.explode("w").alias("t"))
    held = words.join(words.groupBy("t").agg(F.count(F.lit(1)).alias("c")), "t")
    place = F.row_number().over(Window.partitionBy("id", "n").orderBy("c", "t"))
    return held.withColumn("i", place).where(F.col("i") <= F.col("m") - F.ceil(F.col("m") * threshold - 1e-9) + 1).select("id", "n", "k", F.xxhash64(F.lit("w"), "t").alias("x"))


def _pieces(n: Column, threshold: float, probe: bool) -> Column:
    """Keys of the partition join of edit distance: a longer text of length L is within k = floor((1 - threshold) * L) edits of
    a shorter one only if it has one of the shorter one's k + 1 pieces in it, moved by k places at most."""
    size = F.length(n)
    edits = lambda length: F.floor((1 - threshold) * length + 1e-9).cast("int")
    cut = lambda i, length, k: F.floor(i * length / (k + 1)).cast("int")

    def key(longer: Column, shorter: Column, i: Column, shift: Column | None) -> Column:
        k = edits(longer)
        start, end = cut(i, shorter, k), cut(i + 1, shorter, k)
        at = start if shift is None else start + shift
        inside = F.lit(True) if shift is None else (at >= 0) & (at + end - start <= size)
        return F.when(inside, F.xxhash64(longer, shorter, i, F.substring(n, at + 1, end - start)))

    if not probe:
        lengths = F.sequence(size, F.greatest(size, F.floor(size / threshold + 1e-9).cast("int")))
        made = F.transform(lengths, lambda longer: F.transform(F.sequence(F.lit(0), edits(longer)), lambda i: key(longer, size, i, None)))
        return F.array_distinct(F.flatten(made))
    k = edits(size)
    shorter = F.sequence(F.greatest(size - k, F.lit(0)), size)
    shifts = F.sequence(-k, k)
    made = F.transform(shorter, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: F.transform(shifts, lambda d: key(size, s, i, d)))))
    return F.array_distinct(F.array_compact(F.flatten(made)))


def resolve_entities(df: DataFrame, id_col: str, name: str, threshold: float = 0.85, block: int = 3) -> DataFrame:
    """All pairs (a, b) of ids whose names are alike by edit distance or common words, among those that share the start of a word.

    Equal normalised names are one class: each copy is linked to the smallest id of its class, and the classes are compared by
    these. Candidates come from two exact filters (rare token prefixes; pieces of the partition join), so no alike pair of classes
    is lost and no block is compared all with all. Null names and ids take no part; ``threshold`` lies above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and be 1 at most")
    held = df.select(F.col(id_col).alias("id"), normalize_text(F.col(name)).alias("n")).where("id is not null and n is not null")
    least = held.groupBy("n").agg(F.min("id").alias("a"))
    copies = held.join(least, "n").where("a < id").select("a", F.col("id").alias("b"), F.lit(1.0).alias("score")).distinct()
    starts = F.array_distinct(F.transform(F.split("n", " "), lambda w: F.substring(w, 1, block)))
    classes = least.select(F.col("a").alias("id"), "n", starts.alias("k"), F.array_distinct(F.split("n", " ")).alias("w"))
    keyed = lambda keys: classes.select("id", "n", "k", F.explode(keys).alias("x"))
    side = lambda rows, tag: rows.select(F.struct("id", "n", "k").alias(tag), "x")
    words = _prefix_tokens(classes, threshold)
    pairs = bucket_pairs(side(words, "p"), side(words, "q"), "x").unionByName(bucket_pairs(side(keyed(_pieces(F.col("n"), threshold, False)), "p"), side(keyed(_pieces(F.col("n"), threshold, True)), "q"), "x"))
    pairs = pairs.where((F.col("p.n") != F.col("q.n")) & F.arrays_overlap("p.k", "q.k"))
    sim = F.greatest(levenshtein_similarity(F.col("p.n"), F.col("q.n")), token_jaccard(F.col("p.n"), F.col("q.n")))
    alike = pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"), sim.alias("score")).where(F.col("score") >= threshold).distinct()
    return alike.unionByName(copies)


def canonical_ids(df: DataFrame, id_col: str, name: str, threshold: float = 0.85, block: int = 3) -> DataFrame:
    """Every row of ``df`` with ``canonical_id``, the smallest id of its component of :func:`resolve_entities`; its own id if it is alone."""
    found = connected_components(resolve_entities(df, id_col, name, threshold, block).select("a", "b"))
    joined = df.join(found.select(F.col("id").alias("__id"), F.col("component").alias("__c")), F.col(id_col) == F.col("__id"), "left")
    return joined.select(*df.columns, F.coalesce("__c", F.col(id_col)).alias("canonical_id"))


def fingerprint_clusters(df: DataFrame, id_col: str, name: str, method: str = "fingerprint") -> DataFrame:
    """(key, canonical, n_ids, n_rows) of each group of names with one fingerprint; the canonical spelling is the most frequent, then the least."""
    key = fingerprint(F.col(name)) if method == "fingerprint" else ngram_fingerprint(F.col(name))
    rows = df.where(F.col(name).isNotNull()).select(key.alias("key"), F.col(name).alias("name"), F.col(id_col).alias("id"))
    spelt = rows.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"))
    best = spelt.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("canonical"), F.sum("n").alias("n_rows"))
    return best.join(rows.groupBy("key").agg(F.count_distinct("id").alias("n_ids")), "key").select("key", "canonical", "n_ids", "n_rows")


def near_duplicate_clusters(df: DataFrame, id_col: str, text: str, threshold: float = 0.8, **options) -> DataFrame:
    """(id, component) of the ids that :func:`near_duplicates` links."""
    return connected_components(near_duplicates(df, id_col, text, threshold, **options).select("a", "b"))


def straddling_pairs(pairs: DataFrame, split: DataFrame, id_col: str, split_col: str) -> DataFrame:
    """The pairs (a, b) whose ends lie in different parts of a split, with both parts."""
    part = lambda end: split.select(F.col(id_col).alias(end), F.col(split_col).alias(f"split_{end}"))
    return pairs.join(part("a"), "a").join(part("b"), "b").where("split_a <> split_b")


def assert_no_straddle(pairs: DataFrame, split: DataFrame, id_col: str, split_col: str) -> None:
    first = straddling_pairs(pairs, split, id_col, split_col).first()
    if first is not None:
        raise ValueError(f"near duplicates lie on both sides of the split: {first.asDict()}")


def straddling_clusters(components: DataFrame, split: DataFrame, id_col: str, split_col: str) -> DataFrame:
    """(component, splits) of the components with members in more than one part."""
    rows = components.join(split.select(F.col(id_col).alias("id"), F.col(split_col).alias("s")), "id")
    return rows.groupBy("component").agg(F.array_sort(F.collect_set("s")).alias("splits")).where(F.size("splits") > 1)


def purge_near_duplicates(train: DataFrame, test: DataFrame, id_col: str, text: str, threshold: float = 0.8, **options) -> DataFrame:
    """The rows of ``train`` whose text is linked to no text of ``test``, whatever is linked within either."""
    tag = lambda df, side: df.select(F.struct(F.lit(side).alias("side"), F.col(id_col).alias("id")).alias("id"), F.col(text).alias("text"))
    pairs = near_duplicates(tag(train, 0).unionByName(tag(test, 1)), "id", "text", threshold, **options)
    found = connected_sides(pairs)
    return train.join(found.withColumnRenamed("id", id_col), id_col, "left_anti").select(*train.columns)


def connected_sides(pairs: DataFrame) -> DataFrame:
    """Ids of side 0 linked with side 1 directly, or through a copy of their own text (score 1)."""
    cross = pairs.where("a.side <> b.side")
    direct = cross.select(F.col("a.id").alias("id"))
    copies = pairs.where("a.side = 0 and b.side = 0 and jaccard = 1").select(F.col("a.id").alias("x"), F.col("b.id").alias("id"))
    return direct.unionByName(copies.join(direct.withColumnRenamed("id", "x"), "x").select("id")).distinct()


def outlier_bounds(df: DataFrame, column: str, method: str = "mad", k: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """(by..., lo, hi): mad, iqr, zscore or quantile fences of each group, or of all rows."""
    x = clean(F.col(column))
    held = df.select(*by, x.alias("x"))
    if method == "mad":
        w = Window.partitionBy(*by) if by else None
        if by:
            held = held.withColumn("m", F.percentile("x", 0.5).over(w))
        else:
            held = held.join(F.broadcast(held.agg(F.percentile("x", 0.5).alias("m"))))
        d = F.abs(F.col("x") - F.col("m"))
        s = F.percentile(d, 0.5)
        scale = F.when(s > 0, 1.4826 * s).otherwise(1.2533 * F.avg(d))
        return held.groupBy(*by).agg((F.first("m", ignorenulls=True) - k * scale).alias("lo"), (F.first("m", ignorenulls=True) + k * scale).alias("hi"))
    lo, hi = {
        "iqr": lambda: (F.percentile("x", 0.25) - k * (F.percentile("x", 0.75) - F.percentile("x", 0.25)), F.percentile("x", 0.75) + k * (F.percentile("x", 0.75) - F.percentile("x", 0.25))),
        "zscore": lambda: (F.avg("x") - k * F.stddev_samp("x"), F.avg("x") + k * F.stddev_samp("x")),
        "quantile": lambda: (F.percentile("x", k), F.percentile("x", 1 - k)),
    }[method]()
    return held.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))


def clean_outliers(df: DataFrame, column: str, method: str = "mad", k: float = 3.0, by: Sequence[str] = (), action: str = "clip") -> DataFrame:
    """clip, null, flag (a column ``column_outlier``) or drop the values outside their group's fences."""
    bounds = outlier_bounds(df, column, method, k, by).withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
    df = df.join(bounds, list(by), "left") if by else df.join(F.broadcast(bounds))
    x = clean(F.col(column))
    out = F.coalesce((x < F.col("__lo")) | (x > F.col("__hi")), F.lit(False))
    if action == "clip":
        df = df.withColumn(column, F.when(x.isNotNull(), F.least(F.greatest(x, F.col("__lo")), F.col("__hi"))))
    elif action == "null":
        df = df.withColumn(column, F.when(~out, F.col(column)))
    elif action == "flag":
        df = df.withColumn(f"{column}_outlier", out)
    else:
        df = df.where(~out)
    return df.drop("__lo", "__hi")


def rolling_outliers(df: DataFrame, entity: str, time: str, column: str, window: int, k: float = 3.0, least: int = 5, out: str = "outlier") -> DataFrame:
    """Whether a value is k scaled deviations from the median of the ``window`` rows before it."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(-window, -1)
    x = clean(F.col(column))
    df = df.withColumns({"__m": F.percentile(x, 0.5).over(w), "__n": F.count(x).over(w), "__all": F.collect_list(x).over(w)})
    d = F.array_sort(F.transform("__all", lambda v: F.abs(v - F.col("__m"))))
    n = F.size(d)
    mad = (F.try_element_at(d, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(d, F.floor((n + 2) / 2).cast("int"))) / 2
    v = F.when((F.col("__n") >= least) & x.isNotNull(), F.abs(x - F.col("__m")) > k * 1.4826 * mad)
    return df.withColumn(out, v).drop("__m", "__n", "__all")
