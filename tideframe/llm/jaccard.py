"""Exact n-gram Jaccard join with a token-group matrix.

A document is the set of its distinct 5-word shingles (64-bit hashes). Documents of equal sets are one class from the
start. The join then finds the connected components of the classes that share at least 80 % of their union:

1. A count sketch of a fixed size over all shingles orders them from rare to frequent. A second scan gives every document its
   set's size, fingerprint, two min-hashes, and how frequent its shingles are.
2. Similar classes are partitioned: all classes of one min-hash are held against the one of the most frequent shingles, their
   likeliest original (a star, so a family of any size costs one comparison for each member); linked ones form groups.
3. Groups are cut into pages of some PAGE classes, each with the union of its members' rare-first prefixes: the
   token-group matrix, as rows (shingle, page) with the sizes and the furthest reach of the members that have the shingle. Two
   linked sets share a prefix shingle, and their overlap lies at or after the first one; so a class that shares one with
   a page of another group early enough is a candidate query of that page. Its own group's pages need not be opened.
4. A candidate page is opened only if the query's overlap with the union of its sets reaches 80 % of the query; then each
   member is compared exactly.
5. Star links and page links give the components.

Nothing is capped or sampled: the sketch and the bitmaps only save work, and a full one costs time, not links. A class is named
by 64 bits of its set's 128-bit digest; if two digests share a name, all are named anew with another salt. Two shingles with
the same 64-bit hash would be taken for one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import bitmap_of, components, in_bitmap, low_bits, map_texts, mix64, powers, release, text_slices, written

WORDS, PERCENT = 5, 80
#: Classes of a page on average; queries of a page that one task streams; parts that the classes of a min-hash are dealt to.
PAGE, SALT, STAR_SALT = 64, 256, 8
#: Counters of the sketch and the part of it that is one row.
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 16
_MIX = 0x9E3779B97F4A7C15


_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles_of(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words is one shingle, one without words none.

    Words of all texts are hashed together, from prefix sums over their bytes.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    n = len(data)
    power, inverse = powers(n + 1)
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))  # every text ends with white space
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[:n], out=sums[1:])
    codes = mix64((sums[end] - sums[start]) * inverse[start])
    del sums
    last = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1)
    cut = np.concatenate(([0], np.searchsorted(start, last)))
    m = len(codes) - words + 1
    h = np.full(max(m, 0), words, dtype=np.uint64)
    for i in range(words if m > 0 else 0):
        h = h * np.uint64(_MIX) + codes[i : m + i]
    h = mix64(h)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(h[a : b - words + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            one = b - a
            for c in codes[a:b].tolist():
                one = (one * _MIX + c) & 0xFFFFFFFFFFFFFFFF
            out.append(mix64(np.array([one], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return shingles_of([text], words)[0]


def digest(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """The two halves of a set's digest; the first is its name."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def fingerprint(s: np.ndarray, salt: int = 0) -> int:
    return digest(s, salt)[0]


def _counts_of(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]


def prefix(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, in order, one of which any set with 80 % in common must have in its own prefix."""
    p = len(s) - (len(s) * PERCENT + 99) // 100 + 1
    key = (_counts_of(s, counts).astype(np.uint64) << np.uint64(64 - 24)) | (s >> np.uint64(24))
    return s[np.argsort(key, kind="stable")[:p]]


def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    return 100 * common >= PERCENT * (a + b - common)


def _count(docs: DataFrame) -> DataFrame:
    """(n, counts): part n of each task's count sketch of all shingles."""

    def run(batches):
        import zlib

        import pyarrow as pa

        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        low = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingles_of(part.column("text").to_pylist())
                sketch += np.bincount((np.concatenate(sets) & low).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
        if sketch.any():
            blocks = [sketch[i : i + SKETCH_BLOCK] for i in range(0, len(sketch), SKETCH_BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())], ["n", "counts"])

    return map_texts(docs, run, "n long, counts binary")


def _scan(docs: DataFrame, counts: np.ndarray, salt: int) -> DataFrame:
    """(id, t, n, cls, cls2, m1, m2, common) of each document: hash of the text, size, digest, min-hashes, and how frequent its shingles are."""
    sketch = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        import pyarrow as pa

        names = ["id", "t", "n", "cls", "cls2", "m1", "m2", "common"]
        logs = np.log1p(sketch.value.astype(np.float64))
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingles_of(part.column("text").to_pylist())
                n = np.array([len(s) for s in sets], dtype=np.int64)
                cls = np.array([digest(s, salt) for s in sets], dtype=np.int64).reshape(-1, 2)
                m1 = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
                m2 = np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).min() if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
                common = np.array([_counts_of(s, logs).mean() if len(s) else 0.0 for s in sets])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t"), pa.array(n), pa.array(np.ascontiguousarray(cls[:, 0])), pa.array(np.ascontiguousarray(cls[:, 1])), pa.array(m1), pa.array(m2), pa.array(common)], names)

    return map_texts(docs, run, "id long, t long, n long, cls long, cls2 long, m1 long, m2 long, common double")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The tasks' sketches added up, of a fixed size whatever the input."""
    import zlib

    def add(key, table):
        import pyarrow as pa

        total = np.zeros(SKETCH_BLOCK, dtype=np.uint64)
        for b in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(b), dtype=np.uint32)
        return pa.table({"n": [key[0].as_py()], "counts": [np.minimum(total, (1 << 23) - 1).astype(np.uint32).tobytes()]})

    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    # tasks first meet in salted groups, so that the sum over many tasks is not one task's work
    salted = rows.select("n", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("s"))

    def part(key, table):
        import pyarrow as pa

        got = add((key[0],), table)
        return pa.table({"n": got.column("n"), "counts": [zlib.compress(x, 1) for x in got.column("counts").to_pylist()]})

    first = salted.groupBy("n", "s").applyInArrow(part, "n long, counts binary")
    for r in first.groupBy("n").applyInArrow(add, "n long, counts binary").collect():
        out[r.n * SKETCH_BLOCK : (r.n + 1) * SKETCH_BLOCK] = np.frombuffer(r.counts, dtype=np.uint32)
    return out


def _key_bits(cls: Column, doc: Column) -> Column:
    return low_bits(cls.bitwiseXOR(doc).bitwiseXOR(F.shiftleft(doc, 13)))


def _sets(docs: DataFrame, need: DataFrame, salt: int) -> DataFrame:
    """(cls, doc, set) of the needed classes' smallest documents; a bitmap keeps most others from being sent.

    A few others pass, and repeated rows come repeatedly: the join on (cls, doc) that follows sorts that out.
    """
    context = docs.sparkSession.sparkContext
    bitmap = context.broadcast(bitmap_of(need.select(_key_bits(F.col("cls"), F.col("doc")).alias("bit"))))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingles_of(part.column("text").to_pylist())
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                cls = np.array([fingerprint(s, salt) for s in sets], dtype=np.int64)
                hit = np.flatnonzero(in_bitmap(bitmap.value, (cls ^ ids ^ (ids << 13)).view(np.uint64)))
                hit = [i for i in hit.tolist() if len(sets[i])]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(ids[hit]), pa.array([sets[i].tobytes() for i in hit], pa.binary())], ["cls", "doc", "set"])

    return map_texts(docs, run, "cls long, doc long, set binary")


def _open(sets: DataFrame, members: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between queries (page, q) and members (page, cls) of the pages: for each query the first of each page.

    ``docs`` gives the document of each class. A page's members are few; its queries, of any number, are dealt out by a salt
    and stream past the members.
    """
    count = queries.groupBy("page").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT)).cast("int").alias("salts"))
    q = queries.join(count, "page").select("page", F.pmod(F.xxhash64("q"), F.col("salts")).cast("int").alias("salt"), F.col("q").alias("cls"), F.lit(1).alias("role"))
    m = members.join(count, "page").select("page", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "cls", F.lit(0).alias("role"))
    rows = q.unionByName(m).join(docs, "cls").join(sets, ["cls", "doc"]).select("page", "salt", "role", "cls", "set")
    rows = rows.repartition("page", "salt").sortWithinPartitions("page", "salt", "role", "cls")

    def run(batches):
        import pyarrow as pa

        key, held, built = None, [], None
        for batch in batches:
            links: list[tuple[int, int]] = []
            cols = [batch.column(i).to_pylist() for i in range(4)]
            data = batch.column(4)
            for r, (page, salt, role, cls) in enumerate(zip(*cols, strict=True)):
                if key != (page, salt):
                    key, held, built = (page, salt), [], None
                s = np.frombuffer(data[r].as_buffer(), dtype=np.uint64)
                if role == 0:
                    held.append((cls, s))
                    continue
                if not held:
                    continue
                if built is None:
                    sizes = np.array([len(x) for _, x in held])
                    built = (np.concatenate([x for _, x in held]), np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes, np.array([c for c, _ in held], dtype=np.int64))
                    built += (np.unique(built[0]) if len(held) > 1 else built[0],)
                tokens, starts, sizes, ids, union = built
                fit = (100 * np.minimum(sizes, len(s)) >= PERCENT * np.maximum(sizes, len(s))) & (ids != cls)
                if not fit.any():
                    continue
                if len(held) > 1:
                    at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                    if 100 * int((union[at] == s).sum()) < PERCENT * len(s):  # bound: the page cannot hold a partner
                        continue
                at = np.minimum(np.searchsorted(s, tokens), len(s) - 1)
                common = np.add.reduceat((s[at] == tokens).astype(np.int64), starts)
                hit = np.flatnonzero(linked(common, sizes, len(s)) & fit)
                if len(hit):
                    links.append((cls, int(ids[hit[0]])))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_texts(rows, run, "a long, b long")


def _prefixes(docs: DataFrame, counts: np.ndarray, only: np.ndarray | None, salt: int) -> DataFrame:
    """(token, cls, place) over the documents' prefixes; with ``only``, of the tokens in that bitmap alone."""
    context = docs.sparkSession.sparkContext
    sketch = context.broadcast(counts)
    keep = context.broadcast(only)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, "text"):
                tokens, cls, sizes, places = [], [], [], []
                for s in shingles_of(part.column("text").to_pylist()):
                    if not len(s):
                        continue
                    p = prefix(s, sketch.value)
                    at = np.arange(len(p), dtype=np.int32)
                    if keep.value is not None:
                        at = at[in_bitmap(keep.value, p >> np.uint64(20))]
                        p = p[at]
                    tokens.append(p)
                    places.append(at)
                    cls.append(fingerprint(s, salt))
                    sizes.append(len(p))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(cls, dtype=np.int64), sizes)), pa.array(np.concatenate(places))], ["token", "cls", "place"])

    return map_texts(docs, run, "token long, cls long, place int")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`components_of` with the columns ``doc_id``, ``n_shingles`` and ``component_id``."""
    found = components_of(docs, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its ``id``, ``t`` (a hash of its text), ``n`` (shingles) and ``component``, the smallest id reachable by links.

    A null or empty text, or one of white space, has no shingles and links with nothing. A row with a null id gets a null
    component, and its links count for nothing. Repeated rows share their class; equal ids with different texts are told apart by
    their sets. Other columns are not read. A very long text is handled whole, by itself; its sets take some 40 bytes a word.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    counts = _sketch(written(_count(docs), "jaccard-sketch"))
    live = docs.where("id is not null and text is not null").select("id", "text")
    for salt in range(8):
        rows = written(_scan(docs, counts, salt), "jaccard-scan")
        classes = rows.where("n > 0 and id is not null").groupBy("cls").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("m1").alias("m1"), F.first("m2").alias("m2"), F.first("common").alias("common"), (F.min("cls2") != F.max("cls2")).alias("clash"))
        classes = written(classes, "jaccard-classes")
        if classes.where("clash").isEmpty():
            break
    else:
        raise RuntimeError("sets of different digests share their names under every salt")

    stars = None
    for m, shift in (("m1", 0.0), ("m2", 0.5)):
        # sets of one min-hash and of like size; the class of the most frequent shingles is the likeliest original of the others
        banded = classes.withColumn("band", F.floor(F.ln("n") / F.lit(math.log(100 / PERCENT)) + shift))
        reps = banded.groupBy(m, "band").agg(F.max(F.struct("common", "cls", "n")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
        # any number of classes may share a min-hash: they are dealt to parts, each with a copy of the one representative
        parts = F.explode(F.sequence(F.lit(0), F.lit(STAR_SALT - 1))).alias("part")
        reps = reps.select(m, "band", F.col("top.cls").alias("page"), F.col("top.n").alias("pn"), parts)
        one = banded.withColumn("part", F.pmod(F.xxhash64("cls"), F.lit(STAR_SALT)).cast("int")).join(reps, [m, "band", "part"])
        one = one.where((F.col("cls") != F.col("page")) & (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * PERCENT)).select("page", F.col("cls").alias("q"))
        stars = one if stars is None else stars.unionByName(one)
    stars = written(stars.distinct(), "jaccard-stars")
    need = stars.select(F.col("page").alias("cls")).unionByName(stars.select(F.col("q").alias("cls"))).distinct().join(classes.select("cls", "doc"), "cls")
    need = written(need, "jaccard-need")
    pages = stars.select("page").distinct().select("page", F.col("page").alias("cls"))
    near = written(_open(_sets(live, need, salt), pages, stars, need), "jaccard-links")
    groups = components(near)
    release(docs.sparkSession)

    shared = _prefixes(live, counts, None, salt).groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b")
    only = bitmap_of(shared.select(low_bits(F.shiftrightunsigned("token", 20)).alias("bit")))
    release(docs.sparkSession)
    group = classes.select("cls", "n").join(groups.select(F.col("id").alias("cls"), "component"), "cls", "left").select("cls", "n", F.coalesce("component", "cls").alias("grp"))
    group = written(group, "jaccard-groups")
    posts = _prefixes(live, counts, only, salt).distinct().join(group, "cls")
    posts = written(posts, "jaccard-posts")
    live_tokens = posts.groupBy("token").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a < b").select("token")
    posts = posts.join(live_tokens, "token", "left_semi")
    size = group.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    # a group's classes are dealt evenly to as many pages as it needs
    paged = group.join(size, "grp").select("cls", "n", "grp", "size", F.when(F.col("size") == 1, F.col("cls")).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / F.lit(PAGE))))).alias("page"))
    paged = written(paged, "jaccard-pages")
    own = written(posts.select("token", "place", "cls").join(paged, "cls"), "jaccard-own")
    matrix = own.groupBy("token", "page").agg(F.first("grp").alias("pgrp"), F.first("size").alias("psize"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("place")).alias("rest"))
    asks = own.select("token", "place", F.col("cls").alias("q"), "n", "grp", "size")
    first = (F.col("size") < F.col("psize")) | ((F.col("size") == F.col("psize")) & (F.col("grp") < F.col("pgrp")))
    fits = (F.col("n") * 100 >= F.col("lo") * PERCENT) & (F.col("hi") * 100 >= F.col("n") * PERCENT)
    # what a pair has in common lies at or after its first common shingle, on both sides
    fits &= F.least(F.col("n") - F.col("place"), F.col("rest")) * (100 + PERCENT) >= PERCENT * (F.col("n") + F.col("lo"))
    queries = written(asks.join(matrix, "token").where(first & fits).select("page", "q").distinct(), "jaccard-queries")
    asked = queries.select("page").distinct()
    members = written(paged.select("page", "cls").join(asked, "page", "left_semi"), "jaccard-members")
    need = members.select("cls").unionByName(queries.select(F.col("q").alias("cls"))).distinct().join(classes.select("cls", "doc"), "cls")
    need = written(need, "jaccard-need")
    release(docs.sparkSession)
    more = written(_open(_sets(live, need, salt), members, queries, need), "jaccard-links")
    release(docs.sparkSession)

    comps = components(near.unionByName(more))
    named = classes.select("cls", "doc").join(comps.select(F.col("id").alias("cls"), "component"), "cls", "left").select("cls", "doc", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    named = named.join(least, "component").select("cls", "least")
    out = rows.join(named, "cls", "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))
    return out.select("id", "t", "n", component.alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id; rows with a null id stay. All columns are kept.

    Rows of equal ids are told apart by their texts, so each goes or stays with its own component. Of several rows of a
    component's smallest id that with the least hash of its text stays; repeated rows (equal id and text) become one row.
    """
    found = written(components_of(docs, id_col, text_col).where("id is not null"), "jaccard-found")
    release(docs.sparkSession)
    gone = found.where("component < id").select("id", "t")
    repeated = not found.groupBy("id").count().where("count > 1").isEmpty()
    if repeated:
        heads = found.where("component = id and n > 0")
        gone = gone.unionByName(heads.join(heads.groupBy("id").agg(F.min("t").alias("least")), "id").where("t > least").select("id", "t"))
    # what goes grows with the documents: it is never broadcast, at any size
    gone = gone.distinct().select(F.col("id").alias("__id"), F.col("t").alias("__t")).hint("merge")
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    out = docs.join(gone, (ident.cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__t")), "left_anti")
    if not repeated:
        return out
    return out.where(ident.isNull()).unionByName(out.where(ident.isNotNull()).dropDuplicates([id_col, text_col]))
