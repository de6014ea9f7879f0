"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length 1 and turned by a seeded random rotation, then cut into blocks of low dimension. A pair with
cosine c is at squared distance 2 - 2c, so in at least one block its squared distance is within that block's proportional
part. Each block is range-joined on a grid of that radius over its first two coordinates; a pair is taken
up in the first block whose budget it meets, and its cosine is then computed in double precision from the vectors themselves.
Equal vectors are one class from the start. No pair leaves a task: a task sends the link counts of its vectors and a star
for each of its connected parts, and a crowded cell is cut into chunks whose pairs are separate tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import components, least_reachable, written

COSINE = 0.98
#: Dimensions of a block; steps of the quantised coordinates; vectors of a cell that one task holds of a side.
BLOCK_DIMS, STEPS, CHUNK = 16, 1 << 14, 1024
SEED = 20_240_117
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    if dims not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(SEED + dims).normal(size=(dims, dims)))
        _ROTATIONS[dims] = q * np.sign(np.diag(r))
    return _ROTATIONS[dims]


def blocks(dims: int) -> list[tuple[int, int]]:
    n = max(1, dims // BLOCK_DIMS)
    cuts = [dims * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def budgets(dims: int, cosine: float) -> np.ndarray:
    """Largest squared distance in steps for each block, wide enough for the rounding of both vectors."""
    radius = [np.sqrt((2 - 2 * cosine) * (b - a) / dims) * STEPS + np.sqrt(b - a) + 1 for a, b in blocks(dims)]
    return np.square(radius)


def quantised(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors in whole steps, as doubles: sums of their products are exact in any order."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.rint(x @ rotation(x.shape[1]) * STEPS)


def _cells(classes: DataFrame, cosine: float, payload: bool) -> DataFrame:
    """Each class at home in its cell of every block (role 0) and as a visitor of the four cells after it (role 1)."""
    fields = "dims int, label string, block int, cx int, cy int, role int, cls long"

    def run(batches):
        import pyarrow as pa

        ahead = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
        for batch in batches:
            dims = np.array(batch.column("dims").to_pylist())
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = np.stack(part.column("embedding").to_numpy(zero_copy_only=False))
                q, n = quantised(x), len(x)
                raw, turned = pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in q.astype(np.int16)], pa.binary())
                for j, ((a, b), most) in enumerate(zip(blocks(d), budgets(d, cosine), strict=True)):
                    side = np.sqrt(most)
                    cx = np.floor(q[:, a] / side).astype(np.int32)
                    cy = np.floor(q[:, a + 1] / side).astype(np.int32) if b - a > 1 else np.zeros(n, np.int32)
                    for role, (dx, dy) in enumerate(ahead):
                        if b - a == 1 and dy:
                            continue
                        cols = [pa.array(np.full(n, d, np.int32)), part.column("label"), pa.array(np.full(n, j, np.int32)), pa.array(cx + np.int32(dx)), pa.array(cy + np.int32(dy)), pa.array(np.full(n, min(role, 1), np.int32)), part.column("cls")]
                        names = ["dims", "label", "block", "cx", "cy", "role", "cls"]
                        if payload:
                            cols += [part.column("mult"), raw, turned]
                            names += ["mult", "raw", "turned"]
                        yield pa.RecordBatch.from_arrays(cols, names)

    return classes.mapInArrow(run, fields + (", mult long, raw binary, turned binary" if payload else ""))


def _compare(rows: list[tuple], block: int, dims: int, cosine: float, same: bool, kind: np.dtype):
    """Links of one task: (class, other copies linked) and star edges. rows: (side, cls, mult, raw, turned)."""
    cls = np.array([r[1] for r in rows], dtype=np.int64)
    mult = np.array([r[2] for r in rows], dtype=np.int64)
    x = np.stack([np.frombuffer(r[3], kind) for r in rows]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    q = np.stack([np.frombuffer(r[4], np.int16) for r in rows]).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    side = np.array([r[0] for r in rows])
    left = np.arange(len(rows)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    links, most = [], budgets(dims, cosine)
    for i in range(0, len(left), 512):
        for k in range(i if same else 0, len(right), 512):
            a, b = left[i : i + 512], right[k : k + 512]
            ok = None
            for j in (block, *range(block)):
                u, v = (q[s, slice(*blocks(dims)[j])] for s in (a, b))
                near = np.einsum("ij,ij->i", u, u)[:, None] + np.einsum("ij,ij->i", v, v)[None, :] - 2 * (u @ v.T) <= most[j]
                ok = near if ok is None else ok & ~near  # met in an earlier block: taken up there
            if same and i == k:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            f, g = np.nonzero(ok)
            f, g = a[f], b[g]
            for c in range(0, len(f), 1 << 16):
                s, t = f[c : c + (1 << 16)], g[c : c + (1 << 16)]
                hit = np.einsum("ij,ij->i", x[s], x[t]) / (norm[s] * norm[t]) >= cosine
                links.append(np.stack([s[hit], t[hit]], axis=1))
    pairs = np.concatenate(links) if links else np.zeros((0, 2), int)
    if not len(pairs):
        return None
    n = np.bincount(pairs[:, 0], weights=mult[pairs[:, 1]], minlength=len(rows)) + np.bincount(pairs[:, 1], weights=mult[pairs[:, 0]], minlength=len(rows))
    low = least_reachable(pairs[:, 0], pairs[:, 1], len(rows))
    met = np.flatnonzero(n > 0)
    return cls[met], n[met].astype(np.int64), cls[low[met]]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = COSINE) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` and ``kept``.

    Rows are compared when their labels are equal and not null and their vectors have as many components (without
    ``label_col`` all rows are). A vector that is null, empty or zero, or holds a null or a number that is not finite, links
    with nothing: it is its own component. A null id gets a null component, is not kept, and its links count only for
    the others. Repeated rows are linked rows. Vectors that agree in two 64-bit hashes of label and components count as equal.
    """
    label = F.col(f"`{label_col}`").cast("string") if label_col else F.lit("")
    v = F.col(f"`{vector_col}`")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))
    live = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, finite) & F.exists(v, lambda x: x != 0) & label.isNotNull()
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), v.alias("embedding"), F.coalesce(live, F.lit(False)).alias("live"))
    kind = np.dtype(np.float64 if "double" in dict(vectors.dtypes)[vector_col] else np.float32)
    plain = rows
    for salt in range(8):  # a class is named by 64 bits of two hashes; if two classes share a name, all are named anew
        rows = plain.withColumn("cls", F.when(F.col("live"), F.xxhash64(F.lit(salt), "label", "embedding")))
        other = F.xxhash64(F.lit(-1 - salt), "label", "embedding")
        classes = rows.where("live").groupBy("cls").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), (F.min(other) != F.max(other)).alias("clash"))
        classes = written(classes.withColumn("dims", F.size("embedding")), "vectors-classes")
        if classes.where("clash").isEmpty():
            break
    else:
        raise RuntimeError("different vectors share their names under every salt")

    key = ["dims", "label", "block", "cx", "cy"]
    light = _cells(classes, cosine, False)
    count = light.groupBy(*key).agg(F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).alias("homes"), F.sum("role").alias("visits")).where("homes > 0 and homes + visits > 1")
    count = count.select(*key, F.ceil(F.col("homes") / CHUNK).cast("int").alias("h"), F.ceil(F.col("visits") / CHUNK).cast("int").alias("v"))
    cells = _cells(classes, cosine, True).join(count, key).withColumn("c", F.pmod(F.xxhash64("cls"), F.when(F.col("role") == 0, F.col("h")).otherwise(F.col("v"))).cast("int"))
    task = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))
    upto = lambda lo, hi, f: F.when(hi >= lo, F.transform(F.sequence(lo, F.greatest(lo, hi)), f)).otherwise(F.array().cast("array<struct<kind:int,a:int,b:int,side:int>>"))
    zero, c, h, visits = F.lit(0), F.col("c"), F.col("h"), F.col("v")
    # kind 0: pairs of home chunks a <= b; kind 1: home chunk a with visitor chunk b
    home = F.concat(upto(c, h - 1, lambda b: task(0, c, b, 0)), upto(zero, c - 1, lambda a: task(0, a, c, 1)), upto(zero, visits - 1, lambda b: task(1, c, b, 0)))
    tasks = F.when(F.col("role") == 0, home).otherwise(upto(zero, h - 1, lambda a: task(1, a, c, 1)))
    dealt = cells.withColumn("t", F.explode(tasks)).select(*key, "t.kind", "t.a", "t.b", "t.side", "cls", "mult", "raw", "turned")
    group = [*key, "kind", "a", "b"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def run(batches):
        import pyarrow as pa

        def result(key, held):
            found = _compare(held, key[2], key[0], cosine, key[5] == 0 and key[6] == key[7], kind) if len(held) > 1 else None
            if found:
                return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["cls", "n", "low"])

        last, held = None, []
        for batch in batches:
            for *now, side, cls, mult, raw, turned in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now != last:
                    if out := result(last, held) if held else None:
                        yield out
                    last, held = now, []
                held.append((side, cls, mult, raw, turned))
        if out := result(last, held) if held else None:
            yield out

    found = written(dealt.mapInArrow(run, "cls long, n long, low long"), "vectors-links")
    comps = components(found.select(F.col("cls").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    named = classes.select("cls", "first", "mult").join(comps.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component").join(links, "cls", "left").select("cls", "least", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("least", "id"))
    out = rows.select("id", "cls").join(named, "cls", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def brute_force(x: np.ndarray, labels: list, cosine: float = COSINE) -> tuple[list[int], list[int]]:
    """Links and component (as row numbers) of each row of a small matrix of valid vectors: the definition, for tests."""
    u = x.astype(np.float64)
    norm = np.sqrt((u * u).sum(axis=1))
    near = u @ u.T / np.outer(norm, norm) >= cosine
    near &= np.array([[a == b and a is not None for b in labels] for a in labels])
    np.fill_diagonal(near, False)
    low = least_reachable(*np.nonzero(near), len(x))
    return near.sum(axis=1).tolist(), low.tolist()
