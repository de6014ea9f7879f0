"""What the pipeline operators share: the shared folder, written intermediate tables, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and one process does all (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jsc = spark.sparkContext._jsc.sc()
        got = jsc.getCheckpointDir()
        if got.isDefined():
            at = got.get()
        else:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="tideframe-shared-")
            spark.conf.set("spark.checkpoint.dir", at)
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    at = fresh_path(spark, name)
    df.write.options(**options).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a table of :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges of a graph that one task contracts by itself (two arrays of 8 MB); a larger graph takes distributed rounds.
LOCAL_EDGES = 1_000_000


def least_reachable(a, b, n: int):
    """Smallest node reachable from each of the nodes 0 to n - 1 over the edges (a, b), as NumPy arrays."""
    import numpy as np

    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _contract(batches):
    """(id, component) of the graph in one partition's edges."""
    import numpy as np
    import pyarrow as pa

    edges = [np.stack([batch.column(i).to_numpy() for i in (0, 1)]) for batch in batches]
    if edges:
        nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least_reachable(u, v, len(nodes))])], ["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, local: int | None = None) -> DataFrame:
    """Connected components of an undirected graph as ``(id, component)``; component is the smallest id.

    Alternating large-star / small-star rounds over the edge table: each round is two hash aggregations
    (pre-aggregated before the shuffle) and joins on the node, so a hub with a third of all edges meets
    partial ``min`` and a join that AQE can split. Only a count and a checksum of the edges reach the driver. A graph of at
    most ``local`` distinct edges is contracted in one task instead; the result is the same.
    Nodes without an edge are not returned; null ends are dropped; loops and repeated edges do no harm.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = written(e, "cc")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = sign(e)
    if before[0] <= (LOCAL_EDGES if local is None else local):
        return e.coalesce(1).mapInArrow(_contract, "id long, component long")
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = written(small.where("u > v").distinct(), "cc")
        drop_written(e)
        e, now = new, sign(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)



#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 1_000_000


def text_slices(batch, column: str, limit: int = SLICE_BYTES):
    """Cuts an Arrow record batch into runs of rows with at most ``limit`` bytes of text (a longer text stands alone)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(np.asarray(sizes)):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(batch) > start:
        yield batch.slice(start, len(batch) - start)


#: Rows and bytes of an Arrow batch of texts: a batch of the usual 10,000 rows may be a GB of long ones.
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session that texts travel in to Python workers, if it does not bound them more."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        digits = str(now or "").rstrip("bB")
        if not digits.lstrip("-").isdigit() or int(digits) <= 0 or int(digits) > most:
            spark.conf.set(key, str(most))


def tidy(batches):
    """The batches; after the last one, memory that the worker process does not need is given back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def map_texts(df: DataFrame, f, schema) -> DataFrame:
    """``mapInArrow`` in bounded batches, by workers that tidy up after each task."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: tidy(f(batches)), schema)


class WordCodes(dict):
    """word -> a number made by ``make``, remembered for up to ``most`` words."""

    def __init__(self, make, most: int = 120_000) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.make(word)
        return value


def mix64(x):
    """Finaliser of a 64-bit hash over a NumPy array of unsigned integers."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_POWERS: list = []


def powers(n: int):
    """At least n powers of an odd base and of its inverse modulo 2 to the 64: hashes of substrings come from prefix sums."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _POWERS[:] = made
    return _POWERS


#: Bits of a bitmap: a fixed 4 MB, whatever the input.
BITMAP = 1 << 25


def bitmap_of(bits: DataFrame, col: str = "bit"):
    """A bitmap of BITMAP bits (a fixed 4 MB) with those of the column set, put together on the executors."""
    import numpy as np

    one = F.col(col) + 1  # Spark numbers from one
    rows = bits.groupBy(F.bitmap_bucket_number(one).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("b")).collect()
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in rows:
        at = (r.k - 1) * 4096
        got = np.frombuffer(r.b, np.uint8)[: max(0, min(4096, len(out) - at))]
        out[at : at + len(got)] |= got
    return out


def in_bitmap(bitmap, keys):
    """Whether each of the unsigned keys has its lowest bits set in the bitmap."""
    import numpy as np

    k = (keys & np.uint64(BITMAP - 1)).astype(np.int64)
    return (bitmap[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1


def low_bits(c: Column) -> Column:
    return c.bitwiseAND(F.lit(BITMAP - 1))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished stages: it does so only when the driver's JVM collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
