"""Mixing sources to target weights by hierarchical budgets.

The documents form a tree domain / language / source. A total of tokens flows down it by the weights of the children;
a child that cannot take its share (all its tokens, over at most ``max_epochs`` epochs) leaves the shortage to its
siblings, and only what a whole family cannot take reaches the siblings of its parent. A leaf's
budget is then met by whole epochs and a prefix, in an order seeded by epoch, of its documents in the last one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leaves of the tree that the driver plans over at most; they are a configuration, not data.
MAX_LEAVES = 100_000
#: Documents that one task orders at a time in a leaf, on average.
SLICE_DOCS = 4096


@dataclass
class Node:
    name: tuple[str, ...]
    weight: float = 1.0
    children: list[Node] = field(default_factory=list)
    tokens: int = 0
    budget: float = 0.0

    def capacity(self, epochs: float) -> float:
        return sum(c.capacity(epochs) for c in self.children) if self.children else self.tokens * epochs


def share(total: float, weights: Sequence[float], caps: Sequence[float]) -> list[float]:
    """Water-filling: shares of ``total`` by weight, none above its cap, shortages to the others by weight.

    Children without weight get nothing while any weighted one has room.
    """
    out, open_ = [0.0] * len(weights), {i for i, w in enumerate(weights) if w > 0 and caps[i] > 0}
    left = min(total, sum(caps[i] for i in open_))
    while open_ and left > 1e-9:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] / whole * left >= caps[i] - out[i]}
        if not full:
            for i in open_:
                out[i] += weights[i] / whole * left
            break
        for i in full:
            left -= caps[i] - out[i]
            out[i] = caps[i]
        open_ -= full
    return out


def allocate(node: Node, total: float, epochs: float) -> None:
    """Sets the budgets below ``node``: every family is filled by itself, so siblings come before ancestors."""
    node.budget = min(total, node.capacity(epochs))
    if node.children:
        for child, part in zip(node.children, share(node.budget, [c.weight for c in node.children], [c.capacity(epochs) for c in node.children]), strict=True):
            allocate(child, part, epochs)


def _leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in _leaves(c)] if node.children else [node]


def plan(tokens: Mapping[tuple[str, ...], int], weights: Mapping[tuple[str, ...], float], total: float, epochs: float) -> dict[tuple[str, ...], float]:
    """Budget of each leaf. ``weights`` names nodes by their path; nodes without one weigh 1 among their siblings."""
    root = Node(())
    for path in sorted(tokens):
        at = root
        for k in range(1, len(path) + 1):
            name = path[:k]
            nxt = next((c for c in at.children if c.name == name), None)
            if nxt is None:
                at.children.append(nxt := Node(name, weights.get(name, 1.0)))
            at = nxt
        at.tokens = tokens[path]
    allocate(root, total, epochs)
    return {x.name: x.budget for x in _leaves(root) if x.name}


def word_count(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space. 0 for a null text."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def order_key(epoch: int | Column, seed: int, *ids: Column) -> Column:
    """Place of a document in an epoch's order: 60 bits of an md5 of seed, epoch and id."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), *[F.coalesce(i.cast("string"), F.lit("null")) for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    levels: Sequence[tuple[str, Column]],
    weights: Mapping[tuple[str, ...], float],
    fraction: float,
    max_epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Adds ``mix_leaf`` (path), ``mix_tokens`` and ``mix_copies`` (epochs in which the row is used) to every row.

    ``levels`` gives the name and the expression of each level of the tree, from the root down; nulls are a child named
    ``unknown``. The total is ``fraction`` of all tokens. A leaf's last epoch is taken, in the order of the md5 of seed, epoch
    and id (equal ids: then a hash of the text), up to the document that the budget's end falls into; that one is taken if
    at least half of it is inside. Documents are never cut. All rows and other columns stay; columns
    named like the new ones are replaced. An empty table gives an empty table.

    A leaf may hold any part of all rows: its order is cut into slices by the order's leading bits; slices are summed by
    pre-aggregated groups, and only the rows of one slice, some thousands on average, are ordered in a task.
    """
    new = ["mix_leaf", "mix_tokens", "mix_copies"]
    kept = [c for c in docs.columns if c not in new or c in (id_col, text_col)]
    path = F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("unknown")) for _, c in levels])
    tree = [F.coalesce(c.cast("string"), F.lit("unknown")).alias(f"__l{i}") for i, (_, c) in enumerate(levels)]
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], path.alias("__leaf"), word_count(text).alias("__n"), F.xxhash64(text).alias("__t"), *tree)
    names = [f"__l{i}" for i in range(len(levels))]
    found = rows.groupBy("__leaf", *names).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("d")).limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves: group small sources before mixing")
    tokens = {tuple(r[x] for x in names): r.n for r in found}
    budgets = plan(tokens, weights, fraction * sum(tokens.values()), max_epochs)
    spark, table = docs.sparkSession, []
    for r in found:
        b, n = int(budgets.get(tuple(r[x] for x in names), 0) + 1e-6), r.n
        whole = min(max_epochs, b // n) if n else 0
        table.append((r["__leaf"], whole, b - whole * n if whole < max_epochs else 0, max(1, -(-r.d // SLICE_DOCS))))
    leaves = spark.createDataFrame(table, "__leaf string, __whole long, __rest long, __slices long")
    rows = rows.drop(*names).join(F.broadcast(leaves) if len(table) <= MAX_LEAVES else leaves, "__leaf")
    rows = rows.withColumn("__k", order_key(F.col("__whole"), seed, ident))
    rows = rows.withColumn("__s", F.floor(F.col("__k") / F.lit(1 << 60) * F.col("__slices")).cast("long"))
    sums = rows.groupBy("__leaf", "__s").agg(F.sum("__n").alias("__sum"), F.first("__rest").alias("__rest"))
    before = F.sum("__sum").over(Window.partitionBy("__leaf").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    # one slice at most of a leaf is cut by its budget; the others are taken or left whole
    sums = sums.select("__leaf", "__s", F.coalesce(before, F.lit(0)).alias("__before"), F.col("__sum"))
    rows = rows.join(sums, ["__leaf", "__s"])
    inside = F.sum("__n").over(Window.partitionBy("__leaf", "__s").orderBy("__k", "__t", ident).rowsBetween(Window.unboundedPreceding, 0))
    taken = (F.col("__before") + inside - F.col("__n") / 2 <= F.col("__rest")) & (F.col("__rest") > 0)
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col("__leaf").alias("mix_leaf"), F.col("__n").alias("mix_tokens"), (F.col("__whole") + taken.cast("long")).alias("mix_copies"))


def taken(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each row as often as its copies say, without the columns of :func:`mix`."""
    rows = mixed.where("mix_copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")))
    return rows.drop("__copy", "mix_leaf", "mix_tokens", "mix_copies")
