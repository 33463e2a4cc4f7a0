"""Merkle manifest of a table: one root for all rows, and a proof for each.

Rows become leaves (a digest of their columns), and the leaves of a group,
in the order of their keys, a tree: every ``fanout`` consecutive nodes become the
digest of their digests, until one is left.  These subroots, in the order of
the groups, become the root likewise.

Slot pivot: a parent's children are spread into fanout columns by conditional
aggregates.  The columns one after the other are what the parent hashes, and
without the column of a child's own slot they are its siblings.  One aggregate
spreads ``levels`` levels at once, whose inner nodes are hashed from columns to columns, so that
a tree over n rows costs log(n) / levels shuffles, each a fraction of the one before.
Proofs go down the same way: a row of columns is joined with its parent's proof
and then dealt out to its children, so leaves themselves move once only.

Positions come from sorted ranges: rows are numbered within the range they lie
in, and the counts of ranges, a few numbers each, are summed up.  A group that
holds most of the rows is as many ranges, and never one task.

NULL keys come before others, as does the NULL group.  Rows with one key are ordered by
their digests; equal rows are leaves of their own.  A node without siblings is
the digest of one digest; a group of one leaf has that leaf as its subroot, and the proof of a
table of one row is empty.  An empty table gives no rows.  Texts of any length
count once, in their leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.session import is_small

FANOUT = 2
# Levels of the tree that one aggregate spreads: fanout ** levels columns.
LEVELS = 4

# Rows of a partition have ids that begin with its number.
_ROW_BITS = 33


def leaf(*columns: str | Column) -> Column:
    """Digest of a row: of each value its UTF-8 bytes, counted, or ``-`` for NULL."""
    parts = []
    for column in columns:
        value = (F.col(column) if isinstance(column, str) else column).cast("string")
        counted = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(counted, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(
        proof, digest, lambda h, level: F.sha2(F.concat(level.before, h, level.after), 256)
    )


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf's level up, left to right."""
    return F.concat_ws("", F.transform(proof, lambda level: F.concat(level.before, level.after)))


@dataclass(frozen=True)
class _Shape:
    fanout: int
    levels: int

    @property
    def width(self) -> int:
        return self.fanout**self.levels

    def up(self, n: str, level: int = 1) -> str:
        """Nodes that ``n`` nodes become some levels up."""
        step = self.fanout**level
        return f"(({n} + {step - 1}) div {step})"


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``pos``, the place in the group, and ``n``, the rows of the group."""
    order = ["g", "k", "h", "tie"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    row_id = stored(ordered.withColumn("id", F.monotonically_increasing_id()), "merkle-order")
    parts = row_id.withColumn("part", F.shiftright("id", _ROW_BITS)).drop("tie")
    inside = Window.partitionBy("g").orderBy("part")
    counts = parts.groupBy("g", "part").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    offsets = stored(
        counts.select(
            "g",
            "part",
            (F.sum("rows").over(inside) - F.col("rows") - F.col("first")).alias("shift"),
            F.sum("rows").over(Window.partitionBy("g")).alias("n"),
        ),
        "merkle-offsets",
    )
    small = F.broadcast(offsets) if is_small(offsets) else offsets
    return parts.join(small, ["g", "part"]).select(
        "g", (F.col("id") + F.col("shift")).alias("pos"), "n", "h", "payload"
    )


def _spread(nodes: DataFrame, shape: _Shape) -> DataFrame:
    """Nodes as rows of columns: ``l0_0 …`` the children, ``l1_0 …`` their parents, up to ``top``.

    ``n`` is the number of the group's nodes on the children's level.  A single
    node is the group's root and passes on as it is.
    """
    width = shape.width
    children = [
        f"max(CASE WHEN pmod(pos, {width}) = {i} THEN struct(h, payload) END) AS c{i}" for i in range(width)
    ]
    spread = nodes.groupBy("g", F.expr(f"pos div {width} AS block")).agg(
        F.max("n").alias("n"), *map(F.expr, children)
    )
    out = spread.selectExpr("*", *[f"c{i}.h AS l0_{i}" for i in range(width)])
    for level in range(1, shape.levels + 1):
        single = f"{shape.up('n', level - 1)} = 1"
        parents = []
        for i in range(0, width // shape.fanout ** (level - 1), shape.fanout):
            run = [f"l{level - 1}_{j}" for j in range(i, i + shape.fanout)]
            parents.append(
                f"CASE WHEN {run[0]} IS NULL OR {single} THEN {run[0]} ELSE sha2({_joined(run)}, 256) END"
                f" AS l{level}_{i // shape.fanout}"
            )
        out = out.selectExpr("*", *parents)
    return out.withColumnRenamed(f"l{shape.levels}_0", "top")


def _joined(columns: list[str]) -> str:
    """Columns one after the other, in SQL; a slot without a child adds nothing."""
    return f"concat({', '.join(f"coalesce({c}, '')" for c in columns)})" if columns else "''"


def _dealt(blocks: DataFrame, shape: _Shape) -> DataFrame:
    """One row per child again, with its proof before the one of the block."""
    n_levels = " + ".join(f"if({shape.up('n', j)} > 1, 1, 0)" for j in range(shape.levels))
    children = []
    for i in range(shape.width):
        entries = []
        for level in range(shape.levels):
            own = i // shape.fanout**level
            first = own - own % shape.fanout
            before = _joined([f"l{level}_{j}" for j in range(first, own)])
            after = _joined([f"l{level}_{j}" for j in range(own + 1, first + shape.fanout)])
            entries.append(f"named_struct('before', {before}, 'after', {after})")
        children.append(
            f"named_struct('pos', block * {shape.width} + {i}, 'h', c{i}.h, 'payload', c{i}.payload,"
            f" 'proof', concat(slice(array({', '.join(entries)}), 1, {n_levels}), proof))"
        )
    dealt = blocks.selectExpr("g", "subroot", "root", f"inline(array({', '.join(children)}))")
    return dealt.filter("h is not null")


def _grown(nodes: DataFrame, shape: _Shape) -> list[DataFrame]:
    """Rows of columns of all rounds, leaves first; the last has a row per group."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds: list[DataFrame] = []
    while True:
        rounds.append(stored(_spread(nodes, shape), f"merkle-{len(rounds)}"))
        largest = -(-largest // shape.width)
        if largest <= 1:
            return rounds
        nodes = rounds[-1].select(
            "g",
            F.col("block").alias("pos"),
            F.expr(shape.up("n", shape.levels)).alias("n"),
            F.col("top").alias("h"),
            F.lit(None).cast("string").alias("payload"),
        )


def _with_proofs(rounds: list[DataFrame], ends: DataFrame, shape: _Shape) -> DataFrame:
    """Leaves with proofs; ``ends`` has ``g, subroot, root, proof`` of each group's root."""
    blocks = rounds[-1].join(ends, "g")
    for below in rounds[-2::-1]:
        parents = _dealt(blocks, shape).select("g", F.col("pos").alias("block"), "subroot", "root", "proof")
        blocks = below.join(parents, ["g", "block"])
    return _dealt(blocks, shape)


def manifest(
    leaves: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    digest: str = "leaf",
    carried: Sequence[str] = (),
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """``key, group, digest``, the ``carried`` columns, ``subroot, root`` and ``proof`` of every row.

    ``proof`` has, for each level from the leaf's, the digests ``before`` and
    ``after`` the own one; :func:`fold` goes up along it.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("a parent needs two slots, an aggregate one level")
    shape = _Shape(fanout, levels)
    # No group comes first, the others by their bytes.
    name = F.col(group).cast("string")
    # Columns of any name are carried under their place.
    values = [F.col(c).alias(f"v{i}") for i, c in enumerate([key, group, *carried])]
    rows = leaves.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("g"),
        F.col(key).alias("k"),
        F.col(digest).alias("h"),
        F.struct(*values).alias("payload"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rounds = _grown(_numbered(stored(rows, "merkle-leaves")), shape)

    subroots = rounds[-1].select(
        F.lit("").alias("g"),
        F.col("g").alias("k"),
        F.col("top").alias("h"),
        F.struct("g").alias("payload"),
        F.lit(0).alias("tie"),
    )
    over = _grown(_numbered(subroots), shape)
    root = over[-1].select(
        "g",
        F.lit(None).cast("string").alias("subroot"),
        F.col("top").alias("root"),
        F.array().cast("array<struct<before:string,after:string>>").alias("proof"),
    )
    ends = _with_proofs(over, root, shape).select(
        F.col("payload.g").alias("g"), F.col("h").alias("subroot"), "root", "proof"
    )
    dealt = _with_proofs(rounds, stored(ends, "merkle-subroots"), shape)
    names = [key, group, *carried]
    return dealt.select(
        *[F.col(f"payload.v{i}").alias(name) for i, name in enumerate(names)],
        F.col("h").alias(digest),
        "subroot",
        "root",
        "proof",
    )
