"""The manifest against trees built in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from millrace.llm import merkle
from pyspark.sql import functions as F


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def path(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


def plain(rows, fanout):
    """``(key, group, leaf)`` to sorted ``(key, group, leaf, subroot, root, proof)``."""
    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {
        g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        for g in groups
    }
    trees = {g: tree([r[2] for r in ordered[g]], fanout) for g in groups}
    over = tree([trees[g][-1][0] for g in groups], fanout) if groups else []
    out = []
    for k, g in enumerate(groups):
        for i, row in enumerate(ordered[g]):
            proof = path(trees[g], i, fanout) + path(over, k, fanout)
            out.append((*row, trees[g][-1][0], over[-1][0], proof))
    return sorted(out, key=repr)


def found(df):
    return sorted(
        (
            (r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["proof"]])
            for r in df.collect()
        ),
        key=repr,
    )


SCHEMA = "doc_id bigint, lang string, leaf string"


@pytest.mark.parametrize("n, fanout, levels", [(1, 2, 4), (90, 3, 2), (500, 2, 4)])
def test_every_row_has_its_proof(spark, n, fanout, levels):
    rng = random.Random(n)
    names = [None, "", "en", "en", "en", "en", "de", "ü", "z", "only one"]
    rows = [
        (rng.choice([None, *range(n)]), rng.choice(names), digest(str(rng.randrange(n))))
        for _ in range(n)
    ]
    rows += rows[:5] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(merkle.manifest(df, fanout=fanout, levels=levels)) == plain(rows, fanout)


def test_proofs_lead_to_the_root_and_tampering_does_not(spark):
    rows = [(i, "en" if i % 3 else "de", digest(str(i))) for i in range(40)]
    proved = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    changed = F.when(F.col("doc_id") == 7, F.lit(digest("x"))).otherwise(F.col("leaf"))
    right = F.col("root") == merkle.fold(changed, F.col("proof"))
    assert [r["doc_id"] for r in proved.filter(~right).collect()] == [7]


def test_one_row_has_no_siblings(spark):
    df = spark.createDataFrame([(1, None, "leaf")], SCHEMA)
    row = merkle.manifest(df).withColumn("all", merkle.siblings(F.col("proof"))).first()
    assert (row["subroot"], row["root"], row["proof"], row["all"]) == ("leaf", "leaf", [], "")


def test_leaf_counts_bytes_and_marks_nulls(spark):
    df = spark.createDataFrame([(5, "ü:", None), (None, "", 1)], "a bigint, b string, c bigint")
    got = [r[0] for r in df.select(merkle.leaf("a", "b", "c")).collect()]
    assert got == [digest("1:5", "3:ü:", "-"), digest("-", "0:", "1:1")]


def test_edges(spark, edge_docs, no_docs):
    columns = ["doc_id", "text", "lang"]
    leaves = edge_docs.withColumn("leaf", merkle.leaf(*columns))
    # Names that the operator uses itself are carried unharmed.
    named = leaves.withColumn("g", F.lit(1)).withColumn("payload", F.lit("p")).withColumn("n", F.lit(2))
    proved = merkle.manifest(named, carried=["g", "payload", "n", "score"])
    rows = [(r["doc_id"], r["lang"], r["leaf"]) for r in leaves.collect()]
    assert found(proved) == plain(rows, 2)
    assert {(r["g"], r["payload"], r["n"]) for r in proved.collect()} == {(1, "p", 2)}
    assert merkle.manifest(no_docs.withColumn("leaf", F.lit("x"))).count() == 0


def test_wrong_shapes_are_refused(no_docs):
    with pytest.raises(ValueError):
        merkle.manifest(no_docs.withColumn("leaf", F.lit("x")), fanout=1)
