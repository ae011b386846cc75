"""A Merkle tree over a dataset's rows: one subtree a group, proofs by pointer jumping, verification by folding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.session import checkpointed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one task builds at once, from at most 2^LEVELS nodes.
LEVELS = 12
#: A level with at most so many targets is broadcast (under 100 bytes and 33 more for each level below the target).
FEW_TARGETS = 4096
RANKED_ROWS = 100_000
ALONE, LEFT, RIGHT, SUBROOT = 0, 1, 2, 3  # what a step of a proof holds: nothing, a sibling on that side, a subroot's digest
TOP = "2"  # the tree over the subroots; the trees of groups are "0" (null) and "1" with the group's name


def digest_of(columns: list[Column]) -> Column:
    """The 32 bytes of the SHA-256 of all values: ``-`` if null, else UTF-8 byte count, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``at``, the rank from 0 inside ``tree``, and ``total``, the tree's rows; a tree may span any number of tasks."""
    rows = df.count()
    df = df.withColumn("tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "tie"]
    laid = df.repartitionByRange(max(1, math.ceil(rows / RANKED_ROWS)), *keys).sortWithinPartitions(*keys).drop("tie")
    laid = checkpointed(laid.withColumn("place", F.monotonically_increasing_id())).withColumn("slab", F.shiftright("place", 33))
    slabs = laid.groupBy("tree", "slab").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slabs = slabs.select("tree", "slab", "first", before.alias("before"), F.sum("n").over(whole).alias("total"))
    return laid.join(slabs, ["tree", "slab"]).withColumn("at", F.col("place") - F.col("first") + F.col("before")).drop("place", "slab", "first", "before")


def _height(total: int) -> int:
    """Levels from ``total`` nodes up to a single one."""
    return (max(total, 1) - 1).bit_length()


def _parents(digests: list[bytes]) -> list[bytes]:
    texts = [d.hex().encode() for d in digests]
    return [hashlib.sha256(b"".join(texts[i : i + 2])).digest() for i in range(0, len(texts), 2)]


def _nodes(current: DataFrame, carried: list[str]) -> DataFrame:
    """All nodes of every tree over ``current`` (tree, at, total, digest, carried), checkpointed.

    Columns: tree, level, at, digest, step (what its parent's other child is; null for a tree's root) and the carried columns, null
    above level 0. Blocks of 2^LEVELS nodes climb LEVELS levels in one task; what remains of each block is the next round's input.
    """
    kinds = {f.name: f for f in current.schema.fields}
    schema = T.StructType(
        [
            T.StructField("tree", T.StringType()),
            T.StructField("level", T.IntegerType()),
            T.StructField("at", T.LongType()),
            T.StructField("total", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("step", T.BinaryType()),
            *(T.StructField(c, kinds[c].dataType) for c in carried),
        ]
    )

    def climb(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        n = block.num_rows
        tree, base, total = block["tree"][0].as_py(), block["level"][0].as_py(), block["total"][0].as_py()
        row, left = block["digest"].to_pylist(), total
        at = int(block["at"][0].as_py())
        levels, ats, digests, steps, totals = [], [], [], [], []
        for level in range(base, base + LEVELS + 1):
            final = left <= 1 or level == base + LEVELS
            levels += [level] * len(row)
            ats += range(at, at + len(row))
            digests += row
            totals += [left] * len(row)
            if final:
                steps += [None] * len(row)
                break
            for k in range(len(row)):
                other = k ^ 1
                steps.append(bytes([ALONE]) if other >= len(row) else bytes([LEFT if other < k else RIGHT]) + row[other])
            row, left, at = _parents(row), (left + 1) // 2, at // 2
        more = len(levels) - n
        columns = [pa.array([tree] * len(levels)), pa.array(levels, pa.int32()), pa.array(ats, pa.int64()), pa.array(totals, pa.int64())]
        columns += [pa.array(digests, pa.binary()), pa.array(steps, pa.binary())]
        for c in carried:
            own = block[c].combine_chunks()
            columns.append(pa.chunked_array([own, pa.nulls(more, own.type)]).combine_chunks())
        return pa.Table.from_arrays(columns, schema.names)

    rounds = math.ceil(_height(current.agg(F.max("total")).first()[0] or 1) / LEVELS)
    current = current.withColumn("level", F.lit(0)).select("tree", "level", "at", "total", "digest", *carried)
    done = None
    for number in range(max(rounds, 1)):
        built = current.groupBy("tree", F.shiftright("at", LEVELS).alias("block")).applyInArrow(climb, schema)
        built = checkpointed(built)
        # A block's own top is the next round's input unless its tree is complete.
        unfinished = F.col("step").isNull() & (F.col("total") > 1)
        kept = built.where(~unfinished)
        done = kept if done is None else done.unionByName(kept)
        current = built.where(unfinished).drop("step")
        if number + 1 < rounds:
            current = current.select("tree", "level", "at", "total", "digest", *carried)
    return done.drop("total")


def _pointer(tree: Column, level: Column, at: Column) -> list[Column]:
    """Where a node's segment ends: its parent, or nowhere if it has no step."""
    goes = F.col("step").isNotNull()
    return [
        F.when(goes, tree).otherwise(F.lit("")).alias("up_tree"),
        F.when(goes, level).otherwise(F.lit(-1)).alias("up_level"),
        F.when(goes, at).otherwise(F.col("at")).alias("up_at"),
    ]


def _jump(left: DataFrame, inner: DataFrame, few: bool) -> DataFrame:
    """Every row's pointer moved to its target's target, the target's segment appended to its own."""
    target = inner.select(*(F.col(c).alias(f"t_{c}") for c in ("tree", "level", "at", "segment", "up_tree", "up_level", "up_at")))
    same = [left[f"up_{c}"] == target[f"t_{c}"] for c in ("tree", "level", "at")]
    joined = left.join(F.broadcast(target) if few else target, same, "left")
    hit, ends = F.col("t_tree").isNotNull(), F.col("t_up_tree") == ""
    moved = {
        "segment": F.when(hit, F.concat("segment", "t_segment")).otherwise(F.col("segment")),
        "up_tree": F.when(hit, F.col("t_up_tree")).otherwise(F.col("up_tree")),
        # A row that has arrived points nowhere; its own number spreads such rows over the tasks of later joins.
        "up_level": F.when(hit & ~ends, F.col("t_up_level")).when(hit, F.lit(-1)).otherwise(F.col("up_level")),
        "up_at": F.when(hit & ~ends, F.col("t_up_at")).when(hit, F.col("at")).otherwise(F.col("up_at")),
    }
    return joined.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in left.columns))


def _fold(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    node = leaf.hex().encode()
    for side, sibling in steps:
        if side != SUBROOT:
            parts = (sibling, node) if side == LEFT else (node, sibling)
            node = hashlib.sha256(b"".join(parts)).hexdigest().encode()
    return node


def _steps(segment: bytes) -> list[tuple[int, bytes]]:
    """(side, sibling's digest as hex text) from a leaf upwards."""
    out, at = [], 0
    while at < len(segment):
        side = segment[at]
        end = at + (1 if side == ALONE else 33)
        out.append((side, segment[at + 1 : end].hex().encode()))
        at = end
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, leaf, subroot, root, proof_sha256, folded_root, verified, and proof (the siblings).

    A leaf hashes ``fields``. The leaves of each group, by ascending key, and then the groups' roots, by ascending group, are paired
    level by level; a last node without a partner is hashed alone. The proof holds every sibling from leaf to root. ``tampered`` maps
    fields to replaced values; folded_root starts from the leaf of the tampered row and shows whether the proof detects it.

    Null groups form a group of their own, which comes first; null keys come first in their group; rows of one key are ordered by leaf,
    so equal rows get neighbouring places (which of them comes first changes no digest). Null fields and empty texts hash differently.
    A single row is its own root, with an empty proof. An empty table gives no rows. Other columns, whatever their names, take no part.

    Ranks come from sorted range partitions and their counts, so a group that holds most rows is spread over tasks. Blocks of 2^LEVELS
    nodes build LEVELS levels each. Then nodes hold the sibling segment up to their pointer's target, and self-joins double that
    distance; at distance 2^r only levels divisible by 2^r are targets, so the right side shrinks fast and is broadcast once it has at
    most FEW_TARGETS rows.
    """
    spark = docs.sparkSession
    own = {f: F.col(f) for f in fields}
    leaf = digest_of([own[f] for f in fields])
    changed = digest_of([(tampered or {}).get(f, own[f]) for f in fields])
    tree = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    leaves = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf.alias("digest"), *([changed.alias("changed")] if tampered else []))
    if tampered:
        leaves = leaves.withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed")))
    else:
        leaves = leaves.withColumn("changed", F.lit(None).cast("binary"))
    nodes = _nodes(_ranked(checkpointed(leaves), ["key", "digest"]), ["key", "changed"])

    tops = nodes.where("step is null").select("tree", "level", "at", "digest")
    over = tops.select(F.lit(TOP).alias("tree"), F.struct("tree", "level", "at").alias("below"), F.col("tree").alias("name"), "digest")
    over = _nodes(_ranked(checkpointed(over), ["name"]), ["below"])
    root = over.where("step is null").select("digest").first()
    root = root[0].hex() if root else ""

    side = ["key", "digest", "changed"]
    # Inside a group; its root goes on in the tree over the groups and notes its digest as the subroot on the way.
    parent = (F.col("tree"), F.col("level") + 1, F.shiftright("at", 1))
    inside = nodes.where("step is not null").select("tree", "level", "at", F.col("step").alias("segment"), *_pointer(*parent), *side)
    mark = F.concat(F.lit(bytes([SUBROOT])), F.col("digest"), F.coalesce("step", F.lit(b"")))
    crossing = over.where("level = 0").select("below.*", mark.alias("segment"), *_pointer(F.lit(TOP), F.lit(1), F.shiftright("at", 1)), "digest")
    crossing = crossing.join(nodes.where("step is null").select("tree", "key", "changed"), "tree").select(*inside.columns)
    above = over.where("level > 0").select("tree", "level", "at", F.coalesce("step", F.lit(b"")).alias("segment"), *_pointer(*parent))
    every = checkpointed(inside.unionByName(crossing))
    rows = every.where("level = 0")
    inner = every.where("level > 0").drop(*side).unionByName(above)

    heights = nodes.agg(F.max("level")).first()[0] or 0
    depth = heights + (over.agg(F.max("level")).first()[0] or 0) + 1
    for r in range(max(depth - 1, 0).bit_length()):
        inner = checkpointed(inner.where((F.col("level") % (1 << r) == 0) | (F.col("tree") == TOP)))
        few = inner.count() <= FEW_TARGETS
        rows, inner = _jump(rows, inner, few), _jump(inner, inner, few)

    kind = docs.schema[key].dataType
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    out = T.StructType([T.StructField(key, kind), *(T.StructField(t, T.StringType()) for t in texts), T.StructField("verified", T.BooleanType()), T.StructField("proof", T.ArrayType(T.StringType()))])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[list] = [[] for _ in range(7)]
            for digest, other, segment in zip(batch.column("digest").to_pylist(), batch.column("changed").to_pylist(), batch.column("segment").to_pylist(), strict=True):
                steps = _steps(segment)
                siblings = [s for d, s in steps if d in (LEFT, RIGHT)]
                folded = _fold(other or digest, steps).decode()
                subroot = next(s for d, s in steps if d == SUBROOT).decode()
                found = [digest.hex(), subroot, root, hashlib.sha256(b"".join(siblings)).hexdigest(), folded, folded == root, [s.decode() for s in siblings]]
                for cell, value in zip(cells, found, strict=True):
                    cell.append(value)
            kinds = [pa.string()] * 5 + [pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], out.names)

    return rows.select("key", "digest", "changed", "segment").mapInArrow(verify, out)
