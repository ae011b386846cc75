"""Shared Spark steps of the text operators: columns computed on Arrow batches, bucket numbers, connected components."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.words import CHUNK_BYTES, chunks
from lodestat.session import checkpointed

BUCKET_BYTES = 24 << 20


def add_columns(
    df: DataFrame, new: list[T.StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]], drop: tuple[str, ...] = (), by: str = "text", limit: int = CHUNK_BYTES
) -> DataFrame:
    """``df`` with the columns ``compute`` returns for each small batch; a column of the same name is replaced.

    Batches are cut at ``limit`` bytes of the column ``by``.
    """
    taken = {f.name.lower() for f in new} | {d.lower() for d in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in kept]
    heads = [*names, *(f.name for f in new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, by, limit):
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *compute(batch)], heads)

    return df.mapInArrow(run, T.StructType([*kept, *new]))


def documents_of(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads; Parquet scans then skip the rest."""
    return df.select("doc_id", "text", *more)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(total_bytes: int, bucket_bytes: int = BUCKET_BYTES, least: int = 8) -> int:
    """As many buckets as bound the bytes of each, whatever the input's size."""
    return max(least, math.ceil(total_bytes / bucket_bytes))


def bucket_by_bucket(handle: Callable[[list[pa.Buffer]], Iterator[pa.RecordBatch]], through: int | None = None):
    """``handle`` for the payloads of one bucket after the other, from rows in order of bucket; one bucket is held at a time.

    Rows of the kind ``through`` go through as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            passes = pa.compute.equal(batch.column("kind"), through)
            if pa.compute.any(passes).as_py():
                yield batch.filter(passes)
                batch = batch.filter(pa.compute.invert(passes))
            payload = batch.column("payload")
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if held and bucket != last:
                    yield from handle(held)
                    held = []
                last = bucket
                held.append(payload[k].as_buffer())
        if held:
            yield from handle(held)

    return run


def held_out(modulus: int, remainder: int):
    """Whether crc32(doc_id as text) leaves ``remainder``; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and the shuffle files of what led to it released.

    Spark deletes them when the driver's garbage is collected, which a driver with little to do may put off until the disks of a
    many-phase operator are full.
    """
    out = checkpointed(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over the links, for every node that has one.

    Each round lowers a node's root to its neighbours' smallest and then follows the root once (pointer jumping), so stars end in
    two rounds and chains in a logarithmic number. Minima are partially aggregated before each shuffle, and joins on a hot node
    are joins AQE can split.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = checkpointed(both.union(both.select("v", "u")).distinct())
    roots = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:
        near = both.join(roots, both.v == roots.node).groupBy("u").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots.node == near.u, "left").select("node", "root", F.least("root", "near").alias("lower"))
        lead = roots.select(F.col("node").alias("lead"), F.col("root").alias("its"))
        jumped = lower.join(lead, lower.lower == lead.lead, "left").select(
            "node", F.least("lower", "its").alias("root"), (F.least("lower", "its") < F.col("root")).alias("moved")
        )
        jumped = checkpointed(jumped)
        moved = jumped.where("moved").limit(1).count()
        roots = jumped.select("node", "root")
        if not moved:
            return roots
