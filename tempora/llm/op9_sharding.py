"""Sharding: a two-pass external shuffle under the ``key`` law.

Pass one scatters whole records uniformly into buckets that fit in memory: the id and the number of
shards decide the shard (a jump consistent hash, so one more shard takes rows only into itself), and
a second seeded hash the bucket within it. Pass two puts each bucket in order of its ids and shuffles
it by Fisher-Yates from a generator seeded with the bucket's number; the slot of a record is its
bucket's first slot plus its place. First slots come from the sizes of the buckets, a table of one
row per bucket.

Edge cases. A null text counts as none (size 1, crc32 of nothing: 0); a null id is hashed as the
text "null", so its rows share a shard. Rows repeated with the same id stay in one shard, as the law asks,
but fall into its buckets by their texts as well. Very long texts travel as they are; empty tables
give empty results. Extra columns travel along; names that clash with those added raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workdir import cut

#: Bytes of text that a bucket is to hold.
BUCKET_BYTES = 16 << 20


def id_hash(seed: int) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed))


def jump_shard(h: Column, shards: int) -> Column:
    """The shard of a hash by the jump rule: going from n to n + 1 shards, a record moves to the new
    shard with probability 1/(n + 1), decided by the n-th draw of a generator keyed with its hash,
    and stays otherwise. The draws do not depend on the number of shards."""
    shard = F.lit(0)
    for n in range(1, shards):
        draw = F.pmod(F.xxhash64(h, F.lit(n)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        shard = F.when(draw * (n + 1) < 1, F.lit(n)).otherwise(shard)
    return shard


def shard(docs: DataFrame, shards: int = 16, seed: int = 19, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with shard, grown_shard and slot, in buckets that are in their final order."""
    clash = {"shard", "grown_shard", "slot", "bucket"} & set(docs.columns)
    if clash:
        raise ValueError(f"the table already has columns {sorted(clash)}")
    total = docs.select(F.sum(F.octet_length("text").cast("long") + F.lit(64))).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    h = id_hash(seed)
    scattered = docs.withColumns(
        {
            "shard": jump_shard(h, shards),
            "grown_shard": jump_shard(h, shards + 1),
        }
    ).withColumn("bucket", F.col("shard").cast("long") * per_shard + F.pmod(F.xxhash64(h, F.xxhash64("text"), F.lit(seed + 1)), F.lit(per_shard)))

    def fisher_yates(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        order = pc.sort_indices(table.select([table.schema.get_field_index("doc_id"), table.schema.get_field_index("text")]).rename_columns(["a", "b"]), [("a", "ascending"), ("b", "ascending")])
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed, spawn_key=(bucket,))))
        place = np.arange(table.num_rows)
        for i, j in zip(range(table.num_rows - 1, 0, -1), rng.integers(0, np.arange(table.num_rows, 1, -1)) if table.num_rows > 1 else (), strict=False):
            place[i], place[j] = place[j], place[i]
        return table.take(pa.array(order.to_numpy()[place])).append_column("place", pa.array(np.arange(table.num_rows)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered.schema)
    done = scattered.groupBy("bucket").applyInArrow(fisher_yates, f"{fields}, place long")
    sizes = cut(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.first("shard").alias("at")))
    firsts = sizes.select("bucket", (F.sum("n").over(Window.partitionBy("at").orderBy("bucket")) - F.col("n")).alias("first"))
    return done.join(firsts, "bucket").withColumn("slot", F.col("first") + F.col("place")).drop("bucket", "first", "place")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 19) -> None:
    """Write each shard as a folder of Parquet files in slot order."""
    out = shard(docs, shards, seed)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per record: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return shard(docs.select("doc_id", "text"), shards).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
