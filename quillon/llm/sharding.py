"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents of one source stay together in groups of at most about 1/GRAIN of a shard: a larger source is parted by a hash of the document
id, and sources that are smaller go into common groups by a hash of their name. So there are some GRAIN to 2*GRAIN groups for each shard, however
many documents or sources there are. A group is a vector of bytes, tokens and rows, each as a share of what one shard can hold. From the
largest on, each goes to the shard that it fits where the dot product with the residual capacity is highest, or, where it fits none, to the highest
dot product of all. Beyond FAN shards, groups go to pods of FAN shards in the same way first.

Cases: null texts have no bytes or tokens and count as rows. A null source counts as the empty name. A document that is larger than a shard has a
shard to itself as far as the others leave it. Repeated rows with the same id go to the same shard. Ties go to the lower shard. Other columns are
never read; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import written
from quillon.llm.tokens import VOCABULARY, token_counts

SHARD_BYTES = 64 << 20
GRAIN = 8
SLACK = 0.02
FAN = 1024


def place(groups: np.ndarray, n_shards: int, slack: float = SLACK) -> np.ndarray:
    """The shard of each group, of vectors with one row for each group."""
    out = np.zeros(len(groups), np.int64)
    if n_shards <= 1 or not len(groups):
        return out
    if n_shards > FAN:
        pods = -(-n_shards // FAN)
        edge = np.arange(pods + 1) * n_shards // pods
        pod = place(groups, pods, slack)
        for k in range(pods):
            mine = np.flatnonzero(pod == k)
            out[mine] = edge[k] + place(groups[mine], int(edge[k + 1] - edge[k]), slack)
        return out
    total = groups.sum(0)
    share = groups / np.where(total > 0, total / n_shards * (1 + slack), 1.0)
    room = np.ones((n_shards, groups.shape[1]))
    for g in np.lexsort([np.arange(len(groups)), -share.sum(1), -share.max(1)]):
        dot = room @ share[g]
        fits = (room >= share[g] - 1e-12).all(1)
        s = int(np.argmax(np.where(fits, dot, -np.inf) if fits.any() else dot))
        out[g] = s
        room[s] -= share[g]
    return out


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source", shard_bytes: int = SHARD_BYTES, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, shard) of every document."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("__name"), F.col(text_col).alias("__text"))
    counted = token_counts(named, "__id", "__text", vocabulary, extra=("__name",))
    sizes = written(counted.select("__id", "__name", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), "sizes")
    sums = (F.sum("n_bytes").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("r"))
    b, t, r = (x or 0 for x in sizes.agg(*sums).first())
    n_shards = max(1, -(-b // shard_bytes))
    grains = F.greatest(*(F.col(k) * F.lit(float(n_shards * GRAIN)) / F.lit(float(max(1, v))) for k, v in (("b", b), ("t", t), ("r", r))))
    sources = sizes.groupBy("__name").agg(*sums).withColumn("cuts", F.ceil(grains))
    small = F.col("cuts") <= 1
    common = F.concat(F.lit("h"), F.pmod(F.xxhash64("__name"), F.lit(n_shards * GRAIN)).cast("string"))
    cuts = written(sources.select("__name", F.when(small, common).otherwise(F.concat(F.lit("s"), "__name")).alias("whole"), F.greatest("cuts", F.lit(1)).alias("cuts")), "cuts")
    parts = written(sizes.join(cuts, "__name").withColumn("part", F.pmod(F.xxhash64("__id"), F.col("cuts"))).drop("cuts", "__name"), "parts")
    groups = parts.groupBy("whole", "part").agg(*sums).orderBy("whole", "part").toArrow()  # some GRAIN rows for each shard
    vectors = np.stack([groups[k].to_numpy() for k in ("b", "t", "r")], 1).astype(float)
    shards = groups.select(["whole", "part"]).append_column("shard", [place(vectors, n_shards)])
    found = spark.createDataFrame(shards)
    return parts.join(found, ["whole", "part"]).select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", F.col("shard").cast("int").alias("shard"))
