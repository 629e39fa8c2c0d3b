"""Token ids of documents in binary shards, with a minimal perfect hash index.

File format, under one folder of the shared store:

* ``shards``: Parquet rows ``shard, block, first_id, payload, ids, lengths``.  A
  payload is the ids of a run of documents, one after the other, as raw little-endian
  unsigned integers of 2 bytes (4 for vocabularies beyond 65,536); a block holds about
  ``BLOCK_IDS`` ids, or one longer document.  Shards are ranges of document ids and
  are sorted, so (shard, block, place) is the ascending order of ids.
* ``index``: Parquet rows ``bucket, seeds, prints, shard, block, offset, length,
  start``, one for about ``BUCKET`` keys.  A key's bucket comes from its hash; the
  bucket's seeds map its m keys one to one onto 0..m-1 (hash and displace: groups of
  keys, largest first, take the first seed that puts all of them on free slots; single
  keys take free slots directly); the slot's 32-bit print tells foreign keys apart.
  ``get`` touches one index row and one block, whatever the size of the store.

Scale: texts are shuffled once, by range of id; ids are encoded after that shuffle and
go straight to the files.  Starts are running sums over shards (one row each) and,
within a shard, over blocks.  Buckets hold a bounded number of keys by construction.

Edge cases: a null or empty text is the end id alone; rows that repeat an id are all
stored, in the order of their texts' hashes, and the index names the first; rows
without an id come first, and are not indexed; other columns are ignored; an empty
table gives empty files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import mix
from .tokens import as_texts, encoder

BLOCK_IDS, BUCKET, DIRECT = 1 << 20, 2048, -1


def _encode_blocks(tokenizer: str, end_id: int, width: int):
    kind = f"<u{width}"

    def run(batches):
        own = encoder(tokenizer)
        shard, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        payload: list[bytes] = []
        lengths: list[int] = []

        def block():
            nonlocal number
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([b"".join(payload)]),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32()))],
                names=["shard", "block", "payload", "ids", "lengths"])
            number += 1
            ids.clear(), payload.clear(), lengths.clear()
            return out

        held = 0
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                for key, raw in zip(part.column(0).to_pylist(), own.encode(as_texts(part.column(1)))):
                    row = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))
                    if held and held + len(row) > BLOCK_IDS:
                        yield block()
                        held = 0
                    ids.append(key)
                    payload.append(row.astype(kind).tobytes())
                    lengths.append(len(row))
                    held += len(row)
        if ids:
            yield block()
    return run


def write(docs: DataFrame, root: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes shards and index."""
    spark = docs.sparkSession
    width = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = own.repartitionByRange(shards, F.asc_nulls_first("id")) \
        .sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"))
    dealt.mapInArrow(_encode_blocks(tokenizer, end_id, width),
                     "shard int, block int, payload binary, ids array<long>, lengths array<int>") \
        .write.parquet(f"{root}/shards")
    entries = places(spark, root)
    keys = cut_lineage(entries.where("id is not null").groupBy("id").agg(
        F.min(F.struct("start", "shard", "block", "offset", "length")).alias("e")).select("id", "e.*"))
    n_buckets = max(1, -(-keys.count() // BUCKET))
    spark.createDataFrame([(n_buckets, width)], "buckets long, width int").write.parquet(f"{root}/meta")
    keys.withColumn("bucket", _bucket("id", n_buckets)).repartitionByRange("bucket") \
        .groupBy("bucket").applyInPandas(_build, INDEX).write.parquet(f"{root}/index")


def _bucket(col: str, n: int):
    return F.pmod(F.xxhash64(F.col(col).cast("long"), F.lit("bucket")), F.lit(n))


INDEX = ("bucket long, seeds array<int>, prints array<long>, shard array<int>, block array<int>, "
         "offset array<int>, length array<int>, start array<long>")


def _key_hash(keys: np.ndarray, seed) -> np.ndarray:
    salt = mix(np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(0x51ED27))
    return mix(keys.astype(np.int64).view(np.uint64) ^ salt)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and the slot of each of the m distinct keys: a permutation of 0..m-1.
    A seed below 0 is a slot, as ``DIRECT - slot``."""
    m = len(keys)
    groups = max(1, -(-m // 3))
    group = (_key_hash(keys, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    first = np.concatenate([[0], np.cumsum(sizes)])
    seeds, slots, free = np.zeros(groups, np.int64), np.zeros(m, np.int64), np.ones(m, bool)
    tries = np.arange(1, 65)
    for g in np.argsort(-sizes, kind="stable"):
        own = order[first[g]: first[g + 1]]
        if len(own) < 2:
            break
        at = 0
        while True:
            put = np.sort((_key_hash(keys[own][None, :], (tries + at)[:, None]) % np.uint64(m)).astype(np.int64), axis=1)
            ok = free[put].all(axis=1) & (put[:, 1:] != put[:, :-1]).all(axis=1)
            if ok.any():
                seeds[g] = at + 1 + int(np.argmax(ok))
                break
            at += len(tries)
        slots[own] = (_key_hash(keys[own], seeds[g]) % np.uint64(m)).astype(np.int64)
        free[slots[own]] = False
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    seeds[single], slots[order[first[single]]] = DIRECT - left, left
    return seeds, slots


def slot_of(keys: np.ndarray, seeds: np.ndarray, m: int) -> np.ndarray:
    group = (_key_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    seed = seeds[group].astype(np.int64)
    hashed = (_key_hash(keys, np.maximum(seed, 0)) % np.uint64(m)).astype(np.int64)
    return np.where(seed < 0, DIRECT - seed, hashed)


def _print_of(keys: np.ndarray) -> np.ndarray:
    return (_key_hash(keys, 0xF1) >> np.uint64(32)).astype(np.int64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["id"].to_numpy(np.int64)
    seeds, slots = perfect_hash(keys)
    pdf = pdf.iloc[np.argsort(slots)]
    cols = {c: [pdf[c].to_numpy()] for c in ("shard", "block", "offset", "length", "start")}
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seeds": [seeds],
                         "prints": [_print_of(pdf["id"].to_numpy(np.int64))], **cols})


def _starts(spark: SparkSession, root: str) -> DataFrame:
    """``shard, block, block_start``: ids of all documents before each block."""
    sizes = spark.read.parquet(f"{root}/shards").select(
        "shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")) \
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("in_shard", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(shards, "shard") \
        .select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("block_start"))


def _rows(with_crc: bool):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # one block at a time
                shard, block, payload, ids, lengths = (c[i] for c in b.columns)
                n = lengths.values.to_numpy().astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                cols = [np.full(len(n), shard.as_py(), np.int32), np.full(len(n), block.as_py(), np.int32),
                        at[:-1].astype(np.int32), n.astype(np.int32)]
                if with_crc:
                    held = payload.as_buffer()
                    width = held.size // max(1, int(at[-1]))
                    raw = np.frombuffer(held, f"<u{width}").astype("<u4")
                    cols.append(np.array([zlib.crc32(raw[a:z]) for a, z in zip(at[:-1], at[1:])], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.values, *map(pa.array, cols)],
                    names=["id", "shard", "block", "offset", "length", *["crc"] * with_crc])
    return run


def places(spark: SparkSession, root: str, crc: bool = False) -> DataFrame:
    """Per stored document: ``id, shard, block, offset, length, start`` (and ``crc`` of
    its ids as unsigned 32-bit integers), read from the shard files.  Payloads are read
    where they lie; only the documents' short rows meet the starts of their blocks."""
    payload = F.col("payload") if crc else F.lit(b"").alias("payload")
    kind = "id long, shard int, block int, offset int, length int" + ", crc long" * crc
    rows = spark.read.parquet(f"{root}/shards").select("shard", "block", payload, "ids", "lengths") \
        .mapInArrow(_rows(crc), kind)
    return rows.join(_starts(spark, root), ["shard", "block"]).select(
        "id", "shard", "block", "offset", "length", (F.col("block_start") + F.col("offset")).alias("start"),
        *["crc"] * crc)


def _n_buckets(spark: SparkSession, root: str) -> tuple[int, int]:
    row = spark.read.parquet(f"{root}/meta").first()
    return row["buckets"], row["width"]


def find(keys: DataFrame, root: str, id_col: str = "id") -> DataFrame:
    """``keys`` with the place that the index gives: ``shard, block, offset, length,
    start`` (null: not in the store)."""
    spark = keys.sparkSession
    n, _ = _n_buckets(spark, root)
    own = keys.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct() \
        .withColumn("bucket", _bucket("id", n))
    index = spark.read.parquet(f"{root}/index")

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["shard", "block", "offset", "length", "start"]
        out = pd.DataFrame({"id": left["id"]})
        if not len(left) or not len(right):
            return out.assign(**{c: pd.array([None] * len(left), "Int64") for c in cols})
        r, k = right.iloc[0], left["id"].to_numpy(np.int64)
        slot = slot_of(k, np.asarray(r["seeds"]), len(r["prints"]))
        known = np.asarray(r["prints"])[slot] == _print_of(k)
        return out.assign(**{c: pd.arrays.IntegerArray(np.asarray(r[c], np.int64)[slot], ~known) for c in cols})

    return own.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        look, "id long, shard long, block long, offset long, length long, start long")


def get(spark: SparkSession, root: str, key: int) -> list[int] | None:
    """The ids stored under one key: one index row, one block."""
    n, width = _n_buckets(spark, root)
    bucket = spark.range(int(key), int(key) + 1).select(_bucket("id", n).alias("b"))
    row = spark.read.parquet(f"{root}/index").where(F.col("bucket") == bucket.first()["b"]).first()
    if row is None:
        return None
    k = np.array([key], np.int64)
    slot = int(slot_of(k, np.array(row["seeds"]), len(row["prints"]))[0])
    if row["prints"][slot] != int(_print_of(k)[0]):
        return None
    at, size = row["offset"][slot] * width, row["length"][slot] * width
    block = spark.read.parquet(f"{root}/shards").where(
        (F.col("shard") == row["shard"][slot]) & (F.col("block") == row["block"][slot])).select(
        F.substring("payload", at + 1, size).alias("ids")).first()
    return np.frombuffer(block["ids"], f"<u{width}").tolist()


def digest(spark: SparkSession, root: str) -> DataFrame:
    """Per stored document what its files say, and whether the index finds it there."""
    rows = places(spark, root, crc=True)
    # ids without payloads, so that sums are computed once
    found = find(places(spark, root).select("id"), root).select("id", F.col("start").alias("index_start"),
                                                 F.col("length").alias("index_length"))
    return rows.join(found, "id", "left").select(
        F.col("id").alias("doc_id"), "start", F.col("length").cast("long").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
        ((F.col("index_start") == F.col("start")) & (F.col("index_length") == F.col("length"))).alias("indexed"))
