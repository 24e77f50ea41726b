"""Helpers that the corpus operators share: shared storage, word splitting, bounded caches, components."""

from __future__ import annotations

import weakref
from collections.abc import Iterable
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.storage import discard, new_path, open_path, shared_dir, stored

__all__ = ["BoundedCache", "components", "discard", "join_checked", "new_path", "open_path", "row_key", "shared_dir", "small_batches", "stored", "table", "words_of"]

#: Bytes outside words become blanks and A-Z become a-z; bytes of non-ASCII characters stay.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return [] if text is None else text.encode().translate(WORD_BYTES).split()


def small_batches(spark: SparkSession, rows: int = 1000, most_bytes: int = 16 << 20) -> None:
    """Bound the session's Arrow batches by rows and by bytes, as texts are long: a worker and the JVM each hold a batch or two."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> F.Column:
    """MD5 of doc_id and text: equal for equal rows only, null ids and texts included."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit("|"), F.coalesce("text", F.lit("")))))


class BoundedCache(dict):
    """A dictionary by strings that is emptied once it holds more than ``most`` entries, or when another one of its worker is in use.

    Keys of more than ``LONGEST`` characters stay until room is made for the next batch, so that its bytes are bounded
    by its entries and one batch.
    """

    LONGEST = 64
    alive: ClassVar[list[weakref.ref]] = []

    def __init__(self, most: int):
        super().__init__()
        self.most, self.long = most, []
        self.alive.append(weakref.ref(self))

    def keep(self, names: list, values: Iterable) -> None:
        self.update(zip(names, values, strict=True))
        self.long += [x for x in names if len(x) > self.LONGEST]

    def make_room(self) -> None:
        for ref in self.alive:
            if (other := ref()) is not None and other is not self:
                other.clear()
                other.long.clear()
        for x in self.long:
            self.pop(x, None)
        self.long.clear()
        if len(self) > self.most:
            self.clear()


def join_checked(spark: SparkSession, left: DataFrame, right: DataFrame, on: list[str], how: str, most: int) -> DataFrame:
    """Broadcast the right side if it has at most ``most`` rows (it is counted); beyond that the join shuffles."""
    small = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if small else right, on, how)


def components(spark: SparkSession, edges: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Connected components of edges (a, b): rows (node, comp), comp being the least node; and the stored table's path.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each round's edges are written to the
    shared folder, so a lost executor costs one round at most, and no vertex's neighbours are ever gathered in a task:
    both steps need a minimum by key and a join only. The join is on a struct of the key, so that the minima are shuffled
    once more and Spark can split the partition of a node with very many edges.
    """
    key = F.struct("a").alias("k")
    now, path = stored(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(key, F.least("a", "m").alias("m"))
        large = both.where("b > a").select(key, "b").join(low, "k").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a > b").distinct()
        low2 = down.groupBy("a").agg(F.min("b").alias("m")).select(key, "m")
        small = down.select(key, "b").join(low2, "k").select(F.col("b").alias("x"), "m", F.col("k.a").alias("a"))
        step = small.where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        after, fresh = stored(spark, step, label)
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(spark, path)
        now, path = after, fresh
        if mark == seen:
            break
        seen = mark
    return now.union(now.select("b", "b").distinct()).toDF("node", "comp"), path
