"""Benchmark decontamination: a broadcast hash set of normalised test windows, scanned over token windows.

Words are those of :func:`siteglass.llm.common.words_of`. An item's windows are its runs of ``window`` words; an item of
fewer words, but not none, is one window. The set of windows is broadcast only while the benchmark's texts stay under
``most_bytes``; a larger benchmark is cut in slices of that size by hash of item. Slices are fetched, broadcast, scanned and
dropped one after the other, and their hits are united by row before anything is cut or judged, so that the result doesn't
depend on their number. A document word that no item has ends a run, so only runs of benchmark words are hashed; every
hash hit is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.common import WORD_BYTES, discard, small_batches, stored, words_of

ODD = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """Windows of benchmark items, looked up by a rolling hash and verified."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.ids: dict[bytes, int] = {}
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                self.owners.setdefault(tuple(words[i : i + size]), set()).add(item)
        rng = np.random.default_rng(7)
        self.codes = rng.integers(1, 1 << 63, len(self.ids) + 1, dtype=np.uint64) | np.uint64(1)
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for w in self.owners:
            by_size.setdefault(len(w), []).append(w)
        self.hashes = {n: np.sort(self.hash(np.array(ws, np.int64).reshape(-1), n)[::n]) for n, ws in by_size.items()}

    def hash(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all windows of the row of ids, in order."""
        codes, n = self.codes[ids], len(ids) - size + 1
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * ODD + codes[k : k + n]
        return total ^ (total >> np.uint64(29))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items with occurring windows."""
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        hit, items = np.zeros(len(words), bool), set()
        for size, known in self.hashes.items():
            if len(ids) < size:
                continue
            outside = np.concatenate([[0], np.cumsum(ids < 0)])
            starts = np.flatnonzero(outside[size:] == outside[:-size])
            if not len(starts):
                continue
            codes = self.codes[ids]
            total = np.zeros(len(starts), np.uint64)
            for k in range(size):
                total = total * ODD + codes[starts + k]
            total ^= total >> np.uint64(29)
            at = np.minimum(np.searchsorted(known, total), len(known) - 1)
            for i in starts[known[at] == total].tolist():
                if (own := self.owners.get(tuple(ids[i : i + size].tolist()))) is not None:
                    items |= own
                    hit[i : i + size] = True
        return hit, items

    def cut(self, text: str | None) -> tuple[str | None, float]:
        """The text without its hit runs, each replaced by a line break, until no window occurs; and the share of words hit."""
        first = gone = 0
        while True:
            words = words_of(text)
            first = first or len(words)
            hit, _ = self.scan(words)
            if not hit.any():
                return text, gone / max(first, 1)
            gone += int(hit.sum())
            text = cut_at(text, hit)


def cut_at(text: str, hit: np.ndarray) -> str:
    """The text with each run of hit words replaced by a line break."""
    raw = text.encode()
    plain = raw.translate(WORD_BYTES)
    at, spans = 0, []
    for w in plain.split():
        at = plain.index(w, at)
        spans.append((at, at := at + len(w)))
    out, last = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():
        out += [raw[last : spans[a][0]], b"\n"]
        last = spans[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def slice_count(benchmark: DataFrame, most_bytes: int) -> int:
    return -(-(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes) or 1


def slices(benchmark: DataFrame, n: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's items in n lists, of which one at a time is fetched."""
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    for i in range(n):
        yield [tuple(r) for r in benchmark.where(part == i).select("item_id", "text").collect()]


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = 4 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (item_ids with occurring windows, ascending).

    Null texts have no words, of a document or an item; repeated items count once by item_id, repeated documents each
    give a row, as do null ids. An empty benchmark hits nothing. With more than one slice rows are stored with a key, by
    which the slices' positions and items are united.
    """
    n = slice_count(benchmark, most_bytes)
    if n == 1:
        return _scan(spark, docs, next(slices(benchmark, n)), window)[0].select("doc_id", "n_words", F.size("places").cast("long").alias("n_hit"), "items")
    rows, _ = stored(spark, docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "rows")
    found = None
    for items in slices(benchmark, n):
        one, table = _scan(spark, rows.select(F.col("row").alias("doc_id"), "text"), items, window)
        # every row is in the first slice's part, with its number of words
        one, _ = stored(spark, one if found is None else one.where(F.size("places") > 0), "hits")
        table.unpersist()
        found = one if found is None else found.union(one)
    united = found.withColumnRenamed("doc_id", "row").groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return rows.select("row", "doc_id").join(united, "row").select("doc_id", "n_words", "n_hit", "items")


def _scan(spark: SparkSession, docs: DataFrame, items: list, window: int) -> tuple[DataFrame, Broadcast]:
    """(doc_id, n_words, places, items) of each row for one slice, and the slice's broadcast windows."""
    table = spark.sparkContext.broadcast(Windows(items, window))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            n_words, places, owners = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hit, own = known.scan(words)
                n_words.append(len(words))
                places.append(np.flatnonzero(hit).tolist())
                owners.append(sorted(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.int64()))], ["doc_id", "n_words", "places", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, places array<int>, items array<long>"), table


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The columns of op7: hits with a digest of the item_ids, sorted as strings and comma-joined."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits(spark, docs, benchmark, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, drop_share: float = 0.5, most_bytes: int = 4 << 20) -> DataFrame:
    """docs with hit spans cut out of text; rows of which drop_share of the words or more are hit go.

    All columns stay, n_chars (if there) follows the new text. Null texts stay as they are. The number of slices doesn't
    change the result: each round cuts at the union of all slices' hits, and rounds go on until no slice hits.
    """
    small_batches(spark)
    n = slice_count(benchmark, most_bytes)
    out = _remove_at_once(spark, docs, next(slices(benchmark, n)), window, drop_share) if n == 1 else _remove_by_slices(spark, docs, benchmark, n, window, drop_share)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out


def _remove_at_once(spark: SparkSession, docs: DataFrame, items: list, window: int, drop_share: float) -> DataFrame:
    table = spark.sparkContext.broadcast(Windows(items, window))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [table.value.cut(t) for t in batch.column(at).to_pylist()]
            stays = pa.array([share < drop_share for _, share in got], pa.bool_())
            yield batch.set_column(at, batch.schema.field(at), pa.array([t for t, _ in got], batch.schema.field(at).type)).filter(stays)

    return docs.mapInArrow(run, docs.schema)


def _remove_by_slices(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int, window: int, drop_share: float) -> DataFrame:
    """Rows get a stored key, as documents may repeat or lack an id; rows without hits are not scanned again."""
    now, path = stored(spark, docs.select("*", F.monotonically_increasing_id().alias("_row"), F.lit(0).cast("long").alias("_first"), F.lit(0).cast("long").alias("_gone"), F.lit(True).alias("_open")), "rows")
    while True:
        found, paths = None, []
        for items in slices(benchmark, n):
            scanned, table = _scan(spark, now.where("_open").select(F.col("_row").alias("doc_id"), "text"), items, window)
            one, one_path = stored(spark, scanned.where(F.size("places") > 0).select(F.col("doc_id").alias("_row"), "n_words", "places"), "hits")
            table.unpersist()
            found = one if found is None else found.union(one)
            paths.append(one_path)
        if not found.limit(1).count():
            discard(spark, *paths)
            break
        places = found.groupBy("_row").agg(F.max("n_words").alias("_words"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("_places"))
        joined = now.join(places, "_row", "left").select(*now.columns, "_words", "_places")
        schema, at = joined.schema, joined.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = []
                for text, size, hit_at in zip(batch.column(at).to_pylist(), batch.column("_words").to_pylist(), batch.column("_places").to_pylist(), strict=True):
                    if hit_at:
                        hit = np.zeros(size, bool)
                        hit[hit_at] = True
                        text = cut_at(text, hit)
                    texts.append(text)
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

        cut = joined.mapInArrow(run, schema)
        hit = F.col("_places").isNotNull()
        first = F.when(hit & (F.col("_first") == 0), F.col("_words")).otherwise(F.col("_first"))
        gone = F.col("_gone") + F.when(hit, F.size("_places")).otherwise(0)
        after, fresh = stored(spark, cut.select(*docs.columns, "_row", first.alias("_first"), gone.alias("_gone"), hit.alias("_open")), "rows")
        discard(spark, path, *paths)
        now, path = after, fresh
    return now.where(F.col("_gone") / F.greatest("_first", F.lit(1)) < drop_share).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
  sha256(coalesce(o.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""
