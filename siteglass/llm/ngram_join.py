"""N-gram Jaccard join by chosen paths.

A text is the set of 64-bit hashes of its runs of five words (fewer words: one run). Equal sets are one node, whose id is
the MD5 of the set. A node's MinHash coordinates embed its set; as in Christiani, Pagh and Sivertsen (2018) a run samples
coordinates with an expected 1/threshold of them, nodes that share the value sampled share a path, and paths are cut again
at freshly sampled coordinates until their buckets are small. Runs repeat until the target recall at the threshold.

Small buckets are compared by brute force on the coordinates with five standard deviations of slack, and give a spanning
forest of candidate links; buckets that stay large at the last depth hold near-equal sets, and are linked as a star.
Candidate components are then verified exactly: members meet in cells of two blocks of bounded size, all pairs of a cell
are compared by one weighted matrix product, and only counts of links and a spanning forest leave the cell. No link between
different sets of a component is lost, and no task grows with a group. What does grow with the square of a component of N
different sets is their comparison: as each set is to meet all others, N / 256 copies of it move. Equal texts count once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.byte_bpe import groups_by_bytes
from siteglass.llm.common import BoundedCache, components, discard, join_checked, row_key, small_batches, stored, words_of

WORDS, COORDINATES, DEPTH, BUCKET = 5, 64, 3, 64
BLOCK_DOCS, BLOCK_SHINGLES, BLOOM_BITS = 256, 300_000, 1 << 24
SEEDS = np.random.default_rng(20180610).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
MIX = np.random.default_rng(5).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
CODES = BoundedCache(150_000)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; a text of fewer words, but not none, has one run."""
    ws = words_of(text)
    if not ws:
        return np.zeros(0, np.uint64)
    fresh = {w for w in ws if w not in CODES}
    CODES.keep(list(fresh), (int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in fresh))
    codes = np.array([CODES[w] for w in ws], np.uint64)
    k = min(n, len(codes))
    total = np.zeros(len(codes) - k + 1, np.uint64)
    for j in range(k):
        total = mixed(total * MIX[0] + codes[j : len(codes) - k + 1 + j])
    return np.unique(total + np.uint64(k))


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash coordinates: for each seed the least of the re-hashed members, its low 32 bits."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        z = hashes[i : i + 4096, None] * SEEDS
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out = np.minimum(out, (z ^ (z >> np.uint64(32))).min(0))
    return out.astype(np.uint32)


def survival(depth: int) -> float:
    """Chance that a pair at the threshold shares a path of this depth in one run: Poisson branching of mean 1."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def chosen(seed: int, share: float) -> list[int]:
    """Coordinates a run samples at its root: about a share of 1/COORDINATES of them in the mean, one at least."""
    rng = np.random.default_rng(seed)
    return sorted(rng.choice(COORDINATES, max(1, rng.poisson(share)), replace=False).tolist())


def embedded(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sid, n, sig) of each row of (doc_id, text, row); a text without words has a null sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            CODES.make_room()
            sids, sizes, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                sids.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "row", "sid", "n", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text", "row").mapInArrow(run, "doc_id long, row binary, sid binary, n long, sig binary")


def coordinate(sig: F.Column, i: F.Column | int) -> F.Column:
    return F.substring(sig, (F.lit(i) if isinstance(i, int) else i) * 4 + 1, F.lit(4))


def forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges (child, root) of a spanning forest."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in range(n) if top(x) != x]


def bucket_links(buckets: DataFrame, floor: float) -> DataFrame:
    """Candidate links (a, b) of bounded buckets (members: array of node and sig), as spanning forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                ids = [m["node"] for m in members]
                sigs = np.frombuffer(b"".join(m["sig"] for m in members), np.uint32).reshape(len(members), COORDINATES)
                near = (sigs[:, None, :] == sigs[None]).mean(2) >= floor
                for x, y in forest(len(members), zip(*(i.tolist() for i in np.nonzero(np.triu(near, 1))), strict=True)):
                    a.append(ids[x])
                    b.append(ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def candidates(spark: SparkSession, nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Candidate links (a, b) between nodes (node, sig): every pair at the threshold is connected, at the recall."""
    floor = threshold - 5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    share, paths, drop = 1 / threshold, [], []
    sampled = [(r, i) for r in range(runs_for(recall)) for i in chosen(r, share)]
    picks = F.array(*[F.xxhash64(F.lit(i), coordinate(F.col("sig"), i)) for i in sorted({i for _, i in sampled})])
    rows = nodes.select("node", F.posexplode(picks).alias("at", "path"))
    links = None
    for depth in range(1, DEPTH + 1):
        at = [F.min("at").alias("at")] if depth == 1 else []
        marks = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("mark"), *at)
        marks, path = stored(spark, marks.where("n > 1"), f"paths{depth}")
        drop.append(path)
        # buckets with the same members need one comparison
        small = marks.where(F.col("n") <= BUCKET).groupBy("n", "low", "mark").agg(F.min("path").alias("path")).select("path")
        members = rows.select("path", "node").join(small, "path").join(nodes.select("node", "sig"), "node")
        full = members.groupBy("path").agg(F.collect_list(F.struct("node", "sig")).alias("members")).select("members")
        found, path = stored(spark, bucket_links(full, floor).distinct(), f"links{depth}")
        paths.append(path)
        links = found if links is None else links.union(found)
        large = marks.where(F.col("n") > BUCKET)
        if not large.limit(1).count():
            break
        if depth == DEPTH:
            links = links.union(rows.join(large.select("path", "low"), "path").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
            break
        if depth == 1:
            places = {i: p for p, i in enumerate(sorted({i for _, i in sampled}))}
            by_place: dict[int, list[int]] = {}
            for r, i in sampled:
                by_place.setdefault(places[i], []).append(r)
            runs = F.create_map(*[x for p, rs in by_place.items() for x in (F.lit(p), F.array(*map(F.lit, rs)))])
            deep = rows.select("path", "node").join(large.select("path", "at"), "path").select("node", F.explode(runs[F.col("at")]).alias("run"), "path")
            deep = deep.select("node", F.xxhash64("run", "path").alias("path"))
        else:
            deep = rows.join(large.select("path"), "path").select("node", "path")
        take = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.pmod(F.xxhash64("path", i), F.lit(1 << 20)) < int(share / COORDINATES * (1 << 20)))
        deep = deep.join(nodes.select("node", "sig"), "node").select("node", "sig", "path", F.explode(take).alias("i"))
        rows, path = stored(spark, deep.select("node", F.xxhash64("path", "i", coordinate(F.col("sig"), F.col("i"))).alias("path")).distinct(), f"rows{depth}")
        drop.append(path)
    links, path = stored(spark, links.distinct(), "candidates")
    discard(spark, *drop, *paths)
    return links


def bloom_places(doc_id: F.Column) -> F.Column:
    return F.array(*[F.pmod(F.xxhash64(doc_id, F.lit(s)), F.lit(BLOOM_BITS)) for s in range(3)])


def cell_links(members: DataFrame, threshold: float) -> DataFrame:
    """From members of cells to rows (sid, links, other): links counts documents of linked nodes, other is a forest's edge."""

    def compare(key: tuple, got: pa.Table) -> pa.Table:
        rows = {sid: (block, copies, shingle) for sid, block, copies, shingle in zip(*(got[c].to_pylist() for c in ("sid", "block", "copies", "shingles")), strict=True)}
        sids = sorted(rows)
        blocks = np.array([rows[s][0] for s in sids])
        copies = np.array([rows[s][1] for s in sids], np.float64)
        sets = [np.frombuffer(rows[s][2], np.uint64) for s in sids]
        sizes = np.array([len(s) for s in sets], np.float64)
        owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        ids, at = np.unique(np.concatenate(sets), return_inverse=True)
        # members of a shingle as a sum of random codes: columns with the same members are one, weighted
        codes = np.random.default_rng(11).integers(1, 1 << 63, len(sets), dtype=np.uint64)
        marks = np.zeros(len(ids), np.uint64)
        np.add.at(marks, at, codes[owner])
        kinds, first, kind, weight = np.unique(marks, return_index=True, return_inverse=True, return_counts=True)
        shared = np.zeros((len(sets), len(sets)))
        one = np.zeros(len(ids), bool)
        one[first] = True
        keep = one[at]
        rows_at, cols_at = owner[keep], kind[at[keep]]
        order = np.argsort(cols_at, kind="stable")
        rows_at, cols_at = rows_at[order], cols_at[order]
        for c in range(0, len(kinds), 4096):
            a, b = np.searchsorted(cols_at, [c, c + 4096])
            x = np.zeros((len(sets), min(4096, len(kinds) - c)), np.float32)
            x[rows_at[a:b], cols_at[a:b] - c] = 1
            shared += (x * weight[c : c + 4096].astype(np.float32)) @ x.T
        union = sizes[:, None] + sizes[None] - shared
        near = shared >= threshold * union - 1e-9
        np.fill_diagonal(near, False)
        i, j = key[1].as_py(), key[2].as_py()
        if i != j:
            near &= blocks[:, None] != blocks[None]
        counts = near @ copies
        out_sid, out_n, out_other = [], [], []
        for x, n in enumerate(counts.tolist()):
            if n:
                out_sid.append(sids[x])
                out_n.append(int(n))
                out_other.append(None)
        for x, y in forest(len(sids), zip(*(v.tolist() for v in np.nonzero(np.triu(near, 1))), strict=True)):
            out_sid.append(sids[x])
            out_n.append(0)
            out_other.append(sids[y])
        return pa.table({"sid": pa.array(out_sid, pa.binary()), "links": pa.array(out_n, pa.int64()), "other": pa.array(out_other, pa.binary())})

    return members.groupBy("comp", "i", "j").applyInArrow(compare, "sid binary, links long, other binary")


def join(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """Per row of docs: doc_id, class_id and n_links.

    n_links is the number of other documents whose sets have a Jaccard similarity of the threshold or more; class_id is the
    least doc_id of those connected by such links. Null texts and texts without words have no links and their own class.
    Repeated rows count as documents of equal text; a null doc_id is never a class_id but has one. Other columns are not
    carried.
    """
    rows = classes(spark, docs.select("doc_id", "text", F.lit(None).cast("binary").alias("row")), threshold, recall)
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(spark: SparkSession, docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs with exactly one row of each class, all columns: that of the least doc_id, null ids after others, then of the
    least digest of its text. Of rows with equal doc_id and text any one stays. Texts without words, which have no class,
    all stay.
    """
    rows, path = stored(spark, classes(spark, docs.select("doc_id", "text", row_key().alias("row")), threshold, recall).where("comp IS NOT NULL").select("doc_id", "row", "comp"), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.hex("row").alias("row"))
    first = rows.groupBy("comp").agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1").select("comp", F.unhex("best.row").alias("best"))
    copies, copies_path = stored(spark, rows.join(first, "comp").groupBy("row").agg(F.count("*").alias("n"), F.first(F.col("row") == F.col("best")).alias("stays")).where("n > 1 OR NOT stays"), "copies")
    key = "_" * (1 + max(map(len, docs.columns))) + "row"
    keyed = docs.withColumn(key, row_key())
    alone = join_checked(spark, keyed, copies.select(F.col("row").alias(key)), [key], "left_anti", most_broadcast)
    again = join_checked(spark, keyed, copies.where("stays").select(F.col("row").alias(key)), [key], "left_semi", most_broadcast).dropDuplicates([key])
    return alone.unionByName(again).select(*docs.columns)


def classes(spark: SparkSession, docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(doc_id, row, comp, class_id, n_links) of rows (doc_id, text, row); comp is null for a text without words."""
    small_batches(spark)
    rows, _ = stored(spark, embedded(docs), "sets")
    nodes = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # 60 bits of the id name a node among candidates; two sets that share it would only meet in one component
    short = F.conv(F.substring(F.hex("sid"), 1, 15), 16, 10).cast("long").alias("node")
    nodes, _ = stored(spark, nodes.select("*", short), "nodes")
    links = candidates(spark, nodes.select("node", "sig"), threshold, recall)
    groups, group_path = components(spark, links, "groups")
    inside = nodes.select("node", "sid", "low", "copies", "n").join(groups, "node").drop("node")
    inside, inside_path = stored(spark, inside, "inside")
    sizes = inside.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    inside = inside.join(sizes, "comp")
    places = inside.select(F.explode(bloom_places(F.col("low"))).alias("p")).select(F.expr("p div 62").alias("w"), F.expr("shiftleft(1L, cast(p % 62 as int))").alias("bit"))
    bloom = np.zeros(BLOOM_BITS // 62 + 1, np.int64)
    for r in places.groupBy("w").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bloom[r[0]] = r[1]
    shared = spark.sparkContext.broadcast(bloom)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            CODES.make_room()
            at = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, 3)
            maybe = np.flatnonzero(((table[at // 62] >> (at % 62)) & 1).all(1))
            texts = batch.column(0).take(pa.array(maybe)).to_pylist()
            for a, b in groups_by_bytes([len(t) if t else 0 for t in texts], 4 << 20):
                sets = [s for t in texts[a:b] if len(s := shingles(t))]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "shingles"])

    texts = docs.select("text", bloom_places(F.col("doc_id").cast("long")).alias("at"))
    sets = texts.mapInArrow(wanted, "sid binary, shingles binary")
    block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block")
    placed = inside.select("sid", "comp", "copies", "blocks", block)
    met = placed.join(sets, "sid").select("sid", "comp", "copies", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    met = met.select("sid", "comp", "copies", "block", "shingles", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    verified, _ = stored(spark, cell_links(met, threshold), "verified")
    counts = verified.where("links > 0").groupBy("sid").agg(F.sum("links").alias("links"))
    linked, _ = components(spark, verified.where("other IS NOT NULL").select(F.col("sid").alias("a"), F.col("other").alias("b")), "classes")
    known = nodes.select("sid", "low", "copies").join(counts, "sid", "left").join(linked.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    known, _ = stored(spark, known, "known")
    least = known.groupBy("comp").agg(F.min("low").alias("class_id"))
    known, _ = stored(spark, known.join(least, "comp").select("sid", "comp", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "result")
    discard(spark, group_path, inside_path)
    return rows.select("doc_id", "row", "sid").join(known, "sid", "left").select("doc_id", "row", "comp", "class_id", "n_links")


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' '), least(5, len(w))) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9
), reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT d.doc_id, min(r.other) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links
FROM d JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
