"""Language identification by interpolated Kneser-Ney character models, one per language.

Models learn from a bounded sample of the labelled rows that are not held out: about ``sample_docs`` whole documents of
each language, chosen by hash (a documented parameter), and one document of each language at least. Each language's tables
are fitted in a task of its own; together they are sorted arrays with a column for each language. A text's language has
the lowest cross-entropy per symbol over all its letters, of equal ones the first by name; the score is calibrated on a
slice of the sample that the models don't learn from, and so is the cross-entropy over which a text is marked as rejected.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.byte_bpe import groups_by_bytes
from siteglass.llm.charlm import Tables, merged, score
from siteglass.llm.common import BoundedCache, small_batches

WORD = re.compile(r"[^\W\d_]+")
NO_LANGUAGE = "und"


def letters(text: str | None) -> list[str]:
    """Runs of letters of the text in lower case. Superscripts, fractions and other number signs are no letters."""
    out = []
    for w in WORD.findall(text.lower()) if text else ():
        out += (w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


def held_out() -> F.Column:
    """crc32 of doc_id as text leaves 2 modulo 4; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Identifier:
    def __init__(self, langs: list[str], tables: Tables | None, scale: float, reject: float):
        self.langs, self.tables, self.scale, self.reject = langs, tables, scale, reject
        self.cache = BoundedCache(300_000)

    def costs(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Cross-entropy per symbol under each language; None for a text without letters."""
        cut = [letters(t) for t in texts]
        if not self.langs:
            return [None] * len(texts)
        self.cache.make_room()
        fresh = list({w for ws in cut for w in ws if w not in self.cache})
        for a, b in groups_by_bytes([len(w) for w in fresh], 1 << 19):
            logs, sizes = score(self.tables, fresh[a:b])
            self.cache.keep(fresh[a:b], np.column_stack([logs, sizes]))
        out = []
        for ws in cut:
            if not ws:
                out.append(None)
                continue
            counts = Counter(ws)
            n = np.fromiter(counts.values(), np.float64, len(counts))
            total = n @ np.array([self.cache[w] for w in counts])
            out.append(-total[:-1] / total[-1])
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score from 0 to 1, whether it is rejected) of each text."""
        out = []
        for cost in self.costs(texts):
            if cost is None:
                out.append((NO_LANGUAGE, 0.0, True))
                continue
            best = int(cost.argmin())
            share = 1.0 / np.exp(-self.scale * (cost - cost[best])).sum()
            out.append((self.langs[best], float(share), bool(cost[best] > self.reject)))
        return out


def train(spark: SparkSession, docs: DataFrame, sample_docs: int = 800) -> Identifier:
    """An identifier from labelled rows that aren't held out; without such rows it knows no language.

    Rows without a text, a lang or a doc_id teach nothing, nor do texts without a letter.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    small_batches(spark)
    sizes = {r[0]: r[1:] for r in rows.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.count("*"), F.min("doc_id")).collect()}
    if not sizes:
        return Identifier([], None, 1.0, 0.0)
    by_lang = lambda of: F.create_map(*[x for lang, v in sizes.items() for x in (F.lit(lang), F.lit(of(*v)))])[F.col("lang")]
    part = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20))
    least = F.col("doc_id") == by_lang(lambda n, low: low)
    sample = rows.where(least | (part < by_lang(lambda n, low: min(1.0, sample_docs / n)) * (1 << 20)))
    sample = sample.withColumn("check", ~least & (F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(10)) == 0))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(letters(text))
            flat = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    counts = sample.where("NOT check").select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fitted(own: pa.Table) -> pa.Table:
        order = own.sort_by("word")
        tables = Tables.train(order["word"].to_pylist(), order["n"].to_numpy())
        return pa.table({"lang": order["lang"].slice(0, 1), "tables": pa.array([pickle.dumps(tables)], pa.binary())})

    got = {r[0]: pickle.loads(r[1]) for r in counts.groupBy("lang").applyInArrow(fitted, "lang string, tables binary").collect()}
    if not got:
        return Identifier([], None, 1.0, 0.0)
    langs = sorted(got)
    plain = Identifier(langs, merged([got[x] for x in langs]), 1.0, np.inf)
    shared = spark.sparkContext.broadcast(plain)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = shared.value.costs(batch.column(1).to_pylist())
            kept = [(lang, c) for lang, c in zip(batch.column(0).to_pylist(), costs, strict=True) if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in kept], pa.string()), pa.array([r[1].tolist() for r in kept], pa.list_(pa.float64()))], ["lang", "costs"])

    tested = sample.where("check").select("lang", "text").mapInArrow(check, "lang string, costs array<double>").toPandas()
    scale, reject = 8.0, float("inf")
    if len(tested):
        costs = np.array(tested["costs"].tolist())
        truth = np.array([langs.index(x) if x in langs else -1 for x in tested["lang"]])
        costs, truth = costs[truth >= 0], truth[truth >= 0]
        if len(truth):
            gaps = costs - costs.min(1, keepdims=True)

            def loss(s: float) -> float:
                z = -s * gaps
                return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]))

            scale = min((0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=loss)
            reject = float(np.quantile(costs.min(1), 0.999)) + 0.25
    shared.unpersist()
    return Identifier(langs, plain.tables, scale, reject)


def identify(spark: SparkSession, docs: DataFrame, model: Identifier | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected.

    Texts that are null or have no letter are `und` with score 0, and so is every text if no language was learned. Only
    the text is used. Repeated rows each give a row; other columns are not carried.
    """
    shared = spark.sparkContext.broadcast(model or train(spark, docs))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            sizes = [len(x) if x else 0 for x in batch.column(2).to_pylist()]
            for a, b in groups_by_bytes(sizes, 4 << 20):
                found += shared.value.predict(batch.column(2).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
