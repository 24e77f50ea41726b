"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters, the blank between words among them, so that n-grams cross words and word order counts. All
trusted texts are counted: n-grams are summed by batch, by task and then by key.
Spark joins the counts of each order with the totals of their contexts and with the next lower order, and writes for each
n-gram two numbers in sorted key ranges: what it adds to a log probability over its suffix, and what it leaves, as a
context, to the next lower order. A log probability is then a sum over the n-grams of a text that the model has. A
scoring task joins the distinct n-grams of a batch with the key ranges in order, holding a bounded number of rows, so
that its memory does not grow with the model. A document is kept if its perplexity lies between two limits of its
language, a lower one for repetitive text and an upper one. They are chosen on all labelled documents. A counted text
is scored as if it had not been counted: what it alone adds to the counts of each order is taken off again, so that its
perplexity compares with those of texts that the model has never seen.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.byte_bpe import groups_by_bytes
from siteglass.llm.charlm import BITS, ORDER, SYMBOLS, Grams, discount_of, discounts, look_up, placed, units
from siteglass.llm.common import discard, join_checked, open_path, small_batches, stored

SHARD_ROWS = 500_000
PART = 2 << 20  # code points whose n-grams are told apart at once
LEFT_OUT_PART = PART // 4  # the same for texts that are left out of the counts, which takes more memory by code point
SCORES, COUNTS = ("delta", "left"), ("c", "total", "off")
BINS = 4096  # of perplexity, for each factor e
MOST_HELD = 3_000_000  # n-grams that a counting task holds


def gram_counts(docs: DataFrame) -> DataFrame:
    """(key, c): counts of the n-grams of full order, over all texts. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            found, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return found, np.bincount(inverse, weights=np.concatenate([c for _, c in held]), minlength=len(found)).astype(np.int64)

        for batch in batches:
            parts = [u for text in batch.column(0).to_pylist() for u in units(text.split())]
            for a, b in groups_by_bytes([len(u) for u in parts], PART):
                raw, scored, _ = placed(parts[a:b])
                grams = Grams(raw, np.flatnonzero(scored))
                for _ in range(ORDER):
                    grams.longer()
                held.append((grams.keys, np.bincount(grams.number, minlength=len(grams.keys))))
                if sum(len(k) for k, _ in held) > MOST_HELD:
                    held[:] = [summed()]
                    if len(held[0][0]) > MOST_HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["key", "c"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["key", "c"])

    counts = docs.where("text IS NOT NULL").select("text").mapInArrow(run, "key long, c long")
    return counts.groupBy("key").agg(F.sum("c").alias("c"))


class Shards:
    """Key ranges of the model's n-grams by order, of which a bounded number of rows is held at a time.

    A row has its (delta, left), its count c, and the sum of counts (total) and of discounts (off) of the next order's
    n-grams whose context it is. ``root`` is (total, off) of the empty context, ``off`` the discounts of each order.
    """

    def __init__(self, base: float, root: tuple[float, float], off: list[list[float]], ranges: list[tuple[int, int, int, str]], most_rows: int = 8 * SHARD_ROWS):
        self.base, self.root, self.off, self.ranges, self.most, self.held = base, root, off, ranges, most_rows, OrderedDict()

    def load(self, uri: str, k: int, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        own = uri, k, columns
        if own not in self.held:
            fs, path = open_path(uri)
            got = pq.read_table(path, columns=["key", *columns], filters=[("k", "=", k)], filesystem=fs)
            self.held[own] = got["key"].to_numpy(), np.column_stack([got[c].to_numpy() for c in columns])
            while len(self.held) > 1 and sum(len(x) for x, _ in self.held.values()) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(own)
        return self.held[own]

    def find(self, k: int, wanted: np.ndarray, columns: tuple[str, ...] = SCORES) -> tuple[np.ndarray, np.ndarray]:
        """The columns of sorted keys, 0 where the model has none, and whether it has one."""
        out, there = np.zeros((len(wanted), len(columns))), np.zeros(len(wanted), bool)
        for own, low, high, uri in self.ranges:
            if own == k and (b := np.searchsorted(wanted, high, "right")) > (a := np.searchsorted(wanted, low)):
                known, values = self.load(uri, k, columns)
                place = np.minimum(np.searchsorted(known, wanted[a:b]), len(known) - 1)
                hit = known[place] == wanted[a:b]
                out[a:b][hit] = values[place[hit]]
                there[a:b] = hit
        return out, there

    def score(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of the scored symbols of each unit, and their number."""
        raw, scored, unit = placed(parts)
        total = np.where(scored, self.base, 0.0)
        before = np.append(scored[1:], False)  # what is left by a context is for the next symbol
        edge = scored != before
        grams = Grams(raw, np.flatnonzero(scored | before))
        for k in range(1, ORDER + 1):
            if k == ORDER:
                grams.only(scored[grams.at])
            grams.longer()
            values, there = self.find(k, grams.keys)
            total[grams.at] += values.sum(1)[grams.number]
            ends = np.flatnonzero(edge[grams.at])
            place, found = grams.at[ends], values[grams.number[ends]]
            total[place] -= np.where(scored[place], found[:, 1], found[:, 0])
            grams.only(there[grams.number], there)  # a longer n-gram can only be known where this one is
        return np.bincount(unit, weights=total, minlength=len(parts)), np.bincount(unit, weights=scored, minlength=len(parts))

    def score_left_out(self, parts: list[str], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As score, for all units of counted texts (``text``: the text of each unit), each by the counts of all others.

        A text takes its own occurrences off the counts of full order. An n-gram of which none is left no longer counts for
        its suffix, and so on down the orders; totals and discounts of contexts follow. The discounts are those of all texts.
        """
        raw, scored, unit = placed(parts)
        at = np.flatnonzero(scored)
        own = text[unit[at]].astype(np.int64)
        grams, orders, taken = Grams(raw, at), [], []
        for k in range(1, ORDER + 1):
            grams.longer()
            contexts, context = np.unique(grams.keys >> BITS, return_inverse=True)
            sums = self.find(k - 1, contexts, COUNTS)[0][:, 1:] if k > 1 else np.array([self.root])
            orders.append((grams.keys, grams.number, self.find(k, grams.keys, COUNTS)[0][:, 0], context, sums))
        less = own * len(grams.keys) + grams.number
        for k in range(ORDER, 0, -1):
            keys, _, c, context, sums = orders[k - 1]
            pairs, n = np.unique(less, return_counts=True)
            whose, gram = np.divmod(pairs, len(keys))
            left = c[gram] - n
            opened, inverse = np.unique(whose * len(sums) + context[gram], return_inverse=True)
            off = discount_of(c[gram], self.off[k - 1]) - discount_of(left, self.off[k - 1])
            taken.append((pairs, n, opened, np.bincount(inverse, weights=n), np.bincount(inverse, weights=off)))
            if k > 1:
                shorter, gone = orders[k - 2][0], left <= 0
                suffix = np.searchsorted(shorter, keys & ((1 << (BITS * (k - 1))) - 1))
                less = whose[gone] * len(shorter) + suffix[gram[gone]]
        p = np.full(len(at), 1 / SYMBOLS)
        for (keys, number, c, context, sums), (pairs, n, opened, fewer, off), d in zip(orders, reversed(taken), self.off, strict=True):
            left = c[number] - look_up(pairs, n, own * len(keys) + number, 0)
            here = context[number]
            total = sums[here, 0] - look_up(opened, fewer, own * len(sums) + here, 0)
            weight = sums[here, 1] - look_up(opened, off, own * len(sums) + here, 0)
            p = np.where(total > 0, (left - discount_of(left, d) + weight * p) / np.maximum(total, 1), p)
        return np.bincount(unit[at], weights=np.log(p), minlength=len(parts)), np.bincount(unit, weights=scored, minlength=len(parts))


def build(spark: SparkSession, trusted: DataFrame) -> Shards:
    """The model of the trusted texts in sorted shards of (k, key, delta, left, c, total, off)."""
    counts, paths = {}, []
    for k in range(ORDER, 0, -1):
        types = gram_counts(trusted) if k == ORDER else counts[k + 1].select(F.col("key").bitwiseAND((1 << (BITS * k)) - 1).alias("key")).groupBy("key").agg(F.count("*").alias("c"))
        counts[k], path = stored(spark, types, f"counts{k}")
        paths.append(path)
    lower, parts, base, root, offs = None, [], 0.0, (0.0, 0.0), []
    for k in range(1, ORDER + 1):
        d = discounts(list(counts[k].agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()))
        offs.append(d)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[k].select("key", F.shiftright("key", BITS).alias("ctx"), F.col("key").bitwiseAND((1 << (BITS * (k - 1))) - 1).alias("suffix"), "c", off.alias("off"))
        totals, path = stored(spark, rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("off").alias("offs"), F.log(F.sum("off") / F.sum("c")).alias("left")), f"totals{k}")
        paths.append(path)
        rows = rows.join(totals, "ctx")
        if k == 1:
            rows = rows.withColumn("low", F.lit(-float(np.log(SYMBOLS))))
            first = totals.first() or {"left": 0.0, "total": 0, "offs": 0.0}
            base, root = -float(np.log(SYMBOLS)) + first["left"], (float(first["total"]), first["offs"])
        else:
            # the blanks that open a text are a context without being an n-gram
            contexts = totals.select(F.col("ctx").alias("key"), "left", F.col("total").cast("double").alias("total"), F.col("offs").alias("off"))
            parts[-1] = parts[-1].join(contexts, "key", "full").withColumns({"k": F.lit(k - 1), "delta": F.coalesce("delta", F.lit(0.0))})
            rows = rows.join(lower.select(F.col("key").alias("suffix"), F.col("log").alias("low")), "suffix")
        log = F.log((F.col("c") - F.col("off")) / F.col("total") + F.exp(F.col("left") + F.col("low")))
        lower, path = stored(spark, rows.select("key", F.col("c").cast("double").alias("c"), log.alias("log"), (log - F.col("left") - F.col("low")).alias("delta")), f"order{k}")
        paths.append(path)
        parts.append(lower.select(F.lit(k).alias("k"), "key", "delta", "c"))
    parts[-1] = parts[-1].withColumns(dict.fromkeys(("left", "total", "off"), F.lit(0.0)))
    model = parts[0].select("k", "key", *SCORES, *COUNTS)
    for part in parts[1:]:
        model = model.unionByName(part.select("k", "key", *SCORES, *COUNTS))
    whole, path = stored(spark, model.na.fill(0.0, ["left", *COUNTS]).withColumns({c: F.col(c).cast("float") for c in SCORES}), "model")
    paths.append(path)
    n = max(1, -(-whole.count() // SHARD_ROWS))
    shards, _ = stored(spark, whole.repartitionByRange(n, "k", "key").sortWithinPartitions("k", "key"), "shards")
    ranges = shards.groupBy("k", F.input_file_name().alias("uri")).agg(F.min("key"), F.max("key")).collect()
    discard(spark, *paths)
    return Shards(base, root, offs, sorted((r[0], r[2], r[3], r[1]) for r in ranges))


def perplexities(docs: DataFrame, model: Shards) -> DataFrame:
    """Per row: doc_id, lang, n_words, perplexity per symbol (null for a text without words).

    Where docs has a column ``counted`` and it is true, the row's text is one of the model's and is left out of its counts.
    """
    counted = F.coalesce("counted", F.lit(False)) if "counted" in docs.columns else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [text.split() if text else [] for text in batch.column(2).to_pylist()]
            units_of, known = [units(cut) for cut in cuts], batch.column(3).to_pylist()
            sizes = [sum(map(len, u)) for u in units_of]
            total, n = np.zeros(len(cuts)), np.zeros(len(cuts))
            for left_out, most in ((False, PART), (True, LEFT_OUT_PART)):
                rows = [i for i, x in enumerate(known) if x == left_out and units_of[i]]
                own = np.array([i for i in rows for _ in units_of[i]], np.int64)
                parts = [u for i in rows for u in units_of[i]]
                if not left_out:
                    ranges = groups_by_bytes([len(u) for u in parts], most)
                else:  # all units of a text are scored together
                    ends = np.cumsum([0] + [len(units_of[i]) for i in rows])
                    ranges = [(ends[a], ends[b]) for a, b in groups_by_bytes([sizes[i] for i in rows], most)]
                for a, b in ranges:
                    log, scored = model.score_left_out(parts[a:b], own[a:b] - own[a]) if left_out else model.score(parts[a:b])
                    np.add.at(total, own[a:b], log)
                    np.add.at(n, own[a:b], scored)
            found = pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, cuts), pa.int64()), found], ["doc_id", "lang", "n_words", "perplexity"])

    return docs.select("doc_id", "lang", "text", counted.alias("counted")).mapInArrow(run, "doc_id long, lang string, n_words long, perplexity double")


def limits(good: np.ndarray, bad: np.ndarray, quantile: float, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> tuple[float, float]:
    """The lowest and highest perplexity kept, so that the share of good ones kept plus that of bad ones rejected is greatest.

    A limit lies midway, by ratio, between the values that it parts. Without bad ones only the quantile of the good ones
    is a limit. ``n_good`` and ``n_bad`` say how many documents have each value.
    """
    n_good = np.ones(len(good)) if n_good is None else n_good
    if not len(bad):
        order = np.argsort(good)
        share = np.cumsum(n_good[order]) / n_good.sum()
        return 0.0, float(good[order][min(np.searchsorted(share, quantile - 1e-9), len(good) - 1)])
    n_bad = np.ones(len(bad)) if n_bad is None else n_bad
    values, place = np.unique(np.concatenate([good, bad]), return_inverse=True)
    gain = np.bincount(place, weights=np.concatenate([n_good / n_good.sum(), -n_bad / n_bad.sum()]))
    upto = np.concatenate([[0.0], np.cumsum(gain)])
    last = int((upto[1:] - np.minimum.accumulate(upto[:-1])).argmax())
    first = int(upto[: last + 1].argmin())
    low = 0.0 if first == 0 else float(np.sqrt(values[first - 1] * values[first]))
    return low, float("inf") if last == len(values) - 1 else float(np.sqrt(values[last] * values[last + 1]))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, quantile: float = 0.998, least: int = 50, most_broadcast: int = 2_000_000) -> DataFrame:
    """Per row of docs: doc_id, lang, n_words, perplexity, lowest, threshold, keep (lowest <= perplexity <= threshold).

    Trusted texts are those labelled quality 1; conflicting labels of a document don't make it trusted. All of them are
    counted, and each is scored by the counts of all others. The limits of a language are chosen on all its labelled
    documents (see limits), of which tasks hold counts by fine steps of perplexity. A language with fewer than ``least`` of
    these, or none of one label, or a null one, has the limits of all. Texts without words have no perplexity and are not
    kept; without trusted text nothing is judged and every text with words is kept.
    """
    small_batches(spark)
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q IN (0, 1)")
    marked, _ = stored(spark, one, "labelled")
    counted = marked.where("q = 1").select("doc_id")
    model = build(spark, join_checked(spark, docs.select("doc_id", "text"), counted, ["doc_id"], "left_semi", most_broadcast))
    flagged = join_checked(spark, docs.select("doc_id", "lang", "text"), counted.withColumn("counted", F.lit(True)), ["doc_id"], "left", most_broadcast)
    scored, _ = stored(spark, perplexities(flagged, model), "scored")
    tested = join_checked(spark, scored.where("perplexity IS NOT NULL"), marked, ["doc_id"], "inner", most_broadcast)
    step = F.floor(F.log("perplexity") * BINS)
    tested, _ = stored(spark, tested.groupBy("lang", "q", step.alias("step")).agg(F.avg("perplexity").alias("perplexity"), F.count("*").alias("n")), "tested")

    def choose(rows):
        (good, n_good), (bad, n_bad) = ((x["perplexity"].to_numpy(), x["n"].to_numpy(np.float64)) for x in (rows[rows["q"] == q] for q in (1, 0)))
        low, high = limits(good, bad, quantile, n_good, n_bad) if len(good) else (0.0, float("inf"))
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "lowest": low, "threshold": high, "n": rows["n"].sum(), "both": bool(len(good) and len(bad))})

    shape = "lang string, lowest double, threshold double, n long, both boolean"
    by_lang = tested.where("lang IS NOT NULL").groupBy("lang").applyInPandas(choose, shape).where((F.col("n") >= least) & F.col("both")).drop("n", "both")
    every = tested.withColumn("lang", F.lit("")).groupBy("lang").applyInPandas(choose, shape).first() or {"lowest": None, "threshold": None}
    found = join_checked(spark, scored, by_lang, ["lang"], "left", 10_000)
    for name in ("lowest", "threshold"):
        found = found.withColumn(name, F.coalesce(name, F.lit(every[name]).cast("double")))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity").between(F.col("lowest"), F.col("threshold")), F.lit(True))
    return found.select("doc_id", "lang", "n_words", "perplexity", "lowest", "threshold", keep.alias("keep"))
