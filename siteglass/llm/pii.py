"""Personal data: base patterns, and bootstrapped contextual extraction.

Base entities (e-mail, IP, card, phone) are the seeds. Every identifier-like token has context patterns: the two and the
three words before it, the two after it, and a label such as `phone:`. Such a token has four characters or more and a
digit, an @ or an inner dot; tokens of digits and number punctuation that only a blank parts are one. Spark scores the
graph of patterns and instances in rounds until the accepted patterns stay the same: a pattern's confidence is the mean
score of its distinct instances, smoothed; an instance that no base pattern knows has the chance that one of its accepted
patterns is right. Tokens behind patterns that end up accepted, with enough distinct seeds, are found as further entities
of the pattern's kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm.common import discard, join_checked, row_key, small_batches, stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]|(?<=\w)\.(?=\w)")
SPACE = re.compile(r"\s")
NUMBERS = re.compile(r"[()+.0-9-]*[0-9][()+.0-9-]*")
EDGE = ".,;:!?()[]{}<>\"'`|*"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base entities, by start and kind; offsets are code points. Null has none."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of identifier-like tokens, without edge punctuation; a run of number tokens is one, as in (774) 555-2163."""
    last, hint = 0, HINT.search(text)
    while hint:
        p, start = hint.start(), last
        for c in " \n\t\r":
            start = max(start, text.rfind(c, last, p) + 1)
        m = SPACE.search(text, p)
        end = m.start() if m else len(text)
        if NUMBERS.fullmatch(text, start, end):
            while end < len(text) - 1 and text[end] == " " and (more := NUMBERS.match(text, end + 1)) and (more.end() == len(text) or text[more.end()].isspace() or text[more.end()] in EDGE):
                end = more.end()
        a, b = start, end
        while a < b and text[a] in EDGE and not (text[a] == "(" and ")" in text[a:b]):
            a += 1
        while b > a and text[b - 1] in EDGE and not (text[b - 1] == ")" and "(" in text[a:b]):
            b -= 1
        if b - a >= 4:
            yield a, b
        last = end
        hint = HINT.search(text, end)


def patterns(text: str, start: int, end: int, reach: int = 80) -> list[str]:
    before = text[max(0, start - reach) : start].lower().split()
    after = text[end : end + reach].lower().split()
    out = [f"L{n}:{' '.join(before[-n:])}" for n in (2, 3) if len(before) > n]
    if len(after) > 2:
        out.append(f"R2:{' '.join(after[:2])}")
    if before and before[-1][-1] in ":=#":
        out.append(f"K:{before[-1]}")
    return out


def observe(docs: DataFrame) -> DataFrame:
    """Per row: row (a key of doc_id and text), doc_id, base spans, and the contexts of seeds and of other tokens."""

    def digest(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans, seen = base_spans(text), []
                if text:
                    for a, k, b in spans:
                        seen.append({"start": a, "kind": k, "end": b, "instance": digest(text[a:b]), "patterns": patterns(text, a, b)})
                    covered = sorted((a, b) for a, _, b in spans)
                    i = 0
                    for a, b in tokens(text):
                        while i < len(covered) and covered[i][1] <= a:
                            i += 1
                        if i < len(covered) and covered[i][0] < b:
                            continue
                        seen.append({"start": a, "kind": None, "end": b, "instance": digest(text[a:b]), "patterns": patterns(text, a, b)})
                key = hashlib.md5(f"{doc_id}|{'' if text is None else text}".encode()).digest()
                rows.append((key, doc_id, [{"start": a, "kind": k, "end": b} for a, k, b in spans], seen))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["row", "doc_id", "base", "seen"])

    span = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
    types = [pa.binary(), pa.int64(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]))]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "row binary, doc_id long, base array<struct<start:int,kind:int,end:int>>, seen array<struct<start:int,kind:int,end:int,instance:long,patterns:array<string>>>")


def accepted_patterns(spark: SparkSession, seen: DataFrame, most_rounds: int = 10, least_seeds: int = 5, least_confidence: float = 0.8) -> tuple[DataFrame, str]:
    """(pattern, kind, confidence) of the patterns that the graph of patterns and instances supports; and their table's path.

    Rounds end when the same patterns are accepted for the same kinds twice, or after ``most_rounds``.
    """
    edges = seen.select(F.explode("s.patterns").alias("pattern"), "s.instance", "s.kind").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    edges, edge_path = stored(spark, edges, "edges")
    scores = edges.where("kind IS NOT NULL").groupBy("instance").agg(F.lit(1.0).alias("score"), F.max("kind").alias("as_kind"))
    good = path = mark = None
    for _ in range(most_rounds):
        scored = edges.join(scores, "instance", "left")
        by_kind = [F.sum(F.when(F.col("as_kind") == k, F.col("score")).otherwise(0.0)) for k in range(len(KINDS))]
        votes = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(k).alias("k")) for k, v in enumerate(by_kind)]))
        found = scored.groupBy("pattern").agg(F.count("*").alias("n"), F.count("kind").alias("seeds"), votes.alias("best"))
        found = found.select("pattern", F.col("best.k").alias("kind"), (F.col("best.v") / (F.col("n") + 0.5)).alias("confidence"), "seeds")
        old = path
        good, path = stored(spark, found.where(f"seeds >= {least_seeds} AND confidence >= {least_confidence}").drop("seeds"), "patterns")
        if old:
            discard(spark, old)
        was, mark = mark, tuple(good.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern", "kind"))).first())
        if mark == was:
            break
        new = edges.where("kind IS NULL").drop("kind").join(good, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"), F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("as_kind"))
        scores = edges.where("kind IS NOT NULL").groupBy("instance").agg(F.lit(1.0).alias("score"), F.max("kind").alias("as_kind")).unionByName(new)
    discard(spark, edge_path)
    return good, path


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, base and spans, both arrays of (start, kind, end) by start and kind, and row, a key of
    doc_id and text. Null and empty texts have none; repeated rows each give a row; other columns are not carried."""
    small_batches(spark)
    rows, _ = stored(spark, observe(docs), "observed")
    seen = rows.select("row", F.explode("seen").alias("s"))
    good, _ = accepted_patterns(spark, seen)
    more = seen.where("s.kind IS NULL").select("row", "s.start", "s.end", F.explode("s.patterns").alias("pattern")).join(good, "pattern")
    more = more.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    more = more.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.drop("seen").join(more, "row", "left").select("doc_id", "base", spans.alias("spans"), "row")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of op2."""
    name = F.array(*map(F.lit, KINDS))
    joined = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return find(spark, docs).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind, such as <EMAIL>; all columns stay, n_chars (if there) follows.

    Spans that the method adds go to the texts by a join of the rows that have them, which is broadcast while these are
    few; base spans are found again in the text, so that no text moves for them. Null texts stay null.
    """
    more = find(spark, docs).where(F.size("spans") > F.size("base")).select("row", F.col("spans").alias("found")).dropDuplicates(["row"])
    kinds = [f"<{k.upper()}>" for k in KINDS]

    def mask(found_too: bool, at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                extra = batch.column(batch.num_columns - 1).to_pylist() if found_too else [None] * batch.num_rows
                out = []
                for text, more_spans in zip(batch.column(at).to_pylist(), extra, strict=True):
                    spans = [(s["start"], s["kind"], s["end"]) for s in more_spans] if more_spans else base_spans(text)
                    parts, last = [], 0
                    for a, k, b in spans:
                        if a >= last:
                            parts += [text[last:a], kinds[k]]
                        last = max(last, b)
                    out.append("".join([*parts, text[last:]]) if spans else text)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
                yield batch.select(range(batch.num_columns - 1)) if found_too else batch

        return run

    more, _ = stored(spark, more, "found")
    out = docs
    if more.limit(1).count():
        taken = "_" * (1 + max(map(len, docs.columns)))
        row, found = f"{taken}row", f"{taken}found"
        keyed = join_checked(spark, docs.withColumn(row, row_key()), more.toDF(row, found), [row], "left", 200_000).drop(row)
        out = keyed.mapInArrow(mask(True, keyed.columns.index("text")), docs.schema)
    else:
        out = docs.mapInArrow(mask(False, docs.columns.index("text")), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
