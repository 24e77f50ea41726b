"""Token counts by a tokenizer library: lengths only, from batches balanced by bytes.

Texts are cut where no token can reach across. For a sentencepiece model a blank between two characters that are not
blanks is such a place if no piece has the blank mark after another character, which is tested on the vocabulary; the
part after it is encoded with the model's own leading blank in place of the one cut. Distinct parts that a bounded cache
doesn't know are encoded in batches of about ``BATCH_BYTES``. Other models and vocabularies encode whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.llm.byte_bpe import groups_by_bytes
from siteglass.llm.common import BoundedCache, small_batches

BATCH_BYTES = 1 << 18
MARK = "▁"
CUT = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


class Counter:
    """Numbers of tokens as the library gives them, without special tokens, truncation or padding."""

    def __init__(self, path: str, most: int = 400_000):
        self.cache, self.cuts = BoundedCache(most), False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            plain = model.encode("a  b ", out_type=str)
            self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces) and "".join(plain) == f"{MARK}a{MARK}{MARK}b{MARK}"
            self.lengths = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.lengths = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]

    def parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return [text]
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return CUT.split(text)
        return text.split(" ")

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.parts(t) for t in texts]
        self.cache.make_room()
        known = self.cache
        fresh = list({p for parts in cut for p in parts if p not in known})
        for a, b in groups_by_bytes([len(p) for p in fresh], BATCH_BYTES):
            known.keep(fresh[a:b], self.lengths(fresh[a:b]))
        return [sum(map(known.__getitem__, parts)) for parts in cut]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null counts as empty: no bytes, no tokens. Repeated rows each give a row. Other columns are not carried.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
            found: list[int] = []
            for a, b in groups_by_bytes(sizes.to_pylist(), 4 << 20):
                found += count(batch.column(1).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes.cast(pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
