"""Token counts: pieces are counted once for each distinct pre-token and summed over frequencies.

No piece of the model holds a space mark after another character, so merges never cross from a
non-space into a space: a text's token count is the sum over its *pre-tokens*, each a run of
spaces and the characters up to the next space. Every partition keeps a dictionary of
pre-token -> number of pieces (cleared when it reaches ``dictionary_size`` entries, which costs
time and no correctness); a document's pre-token frequencies are joined to it and summed. Ids
are never made for a document and nothing is shuffled, so no key can be hot. A text that holds the
space mark U+2581 itself is one pre-token: the library takes the mark for a space in some places
only, so such a text is counted as a whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from genoloom.llm.common import documents, map_arrow

MARK = "\u2581"
_PRE = re.compile(r" +[^ ]*")


def splits_at_spaces(processor) -> bool:
    """Whether no piece has a space mark behind another character."""
    return not any("▁" in processor.id_to_piece(i).lstrip("▁") for i in range(processor.get_piece_size()))


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without the one leading space that the model's dummy prefix supplies again."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [x[1:] for x in _PRE.findall(" " + text)]
    return text.split(" ") if text else []


class PieceCounts:
    """Pre-token -> number of pieces, each counted once while it is kept."""

    def __init__(self, proto: bytes, size: int):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if not splits_at_spaces(self.processor):
            raise ValueError("the model has pieces across spaces; its pre-tokens can't be counted apart")
        self.size, self.known = size, {}
        self.space = len(self.processor.encode("a ")) - len(self.processor.encode("a"))

    def count(self, text: str) -> int:
        if MARK in text:
            return len(self.processor.encode(text, num_threads=1))
        frequency = Counter(pre_tokens(text))
        known = self.known
        new = [x for x in frequency if x not in known]
        if new:
            if len(known) + len(new) > self.size:
                known.clear()
                new = list(frequency)
            known.update(zip(new, map(len, self.processor.encode(new, num_threads=1)), strict=True))
            if "" in known:  # a space at the end of a text: the library gives an empty text no prefix
                known[""] = self.space
        return sum(map(int.__mul__, frequency.values(), map(known.__getitem__, frequency)))


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", dictionary_size: int = 1_000_000) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens). Null and repeated ids are carried through, row
    for row; other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    proto = spark.sparkContext.broadcast(model)  # the model file: its size does not depend on the data
    counts: list[PieceCounts] = []

    def count(batch: pa.RecordBatch):
        if not counts:
            counts.append(PieceCounts(proto.value, dictionary_size))
        texts = pc.fill_null(batch.column("__text"), "")
        tokens = np.fromiter((counts[0].count(x.as_py()) for x in texts), np.int64, len(texts))
        yield {
            "doc_id": batch.column("__id"),
            "n_bytes": pc.binary_length(texts).cast(pa.int64()),
            "n_tokens": tokens,
            "over_limit": tokens > limit,
        }

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(documents(docs, id_col, text_col), count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
