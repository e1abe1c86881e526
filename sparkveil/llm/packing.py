"""Order-preserving packing by dynamic programming.

The token stream of a partition, in the order of its rows, is cut into windows of at most ``width`` tokens. Cuts are allowed
at ends of documents, at ends of sentences (``sentence_penalty``), and, inside a sentence, after every ``STEP`` tokens
(``forced_penalty``). With dp[j] the least padding plus penalties up to boundary j, dp[j] + position[j] enters a
monotone queue whose head is the best start for the next window, so a block takes time in proportion to its
boundaries. A stream is optimised in blocks of ``block`` tokens; what a block's last window would hold goes into sequences
whose lengths are powers of two, which need no padding.
Nothing is shuffled, and a lost task gives the same windows again, as the same rows come in the same order.

Defined cases: null text is empty; an empty document is its end token alone; repeated rows are packed each for itself; ids
may be null; a very long text is cut like any other; other columns are not read; no row in, no window out. A stretch that spells an
added token of the vocabulary is that token.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textops import chunks, text_column
from .tokens import Encoder

END = 1
STEP = 32


def best_cuts(places: np.ndarray, penalties: np.ndarray, width: int) -> np.ndarray:
    """Ends of the windows. ``places`` rise from 0 by at most ``width`` each; penalties[j] is the price of a cut at places[j]."""
    at, price, n = places.tolist(), penalties.tolist(), len(places)
    came, queue, value = [0] * n, deque([0]), [0.0] * n  # value[i]: dp[i] + at[i]
    for j in range(1, n):
        here = at[j]
        while here - at[queue[0]] > width:
            queue.popleft()
        i = queue[0]
        came[j] = i
        v = value[i] + width + price[j]
        value[j] = v
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return np.array(cuts[::-1], np.int64)


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, sentence_penalty: float, forced_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    free = np.flatnonzero(sentence_ends[ids]) + 1
    places = np.union1d(free, doc_ends)
    gaps = np.diff(np.concatenate([[0], places]))
    more = (gaps - 1) // STEP
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    forced = np.repeat(places - gaps, more) + nth * STEP
    price = np.full(len(ids) + 1, 0.0, np.float32)
    price[free] = sentence_penalty
    price[forced] = forced_penalty
    price[doc_ends] = 0
    places = np.concatenate([[0], np.union1d(places, forced)])
    return places, price[places]


def _even_out(cuts: np.ndarray) -> np.ndarray:
    """The last window in parts whose lengths are powers of two."""
    at = int(cuts[-2]) if len(cuts) > 1 else 0
    parts = []
    for bit in range(int(cuts[-1] - at).bit_length() - 1, -1, -1):
        if (int(cuts[-1]) - at) >> bit & 1:
            parts.append(1 << bit)
    return np.concatenate([cuts[:-1], at + np.cumsum(parts)])


class _Block:
    def __init__(self) -> None:
        self.docs, self.ids, self.size = [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.ids.append(ids)
        self.size += len(ids)


def _packed(block: _Block, base: int, encoder: Encoder, width: int, penalties: tuple[float, float], with_ids: bool) -> tuple[list[tuple], int]:
    ids = np.concatenate(block.ids)
    sizes = np.array([n for _, n in block.docs], np.int64)
    doc_ends = np.cumsum(sizes)
    cuts = best_cuts(*boundaries(ids, doc_ends, encoder.ends_sentence(), *penalties), width)
    cuts = _even_out(cuts)
    edges = np.union1d(np.concatenate([[0], cuts]), doc_ends)
    begins, ends = edges[:-1], edges[1:]
    doc = np.searchsorted(doc_ends, begins, "right")
    window = np.searchsorted(cuts, begins, "right")
    window_start = np.concatenate([[0], cuts])[window]
    raw = ids.astype("<u4")
    rows = []
    for a, b, d, w, s in zip(begins.tolist(), ends.tolist(), doc.tolist(), window.tolist(), window_start.tolist(), strict=True):
        row = (block.docs[d][0], a - int(doc_ends[d] - sizes[d]), b - a, zlib.crc32(raw[a:b]), int(sizes[d]), base + w, a - s)
        rows.append((*row, ids[a:b]) if with_ids else row)
    return rows, len(cuts)


def _stream(batches: Iterator[pa.RecordBatch], tokenizer: tuple, width: int, block_size: int, penalties: tuple[float, float], with_ids: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, base = Encoder.shared(*tokenizer), TaskContext.get().partitionId() << 40
    block = _Block()

    def flush() -> pa.RecordBatch:
        nonlocal base, block
        rows, windows = _packed(block, base, encoder, width, penalties, with_ids)
        base += windows
        block = _Block()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for c in chunks(text_column(batch)):
            ids, at = encoder.encode(c)
            for i in range(c.n):
                block.add(doc_ids[c.first + i], np.append(ids[at[i] : at[i + 1]], np.int32(END)))
                if block.size >= block_size:
                    yield flush()
    if block.docs:
        yield flush()


def default_tokenizer() -> tuple:
    """The ranks' file, the pattern, and the added tokens of the same vocabulary's file for the tokenizers library."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple((x["content"], x["id"]) for x in added)


def pack(docs: DataFrame, width: int = 2048, block: int = 1 << 20, sentence_penalty: float = 2.0, forced_penalty: float = 16.0, tokenizer: tuple | None = None, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (``with_ids``) ids.

    Sequences are numbered by partition, then in order; a partition's pieces keep the order of ``docs``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(n, LongType()) for n in names)]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    schema, tokenizer = StructType(fields), tokenizer or default_tokenizer()
    arrow = to_arrow_schema(schema)
    return docs.select("doc_id", "text").mapInArrow(lambda b: _stream(b, tokenizer, width, block, (sentence_penalty, forced_penalty), with_ids, arrow), schema)


def op4_order_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
