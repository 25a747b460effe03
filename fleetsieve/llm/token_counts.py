"""Token counts of whole texts by overlap resynchronisation.

A text longer than `chunk` characters is encoded in chunks that start at a proven boundary. Around
the end of a chunk a second, overlapping stretch is encoded as well, and the chunk is spliced at the
last boundary that both encodings have. A boundary is a single space between two characters that
aren't white space: the splitting pattern of byte-level BPE can't match across it and looks no
further ahead, and merges never leave a match, so what follows is encoded alike from there on. If
the two have none in common the overlap doubles, at last to the rest of the text.

Stretches between boundaries repeat a lot; their counts are kept in a bounded memo per worker, and
only new ones are given to the tokenizer, in batches.
"""
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetsieve.llm.common import tokenizer_file

BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64  # longer stretches hardly repeat


@lru_cache(maxsize=2)
def _tokenizer(name):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file(name)), {}, []


class Encoder:
    """Counts of stretches, by the library, with a memo."""

    def __init__(self, name):
        self.tokenizer, self.memo, self.passing = _tokenizer(name)

    def stretches(self, text: str) -> list[str]:
        first, *rest = BOUNDARY.split(text)
        return [first, *[" " + x for x in rest]]

    def learn(self, stretches) -> dict:
        """Counts of all given stretches, until the next call; long ones leave the memo then."""
        memo = self.memo
        while self.passing:
            memo.pop(self.passing.pop(), None)
        new = [x for x in set(stretches) if x not in memo]
        if len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = list(set(stretches))
        memo.update(self._counts(new))
        self.passing.extend(x for x in new if len(x) > MEMO_CHARS)
        return memo

    def _counts(self, stretches: list[str]) -> dict:
        """By the tokenizer. What begins and ends at a boundary is encoded in one text, and tokens are told
        apart by offset; only the first and last stretches of texts need an encoding of their own."""
        inner = [x for x in stretches if x[:1] == " " and not x[1:2].isspace() and len(x) > 1 and not x[-1].isspace()]
        other = list(set(stretches).difference(inner))
        encodings = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        found = {x: len(e.ids) for x, e in zip(other, encodings)}
        for at in range(0, len(inner), 4096):
            some = inner[at:at + 4096]
            starts = np.cumsum([0, *map(len, some)])
            tokens = np.array([a for a, _ in self.tokenizer.encode("".join(some), add_special_tokens=False).offsets])
            n = np.bincount(np.searchsorted(starts, tokens, "right") - 1, minlength=len(some))
            found.update(zip(some, n.tolist()))
        return found

    def count(self, stretches: list[str]) -> int:
        counts = self.learn(stretches)
        return sum(map(counts.__getitem__, stretches))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Offsets of the boundaries of a chunk, its end included, and the tokens before each."""
        parts = self.stretches(text)
        counts = self.learn(parts)
        offsets, before, at, n = [], [], 0, 0
        for x in parts:
            offsets.append(at)
            before.append(n)
            at += len(x)
            n += counts[x]
        return [*offsets, at], [*before, n]


def count_tokens(text: str, encoder: Encoder, chunk=1 << 16, overlap=1 << 10) -> int:
    if len(text) <= chunk:
        return encoder.count(encoder.stretches(text))
    total, start, size, width = 0, 0, chunk, overlap
    while True:
        end = min(len(text), start + size)
        offsets, before = encoder.encode(text[start:end])
        if end == len(text):
            return total + before[-1]
        low = max(start, end - width)
        again = {low + x for x in encoder.encode(text[low:min(len(text), end + width)])[0][1:]}
        at = next((i for i in range(len(offsets) - 2, 0, -1) if offsets[i] + start > low and offsets[i] + start in again), None)
        if at is not None:
            total, start, size, width = total + before[at], start + offsets[at], chunk, overlap
        elif low > start:
            width *= 2
        else:
            size *= 2


def count_all(texts: list[str], encoder: Encoder, chunk=1 << 16, overlap=1 << 10) -> list[int]:
    """Counts of some texts; the stretches of all short ones are learnt at once."""
    short = [encoder.stretches(x) if len(x) <= chunk else None for x in texts]
    known = encoder.learn({y for x in short if x for y in x})
    found = [None if x is None else sum(map(known.__getitem__, x)) for x in short]  # before the memo changes
    return [count_tokens(x, encoder, chunk, overlap) if n is None else n for x, n in zip(texts, found)]


def token_counts(docs: DataFrame, doc_id="doc_id", text="text", tokenizer="byte_bpe_50k.json", limit=512,
                 chunk=1 << 16, overlap=1 << 10) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. A null text counts as empty: 0 bytes, 0
    tokens. Repeated rows give repeated results; an empty table gives an empty result."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            texts, counts = batch.column(1), []
            for at in range(0, len(texts), 64):
                counts += count_all(texts.slice(at, 64).to_pylist(), encoder, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(2)], names=["doc_id", "n_tokens", "n_bytes"])

    counted = source.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_bytes bigint")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
