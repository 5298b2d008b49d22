"""Token counts of whole texts.

Texts are cut at safe boundaries into pieces, each distinct piece of a byte-balanced
batch is encoded once by the tokenizer library, and only lengths leave the task.

A byte-level BPE pre-tokenizer never joins a non-space character to white space after
it, and looks ahead only; so the place before a run of white space that follows a
non-space character is always a token boundary, and the parts on both sides can be
encoded apart. Special strings hold no white space and stay whole in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import per_row, sized, slices

#: A non-space character, then white space: the cut comes between them. The first class
#: leaves out every character that any regular expression engine counts as a space.
BOUNDARY = r"([^\s\x0B\x1C-\x1F\x{85}\p{Z}])([ \t\n\r])"
#: Marks cuts; texts that hold it are encoded whole.
MARK = "\x01"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


#: Lengths of short pieces that a Python worker has met, by tokenizer file.
_SEEN: dict[str, dict[str, int]] = {}
SEEN_PIECES, SEEN_LENGTH = 400_000, 32


def _encoded(tokenizer, pieces: list[str], at_once: int = 20_000) -> Iterator[int]:
    for start in range(0, len(pieces), at_once):
        yield from map(len, tokenizer.encode_batch_fast(pieces[start : start + at_once], add_special_tokens=False))


def _lengths(path: str, pieces: list[str]) -> np.ndarray:
    """Token counts of distinct pieces; the library encodes those that are new to this worker."""
    seen = _SEEN.setdefault(path, {})
    counts = np.fromiter((seen.get(x, -1) for x in pieces), np.int64, len(pieces))
    new = np.flatnonzero(counts < 0)
    fresh = [pieces[i] for i in new]
    counts[new] = np.fromiter(_encoded(_tokenizer(path), fresh), np.int64, len(fresh))
    if len(seen) + len(fresh) > SEEN_PIECES:
        seen.clear()
    seen.update((x, n) for x, n in zip(fresh[:SEEN_PIECES], counts[new].tolist(), strict=False) if len(x) <= SEEN_LENGTH)
    return counts


def count_tokens(texts: pa.Array, path: str) -> np.ndarray:
    """Token counts of one batch of texts."""
    texts = pc.fill_null(texts, "")
    marked = pc.match_substring(texts, MARK)
    cut = pc.if_else(marked, texts, pc.replace_substring_regex(texts, BOUNDARY, rf"\1{MARK}\2"))
    whole = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
    parts = pc.split_pattern(cut, MARK)
    offsets = np.asarray(parts.offsets.to_numpy(), dtype=np.int64)
    pieces = parts.flatten().dictionary_encode()
    counts = _lengths(path, pieces.dictionary.to_pylist())
    out = per_row(counts[pieces.indices.to_numpy(zero_copy_only=False)], offsets - offsets[0])
    for i in whole:
        out[i] = len(_tokenizer(path).encode_batch_fast([texts[int(i)].as_py()], add_special_tokens=False)[0])
    return out


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024, batch_bytes: int = 8 << 20) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit) to each row of ``docs``.

    ``path`` names a byte-level BPE vocabulary in the tokenizers library's JSON form, which
    every executor can open. Map-only: rows are not shuffled, and batches are
    re-cut to ``batch_bytes`` of text. Null and empty texts have no tokens. Columns of
    ``docs`` with the three added names are replaced; all others pass through.
    """
    added = ["n_bytes", "n_tokens", "over_limit"]
    kept = docs.drop(*added)
    schema = T.StructType(list(kept.schema.fields) + [T.StructField("n_tokens", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, batch_bytes):
            counts = count_tokens(batch.column(text), path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return kept.mapInArrow(counted, schema).withColumn("n_bytes", sized(text)).withColumn("over_limit", F.col("n_tokens") > limit)
