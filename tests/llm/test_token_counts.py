"""Token counts against the library on whole texts."""

import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.token_counts import count_tokens, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)

ALPHABET = st.sampled_from(list("ab 'sd9!.\n\r\t  　\x01\x00\x0b\x85\x1cé中😀") + ["<|endoftext|>", "  ", " \n", "'ll"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), max_size=8))
def test_equals_library(texts):
    want = [len(LIBRARY.encode(x, add_special_tokens=False)) for x in texts]
    assert count_tokens(pa.array(texts, pa.string()), PATH).tolist() == want


def test_rows(spark):
    texts = [None, "", "one two", "one two", "x" * 50_000 + " y" * 50_000, " \n "]
    docs = spark.createDataFrame([(i, t, "n", 5) for i, t in enumerate(texts)], "doc_id long, text string, other string, n_tokens int")
    rows = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    for i, t in enumerate(texts):
        n = len(LIBRARY.encode(t or "", add_special_tokens=False))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit, rows[i].other) == (n, len((t or "").encode()), n > 1024, "n")
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_whole_table(spark):
    from lodestar.llm.queries import QUERIES

    got = {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == {r.doc_id: len(LIBRARY.encode(r.text or "", add_special_tokens=False)) for r in docs}
