"""Archives round trip; splits of any size own each record once."""

import io
import random

import pytest

from lodestar.llm import warc
from lodestar.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import assert_equals_oracle


def test_oracle(spark):
    assert_equals_oracle(spark, QUERIES["op2_warc"], ORACLES["op2_warc"])


def test_splits_own_each_record_once():
    rng = random.Random(3)
    bodies = [bytes(rng.getrandbits(8) for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    bodies[7] = warc.MAGIC * 400 + b"\x00" * 50
    data, at = b"", []
    for i, body in enumerate(bodies):
        at.append(len(data))
        data += warc.record(i, f"http://a/{i}", body, warc.base32_sha1(body), 0 if i % 5 == 4 else None, i % 5 == 4)
    for split in (1, 7, 512, 4096, len(data)):
        if split < 7:
            starts = [0, at[5], at[5] - 1, at[5] + 1]
            spans = list(zip(starts, [s + 1 for s in starts], strict=True))
        else:
            spans = [(s, s + split) for s in range(0, len(data), split)]
        found = [r for a, b in spans for r in warc.records_in(io.BytesIO(data), a, b)]
        if split < 7:
            assert [r["page_id"] for r in found] == [0, 5]
            continue
        assert [r["at"] for r in found] == at
        assert [r["payload"] for r in found] == [None if i % 5 == 4 else b for i, b in enumerate(bodies)]
        assert [r["payload_bytes"] for r in found] == [len(b) for b in bodies]


def test_damage_is_reported():
    one, two = (warc.record(i, None, b"x" * 500, "D", None, False) for i in (1, 2))
    broken = bytearray(one)
    broken[-6] ^= 255
    found = list(warc.records_in(io.BytesIO(bytes(broken) + two + two[:-20]), 0, 10_000))
    assert [("error" in r, r.get("page_id")) for r in found] == [(True, None), (False, 2), (True, None)]


def test_odd_rows(spark):
    rows = [(1, "http://a/\r\nX: y é", "same"), (2, None, "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "only"), (5, "u", "long " * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.read_warc(warc.write_warc(pages), split_bytes=1000).collect()
    seen = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    want = [(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "revisit", 2, 4), (None, "response", None, 4), (5, "response", None, 1_500_000)]
    assert seen == sorted(want, key=str)
    assert {r.payload.decode() for r in got if r.payload is not None} == {"same", "", "only", "long " * 300_000}
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%0D%0AX:%20y%20%C3%A9"}
    assert all(r.error is None for r in got)
    empty = warc.write_warc(pages.limit(0))
    assert empty.count() == 0 and warc.read_warc(empty).count() == 0


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_split_sizes_agree(spark, split):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = warc.read_warc(warc.write_warc(pages), split_bytes=split)
    assert {(r.page_id, (r.payload or b"").decode()) for r in got.collect() if r.record_type == "response"} <= {(r.page_id, r.html) for r in pages.collect()}
    assert got.count() == pages.count()
