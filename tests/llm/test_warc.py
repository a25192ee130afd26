import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from evidentia.llm import groups, warc

SCHEMA = "record_id bigint, url string, payload binary"
ROWS = [(i, f"http://h/{i}", (f"<p>{i % 11}</p>" * (i % 5)).encode()) for i in range(200)] + [
    (1000, None, None), (1001, "u\r\nX: y", b""), (2**60, "http://far", b"\xff\x00 not text"), (None, "http://none", b"<p>null id</p>"), (1002, "http://big", b"ab" * 400_000),
]


def expected(rows, revisit_from=0):
    first = {}
    for i, _, p in rows:
        if i is not None:
            first[p or b""] = min(first.get(p or b"", i), i)
    out = []
    for i, _, p in rows:
        refers = first.get(p or b"")
        refers = refers if len(p or b"") >= revisit_from and refers != i else None
        out.append((i, "response" if refers is None else "revisit", len(p or b""), warc.base32_sha1(p or b""), refers))
    return sorted(out, key=repr)


def write(spark, rows, folder, **options):
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"file://{folder}", **options)
    back = warc.read_archives(spark, f"file://{folder}").collect()
    return sorted(((r["record_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in back), key=repr), back


@pytest.mark.parametrize("revisit_from", [0, 10])
def test_round_trip(spark, tmp_path, revisit_from):
    got, back = write(spark, ROWS, tmp_path / "a", revisit_from=revisit_from, shard_bytes=4000, roll_bytes=3000)
    assert got == expected(ROWS, revisit_from)
    payloads = {i: p or b"" for i, _, p in ROWS}
    assert all(bytes(r["payload"]) == payloads[r["record_id"]] for r in back if r["record_type"] == "response")
    assert len(list((tmp_path / "a").glob("part-*.warc.gz"))) > 3 and not list((tmp_path / "a").glob("_temporary*"))


def test_reruns_and_partitions_write_the_same_files(spark, tmp_path):
    sums = []
    for n, order in (("a", 1), ("b", 7)):
        df = spark.createDataFrame(ROWS, SCHEMA).repartition(order)
        warc.write_archives(df, f"file://{tmp_path / n}", shard_bytes=4000, roll_bytes=3000)
        sums.append({p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / n).glob("part-*.warc.gz")})
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_damage_is_an_error(spark, tmp_path):
    write(spark, ROWS[:3], tmp_path / "a")
    part = next((tmp_path / "a").glob("part-*"))
    part.write_bytes(gzip.compress(gzip.decompress(part.read_bytes()).replace(b"<p>1", b"<p>2")))
    with pytest.raises(Exception, match="damaged|digest|ends within|records"):
        warc.read_archives(spark, f"file://{tmp_path / 'a'}").collect()


def test_repeated_rows_and_nothing(spark, tmp_path):
    got, _ = write(spark, [(1, "u", b"x"), (1, "u", b"x"), (2, "v", b"x")], tmp_path / "a")
    assert [g[:2] for g in got] == [(1, "response"), (1, "response"), (2, "revisit")]
    assert write(spark, [], tmp_path / "b")[0] == []


def test_clashing_columns_and_rows_without_id(spark, tmp_path):
    rows = [*ROWS, *((None, "n", b"%d" % i * 300) for i in range(40)), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("shard", "b", "payload_digest", "_order", "part", "low", "r", "_salt")})
    warc.write_archives(df, f"file://{tmp_path / 'a'}", shard_bytes=4000)
    back = warc.read_archives(spark, f"file://{tmp_path / 'a'}").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["record_id"], r["payload_digest"]) for r in back), key=key) == sorted(((i, warc.base32_sha1(p or b"")) for i, _, p in rows), key=key)
    assert len({p.name[:11] for p in (tmp_path / "a").glob("part-*")}) > len({p[0] for p in ROWS}) // 100


def test_digests_in_the_engine_equal_the_library(spark):
    values = [None, b"", b"a", b"\x00\xff" * 1000, "é".encode()]
    got = spark.createDataFrame([(v,) for v in values], "v binary").select(groups.base32_sha1(F.col("v"))).collect()
    assert [r[0] for r in got] == [warc.base32_sha1(v or b"") for v in values]


def test_heavy_ranges_are_cut_finer(spark):
    typed = spark.createDataFrame([(i, 5000) for i in range(2000)] + [(2**50 + i, 100) for i in range(50)], "record_id bigint, payload_bytes bigint")
    starts = warc.cut_shards(typed, 200_000)
    assert starts[0] == 0 and len(starts) > 20
    sizes = typed.withColumn("s", warc.bounds_lookup(starts)("record_id")).groupBy("s").agg(F.sum("payload_bytes").alias("b"))
    assert max(r["b"] for r in sizes.collect()) < 400_000
