import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fitloom.functions import codecs, listing, text, values
from fitloom.operators import service, upsert
from fitloom.sources import files
from fitloom.streaming import limiter


def test_feed_and_snapshots(spark, tmp_path):
    product = {"id": 1, "title": "Dial", "handle": "dial", "body_html": "<p>x</p>", "product_type": "Dials", "tags": ["a"], "variants": [{"id": 5, "title": "d", "price": "19.90", "available": True}, {"id": 6, "title": "e", "price": "1,9", "available": None}], "images": []}
    for name in ("shop-a-2026-01-02T00.json", "shop-a-2026-03-01T00.json", "shop-b-2025-12-31.json", "notes.json"):
        (tmp_path / name).write_text(json.dumps(product))
    got = {r.vendor: r.path.rsplit("/", 1)[1] for r in files.latest_snapshots(spark, str(tmp_path)).collect()}
    assert got == {"shop-a": "shop-a-2026-03-01T00.json", "shop-b": "shop-b-2025-12-31.json"}
    rows = files.listings_of(files.feed(spark, str(tmp_path / "shop-b-2025-12-31.json"))).orderBy("turn").collect()
    assert [(r.variant, r.price_minor, r.in_stock) for r in rows] == [(5, 1990, True), (6, None, False)]
    (tmp_path / "broken.json").write_text('{"id": "one", "variants": 3}')
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse|convert"):
        files.feed(spark, str(tmp_path / "broken.json")).collect()


def test_tagged_rows_are_kept_or_refused(spark, tmp_path):
    good = {"sourceUrl": "u", "category": "dial", "family": "f", "name": "n", "specSource": "manual", "confidence": "low", "evidence": "e", "styleTags": ["black"]}
    lines = [json.dumps(good), "{no json", json.dumps(good | {"category": "engine"}), json.dumps(good | {"name": None}), json.dumps(good | {"confidence": "sure"})]
    (tmp_path / "t.json").write_text("\n".join(lines))
    valid, refused = files.tagged(spark, str(tmp_path / "t.json"))
    assert valid.count() == 1
    assert sorted(r.problem for r in refused.collect()) == ["a field is missing", "not JSON of this shape", "unknown category", "unknown confidence"]
    (tmp_path / "fx.json").write_text('{\n "GBP": 1.0,\n "USD": 1.25\n}')
    assert files.fixtures(spark, str(tmp_path / "fx.json"), "GBP double, USD double").first().USD == 1.25


def test_images_are_decoded(spark, tmp_path):
    raw = b"".join(b"\0" + bytes([255, 0, 10] * 3) for _ in range(2))  # 3 by 2, red
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    rows = files.images(spark, str(tmp_path)).collect()
    assert [(r.width, r.height, bytes(r.pixels[:3])) for r in rows] == [(3, 2, bytes([10, 0, 255]))]


def test_a_stream_of_changes_is_applied(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    upsert.replace_table(spark.createDataFrame([(1, 10, 0), (2, 20, 0)], "id long, v long, seq long"), path)
    changes = spark.createDataFrame([(2, 21, 1), (2, 22, 2), (3, 30, 1)], "id long, v long, seq long")
    changes.write.parquet(f"{tmp_path}/in")
    writer = limiter.upsert_stream(spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/in"), path, ["id"], ["seq"], ["v"], f"file://{tmp_path}/c")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 22), (3, 30)]


def test_a_table_set_aside_by_a_crash_comes_back(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    upsert.replace_table(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # what a crash between the two renames leaves
    upsert.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()


def test_numbers_without_one_task(spark):
    rows = spark.range(1, 2000).select(F.col("id"), (F.col("id") * 7919 % 10007).alias("x"))
    got = codecs.numbered(rows, F.floor(F.col("x") / 100), "x").orderBy("k").collect()
    assert [r.k for r in got] == list(range(1, 2000)) and [r.x for r in got] == sorted(r.x for r in got)


def one(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)).select(column.alias("x")).first().x


def test_listing_links_and_facts(spark):
    link = lambda u: tuple(one(spark, listing.listing_link(F.col("u")), u=u))
    assert link("https://www.ebay.de/itm/a-case/123456789012?x=1") == ("ebay", "123456789012", None)
    assert link("https://ja.aliexpress.com/item/1005001.html") == ("aliexpress", "1005001", None)
    assert link("https://ebay.com.evil.org/itm/123456789")[2] == "other shop" and link("https://ebay.com:8443/itm/123456789")[2] == "extra parts"
    assert link("nothing")[2] == "not a link" and link("javascript:alert(1)")[2] in ("not a link", "not a web link")
    known = ["skx007-case", "nh3x-movement", "generic-strap"]
    f = lambda t: one(spark, listing.facts(F.col("t"), known), t=t)
    assert (f("SKX007 42mm case 4 o'clock crown").slot, f("SKX007 42mm case 4 o'clock crown").family, f("SKX007 42mm case 4 o'clock crown").crown) == ("case", "skx007-case", "4")
    assert f("Case for 28.5mm dial").slot is None and f("SKX007/SKX013 case").family == "unknown" and f("NH35 / NH36 movement").calibers == "NH35,NH36"


def test_values(spark):
    assert one(spark, values.patch_json(F.col("a"), F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("1"))), a='{"b":"2","a":"0"}') == '{"a":"0","c":"1"}'
    assert one(spark, values.json_object(F.col("t")), t="x ```json\n{\"a\": {\"b\": 1}}\n``` y") == '{"a": {"b": 1}}' and one(spark, values.json_object(F.col("t")), t="none") is None
    assert one(spark, text.redact_terms(F.col("t")), t="A Tudor, Black Bay look") == "A, look" and one(spark, text.redact_terms(F.col("t")), t="subdial  kept") == "subdial  kept"
    pairs = service.promote(spark.createDataFrame([(2, 1), (5, 6)], "a long, b long"), spark.createDataFrame([(1, 2, 9), (7, 8, 3)], "a long, b long, distance long"))
    assert {(r.a, r.b): r.source for r in pairs.collect()} == {(1, 2): "both", (5, 6): "user-link", (7, 8): "phash"}
