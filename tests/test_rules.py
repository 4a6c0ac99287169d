"""The rules of the log on small hand-made cases, and a random model test."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stratakv.functions import hashing, sketches
from stratakv.operators import access, integrity, merge, ratelimit, runs, typed
from stratakv.plans import catalog
from stratakv.schema import LOG, Config
from stratakv.sources import store, wal
from stratakv.streaming import flows

T0 = dt.datetime(2024, 1, 1)


def log_of(spark, rows):
    """rows: (key, value or None, seconds)."""
    data = [(k, v, v is None, T0 + dt.timedelta(seconds=s), i) for i, (k, v, s) in enumerate(rows)]
    return spark.createDataFrame(data, LOG)


def contents(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_last_writer_wins_by_time_then_seq(spark):
    log = log_of(spark, [("a", 1.0, 5), ("a", 2.0, 5), ("a", 3.0, 1), ("b", 1.0, 1), ("b", None, 2), ("c", None, 1), ("c", 4.0, 2)])
    assert contents(merge.live_state(log)) == {"a": 2.0, "c": 4.0}
    assert {r["key"] for r in merge.lww(log).where("tombstone").collect()} == {"b"}


def test_tombstone_hides_older_versions_in_get_and_scans(spark):
    log = log_of(spark, [("a", 1.0, 1), ("ab", 2.0, 1), ("b", 3.0, 1), ("ab", None, 2), ("é", 5.0, 1)])
    assert access.get(log, "ab").count() == 0
    assert [r["key"] for r in access.prefix(log, "a").orderBy("key").collect()] == ["a"]
    assert access.prefix(log, "a", include_tombstones=True).count() == 2
    assert access.prefix(log, "").count() == 3
    assert contents(access.between(log, "a", "a")) == {"a": 1.0}
    assert access.between(log, "b", "a").count() == 0
    assert [r["key"] for r in access.between(log, "a", "zz").orderBy("key").collect()] == ["a", "b"]


def test_store_reads_only_runs_in_question_and_compaction_replaces_its_inputs(spark, tmp_path):
    own = store.RunStore(spark, f"file://{tmp_path}/store", tables=3)
    assert own.get("a") is None and own.state() is None and own.multi_get(log_of(spark, []).select("key")) is None
    parts = [[("a", 1.0, 1), ("b", 2.0, 1)], [("x", 3.0, 2), ("y", 4.0, 2)], [("a", None, 3), ("m", 5.0, 3)], [("x", 6.0, 4)]]
    seq = 0
    for i, rows in enumerate(parts):
        log = log_of(spark, rows).withColumn("seq", F.col("seq") + seq)
        own.flush(log)
        seq += len(rows)
        if i == 1:
            assert len({f.split("run_id=")[1][0] for f in own.get("a").inputFiles()}) == 1
            assert own.get("n") is None and own.compact(0) is False
    before = {r["run_id"] for r in own.runs()}
    assert contents(own.state()) == {"b": 2.0, "x": 6.0, "y": 4.0, "m": 5.0} and own.get("a").count() == 0
    assert own.compact(0) and [(r["level"], r["n_records"]) for r in own.runs()] == [(1, 5)]
    assert not any((tmp_path / "store/runs/level=0" / f"run_id={i}").exists() for i in before)
    assert contents(own.state()) == {"b": 2.0, "x": 6.0, "y": 4.0, "m": 5.0} and contents(own.get("x")) == {"x": 6.0}
    assert contents(own.multi_get(spark.createDataFrame([("m",), ("a",), ("zz",)], "key string"))) == {"m": 5.0}
    plan = own.get("x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,x)" in plan


def test_written_runs_have_bloom_filters_that_skip_row_groups(spark, tmp_path):
    rows = log_of(spark, [(f"k{2 * i:05d}", 1.0, i) for i in range(2000)])
    wal.write_run(rows, str(tmp_path), 0, 1)
    found = wal.read_runs(spark, str(tmp_path)).where("key = 'k00011'")  # within the range of keys, in no run
    assert found.count() == 0
    meta = [pq.ParquetFile(f).metadata.row_group(0).column(0) for f in tmp_path.rglob("*.parquet")]
    assert meta and all(b"k0" in str(m.statistics.min).encode() for m in meta)
    assert all(getattr(m, "bloom_filter_offset", 1) is not None for m in meta)


def test_truncated_log_keeps_whole_segments_and_numbers_them_again(spark, tmp_path):
    path = f"file://{tmp_path}/wal"
    wal.append_segments(log_of(spark, [(f"k{i}", float(i), i) for i in range(30)]), path, 200)
    n = spark.read.parquet(path).select("segment").distinct().count()
    gone = wal.truncate(spark, path, 11)
    good, broken = wal.read(spark, path)
    assert gone == 2 and broken.count() == 0 and {r["segment"] for r in good.select("segment").distinct().collect()} == set(range(n - gone))
    assert min(r["seq"] for r in good.collect()) <= 12 and good.where("seq > 11").count() == 18


def test_sketches_are_values_under_their_own_keys(spark):
    log = spark.createDataFrame([], "key string, value binary, tombstone boolean, change_time timestamp_ntz, seq long")
    at = lambda s: F.lit(T0 + dt.timedelta(seconds=s)).cast("timestamp_ntz")
    one, two = sketches.cms_pack(2, [[1, 2]]), sketches.cms_pack(2, [[3, 4]])
    log = typed.create(log, "words", "cms", one, at(1), F.lit(1))
    log = typed.create(log, "words", "cms", two, at(2), F.lit(2))  # there already
    assert sketches.cms_unpack(typed.fetch(log, "words", "cms")) == [[1, 2]] and typed.fetch(log, "words", "hll") is None
    log = typed.replace(log, "words", "cms", two, at(3), F.lit(3))
    assert typed.fetch(log, "words", "cms") == two
    log = typed.remove(log, "words", "cms", at(4), F.lit(4))
    assert typed.fetch(log, "words", "cms") is None
    log = typed.create(log, "words", "cms", one, at(5), F.lit(5))
    assert typed.fetch(log, "words", "cms") == one


def test_request_log_is_appended_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("10:00:01", 1, "ALLOWED"), ("10:00:02", 1, "BLOCKED")], "t string, tokens int, verdict string")
    for _ in range(2):
        ratelimit.append_requests(spark, str(tmp_path / "log"), rows)
    got = ratelimit.request_summary(ratelimit.parse_requests(spark.read.text(str(tmp_path / "log")))).collect()
    assert {(r["verdict"], r["n"], r["first_t"]) for r in got} == {("ALLOWED", 2, "10:00:01"), ("BLOCKED", 2, "10:00:02")}


def test_hashes_of_whole_columns_equal_those_of_one_text():
    rng = random.Random(5)
    texts = ["", "a", *("".join(rng.choice("abcé日\n") for _ in range(rng.randrange(60))) for _ in range(200))]
    raw, at = hashing.flat_bytes(pa.array(texts))
    for seed in (0, 1, 7):
        assert hashing.murmur3_32_rows(raw, at, seed).tolist() == [hashing.murmur3_32(t.encode(), seed) for t in texts]
    assert hashing.murmur3_64_rows(raw, at).tolist() == [hashing.murmur3_64(t.encode()) for t in texts]


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    rows = [(i, x) for i, x in enumerate(base + [x ^ sum(1 << b for b in rng.sample(range(64), n)) for x in base for n in (0, 1, 2, 3, 3, 4)])]
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    least = {}
    for i, x in rows:
        least[x] = min(i, least.get(x, i))
    want = {(min(a, b), max(a, b), (x ^ y).bit_count()) for x, a in least.items() for y, b in least.items() if a != b and (x ^ y).bit_count() <= 3}
    got = [tuple(r) for r in sketches.near_pairs(spark.createDataFrame(signed, "doc_id long, print long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_reserved_keys(spark):
    keys = ["", "foo_", "bf", "x_bf", "x_hll", "x_cms", "x_sh", "bf_x", "plain"]
    got = spark.createDataFrame([(k,) for k in keys], "key string").select("key", access.key_valid(F.col("key")).alias("ok")).collect()
    assert [r["key"] for r in got if r["ok"]] == ["bf_x", "plain"]


def test_pages_join_to_the_whole_scan_and_cursor_steps(spark):
    log = log_of(spark, [(f"k{i:02d}", float(i), i) for i in range(12)])
    rows = access.prefix(log, "k")
    pages = [r["key"] for n in range(1, 5) for r in access.page(rows, n, 5).collect()]
    assert pages == sorted(pages) and len(pages) == 12
    cursor = access.Cursor(rows, history=3, ahead=2)
    assert [cursor.next() for _ in range(4)] == ["k00", "k01", "k02", "k03"]
    assert [cursor.prev(), cursor.prev(), cursor.prev()] == ["k02", "k01", None]
    assert cursor.next() == "k02"


def test_random_log_equals_a_dictionary_through_flush_and_compaction(spark):
    rng, model, rows = random.Random(3), {}, []
    for i in range(400):
        key, value = f"k{rng.randrange(30)}", None if rng.random() < 0.3 else float(i)
        rows.append((key, value, i // 3))
        model[key] = value
    log = log_of(spark, rows)
    want = {k: v for k, v in model.items() if v is not None}
    assert contents(merge.live_state(log)) == want
    flushed = runs.flush(log, 50)
    assert contents(merge.live_state(flushed.select(log.columns))) == want
    assert contents(merge.live_state(runs.compact(flushed, 4).select(log.columns))) == want


def test_filter_reaches_the_scan_and_the_window_is_limited(spark, tmp_path):
    log_of(spark, [("a", 1.0, 1)]).write.parquet(str(tmp_path / "log"))
    plan = access.prefix(spark.read.parquet(str(tmp_path / "log")), "a")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,a)" in plan and "WindowGroupLimit" in plan


def test_wal_keeps_checksums_and_quarantines(spark, tmp_path):
    path = str(tmp_path / "wal")
    log = log_of(spark, [(f"k{i}", float(i), i) for i in range(10)])
    wal.append(log, path, segment_rows=3)
    bad = integrity.with_crc(log_of(spark, [("x", 1.0, 1)])).withColumn("crc", F.lit(7).cast("bigint"))
    bad.write.mode("append").parquet(path)
    good, broken = wal.read(spark, path)
    assert good.count() == 10 and [r["key"] for r in broken.collect()] == ["x"]


def test_runs_on_disk_read_by_level(spark, tmp_path):
    log = log_of(spark, [("a", 1.0, 1), ("b", None, 1)])
    wal.write_run(log, str(tmp_path), 0, 1)
    wal.write_run(log, str(tmp_path), 1, 2)
    assert wal.read_runs(spark, str(tmp_path)).where("level = 1").count() == 2


def test_stream_flushes_runs_once(spark, tmp_path):
    log_of(spark, [("a", 1.0, 1), ("a", 2.0, 2), ("b", 3.0, 1)]).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        flows.flush_to_runs(flows.read_log(spark, str(tmp_path / "in")), str(tmp_path / "runs"), str(tmp_path / "cp")).awaitTermination()
    got = wal.read_runs(spark, str(tmp_path / "runs"))
    assert contents(merge.live_state(got.select("key", "value", "tombstone", "change_time", "seq"))) == {"a": 2.0, "b": 3.0} and got.count() == 2


def test_token_bucket_batch_and_stream_agree(spark, tmp_path):
    rows = [("u", T0 + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 0, 0, 1, 1, 4, 4, 4, 4])]
    df = spark.createDataFrame(rows, "user string, ts timestamp, event_id long")
    assert [tuple(r) for r in ratelimit.token_bucket(df, "user", 1, 2).collect()] == [("u", 9, 5)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.token_bucket_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", 1, 2)
    stream.writeStream.format("memory").queryName("allowed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT * FROM allowed WHERE allowed").count() == 5


def test_hash_known_answers(spark):
    assert [hashing.murmur3_32(b"", 0), hashing.murmur3_32(b"hello", 0), hashing.murmur3_32(b"foobar", 1)] == [0, 0x248BFA47, 0x6C9B7A46]
    assert [hashing.murmur3_64(x) for x in (b"", b"hello", b"foobar")] == [0, 0xCBD8A7B341BD9B02, 0xBDD2AE7116C85A45]
    row = spark.createDataFrame([("foobar",)], "t string").select(hashing.fnv1a_32(F.col("t")).alias("a"), hashing.fnv1_64(F.col("t")).alias("b")).collect()[0]
    assert row["a"] == 3214735720 and (row["b"]["hi"] << 32 | row["b"]["lo"]) == 0x340D8765A4DDA9C2


def test_sketches_round_trip_and_hold_their_promises(spark):
    assert sketches.bloom_unpack(sketches.bloom_pack(10, 0.01, [1, 5]))[3] == [1, 5]
    assert sketches.cms_unpack(sketches.cms_pack(2, [[1, 2], [3, 4]])) == [[1, 2], [3, 4]]
    assert sketches.hll_unpack(sketches.hll_pack(16, {3: 2}))[2][3] == 2 and sketches.hll_size(16)[0] == 32
    assert sketches.simhash_unpack(sketches.simhash_pack("a b", ["a", "b"], "01")) == ("a b", ["a", "b"], "01")
    assert ratelimit.bucket_unpack(ratelimit.bucket_pack(1, 2, 3, 4)) == (1, 2, 3, 4)
    assert integrity.merkle_unpack(integrity.merkle_pack(list(range(300)))) == list(range(300))
    empty = sketches.hll_count(spark.createDataFrame([], "reg long, rank int"), 16).collect()[0]["estimate"]
    assert empty == 22
    keys = spark.createDataFrame([(k,) for k in ["apple", "apple", "banana", "orange"]], "key string")
    cells = sketches.cms_update(keys, 100, 5)
    assert [r["s"] for r in cells.groupBy("row").agg(F.sum("cnt").alias("s")).collect()] == [4] * 5
    got = {r["key"]: r["estimate"] for r in sketches.cms_estimate(keys.distinct(), cells, 100, 5).collect()}
    assert got["apple"] >= 2 and got["banana"] >= 1
    positions = sketches.bloom_add(keys.distinct(), 100, 0.01)
    probes = spark.createDataFrame([(f"p{i}",) for i in range(100)] + [("apple",)], "key string")
    maybe = {r["key"]: r["maybe"] for r in sketches.bloom_contains(probes, positions, 100, 0.01).collect()}
    assert maybe["apple"] and sum(maybe.values()) < 20


def test_merkle_says_what_changed_or_that_shapes_differ(spark):
    a = spark.createDataFrame([(1, i, i * 10) for i in range(5)], "run_id long, idx long, hash long")
    b = a.withColumn("hash", F.when(F.col("idx") == 3, 99).otherwise(F.col("hash")))
    assert [r["idx"] for r in integrity.merkle_diff(a, b).collect()] == [3]
    assert [r["status"] for r in integrity.validate(a, a.where("idx < 4")).collect()] == ["shape"]
    assert [r["status"] for r in integrity.validate(a, a).collect()] == ["same"]


def test_config_defaults():
    own = Config.load('{"lruCap": 0, "memTableCap": 9, "walSegmentSize": 5, "compType": "odd", "probab": 0.5}')
    assert (own.lruCap, own.indexEl, own.summaryEl, own.walSegmentSize, own.compType, own.probab) == (2, 3, 4, 1000, "size", 0.01)


def test_documents_of_one_fingerprint_are_all_in_a_class(spark):
    rows = [(3, "red green blue"), (5, "blue red GREEN"), (8, "the red green blue"), (9, "other words altogether")]
    prints = sketches.simhash(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in sketches.print_classes(prints).collect()} == {(3, 3), (5, 3), (8, 3), (9, 9)}


def test_overlaps_come_from_every_record_of_the_runs(spark, monkeypatch):
    """Runs meet through any of their records, not through the first of each fifty alone."""
    own = [(f"k{seq % 50 if seq < 500 else 90 + seq % 3 if seq % 50 < 3 else 20}", seq) for seq in range(1000)]
    log = spark.createDataFrame([(k, seq, 1.0, False, dt.datetime(2024, 1, 1)) for k, seq in own], "key string, seq long, value double, tombstone boolean, change_time timestamp")
    monkeypatch.setattr(catalog, "kv_log", lambda *_: log)
    assert [tuple(r) for r in catalog.queries()["overlap_runs"](spark, "").collect()] == [(0, 1)]
