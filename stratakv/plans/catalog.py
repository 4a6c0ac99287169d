"""Named queries over the provided tables and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.functions import hashing, sketches
from stratakv.operators import access, integrity, merge, ratelimit, runs
from stratakv.schema import kv_log
from stratakv.sources import store, wal, workspace

CAP = 500  # records of a run
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KV = """kv AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '/' || CAST(event_id % 10 AS VARCHAR) AS key,
  CASE WHEN event_type <> 'error' THEN value END AS value, event_type = 'error' AS tombstone, ts AS change_time, event_id AS seq FROM events)"""
LWW = "lww AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY change_time DESC, seq DESC) AS rn FROM kv) WHERE rn = 1)"
LIVE = "live AS (SELECT key, value, change_time, seq FROM lww WHERE NOT tombstone)"
RUNS = f"""runs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, seq // {CAP} AS run_id, 0 AS level, row_number() OVER (PARTITION BY seq // {CAP}, key ORDER BY change_time DESC, seq DESC) AS rn FROM kv) WHERE rn = 1)"""
STATS = "stats AS (SELECT level, run_id, min(key) AS min_key, max(key) AS max_key, count(*) AS n_records, CAST(sum(CAST(tombstone AS INT)) AS BIGINT) AS n_tombstones, CAST(sum(seq) AS BIGINT) AS seq_sum FROM runs GROUP BY level, run_id)"
SIZED = "sized AS (SELECT *, 29 + strlen(key) + CASE WHEN tombstone THEN 0 ELSE 16 END AS record_size FROM runs), placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY key) AS ordinal, CAST(coalesce(sum(record_size) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM sized)"
#: One FNV step list per text: bytes by their place.
BYTES = "list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT)"


def fnv_sql(text: str, kind: str) -> str:
    step = "((xor(h, b) * 16777619) & 4294967295)" if kind == "1a" else "xor((h * 16777619) & 4294967295, b)"
    return f"list_reduce({BYTES.format(text)}, lambda h, b: {step}, 2166136261::BIGINT)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# Versions and current state


@query(with_(KV, LWW) + "SELECT key, value, tombstone, change_time, seq FROM lww")
def merge_lww(spark, d):
    return merge.lww(kv_log(spark, d))


@query(with_(KV, LWW, LIVE) + "SELECT key, value, change_time, seq FROM live")
def live_state(spark, d):
    return merge.live_state(kv_log(spark, d))


@query(with_(KV) + "SELECT key, value, tombstone, change_time, seq, CAST(row_number() OVER (PARTITION BY key ORDER BY change_time DESC, seq DESC) AS INT) AS version FROM kv")
def version_history(spark, d):
    return merge.version_history(kv_log(spark, d))


@query(with_(KV) + "SELECT key, seq, tombstone FROM kv WHERE seq % 2 = 0 UNION ALL SELECT key, seq, tombstone FROM kv WHERE seq % 2 = 1")
def union_runs(spark, d):
    log = kv_log(spark, d)
    return merge.union_runs(log.where("seq % 2 = 0"), log.where("seq % 2 = 1")).select("key", "seq", "tombstone")


@query(with_(KV, LWW) + "SELECT key, seq, tombstone, CASE WHEN seq % 4 = 0 THEN 'memory' ELSE 'disk' END AS tier FROM lww")
def merge_mem_disk(spark, d):
    log = kv_log(spark, d)
    return merge.merge_tiers(log.where("seq % 4 = 0"), log.where("seq % 4 <> 0")).select("key", "seq", "tombstone", "tier")


# Point operations


@query(with_(KV, LWW, LIVE) + "SELECT key, value, seq FROM live WHERE key = 'u000003/4'")
def get_key(spark, d):
    return access.get(kv_log(spark, d), "u000003/4").select("key", "value", "seq")


def _wanted(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("/"), (F.col("c_nationkey") % 10).cast("string")).alias("key")).distinct()


WANTED = "wanted AS (SELECT DISTINCT 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '/' || CAST(c_nationkey % 10 AS VARCHAR) AS key FROM customer)"


@query(with_(KV, LWW, LIVE, WANTED) + "SELECT key, value, seq FROM live WHERE key IN (SELECT key FROM wanted)")
def multi_get(spark, d):
    return access.multi_get(kv_log(spark, d), _wanted(spark, d)).select("key", "value", "seq")


@query(with_(KV, LWW, LIVE, WANTED) + "SELECT key FROM wanted WHERE key IN (SELECT key FROM live)")
def exists_semi(spark, d):
    return access.exists(_wanted(spark, d), kv_log(spark, d))


@query(with_(KV, LWW, LIVE, WANTED) + "SELECT key FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.key = w.key)")
def exists_anti(spark, d):
    return access.missing(_wanted(spark, d), kv_log(spark, d))


def _after(extra: str, parts: str = "") -> str:
    kv = KV.replace("kv AS (", "kv AS (SELECT key, value, tombstone, change_time, seq FROM (", 1)
    return with_(kv[:-1] + f") UNION ALL {extra})", LWW, LIVE) + f"SELECT count(*) AS n_live, CAST(sum(seq) AS BIGINT) AS seq_sum, count(*) FILTER (WHERE key = 'u000003/4') AS n_key, max(value) FILTER (WHERE key = 'u000003/4') AS key_value FROM live{parts}"


def _summary(log: DataFrame) -> DataFrame:
    own = F.col("key") == "u000003/4"
    return merge.live_state(log).agg(F.count("*").alias("n_live"), F.sum("seq").alias("seq_sum"), F.count(F.when(own, 1)).alias("n_key"), F.max(F.when(own, F.col("value"))).alias("key_value"))


LATE = "TIMESTAMP '2100-01-01 00:00:00'"


def _late():
    return F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")


@query(_after(f"SELECT 'u000003/4', 12.5, false, {LATE}, 1000000000"))
def put_effect(spark, d):
    return _summary(merge.put(kv_log(spark, d), F.lit("u000003/4"), F.lit(12.5), _late(), F.lit(10**9)))


@query(_after(f"SELECT 'u000003/4', NULL, true, {LATE}, 1000000000"))
def delete_effect(spark, d):
    return _summary(merge.delete(kv_log(spark, d), F.lit("u000003/4"), _late(), F.lit(10**9)))


@query(_after(f"SELECT 'u000003/4', 1.5, false, {LATE}, 1000000000 UNION ALL SELECT 'u000003/4', 2.5, false, {LATE}, 1000000001"))
def update_effect(spark, d):
    log = merge.put(kv_log(spark, d), F.lit("u000003/4"), F.lit(1.5), _late(), F.lit(10**9))
    return _summary(merge.update(log, F.lit("u000003/4"), F.lit(2.5), _late(), F.lit(10**9 + 1)))


@query("""SELECT p_partkey, key, list_extract(string_split(key, '_'), -1) NOT IN ('bf', 'hll', 'cms', 'sh', '') AS valid FROM (SELECT p_partkey, p_name || CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN '_bf' WHEN 1 THEN '_hll' WHEN 2 THEN '_cms' WHEN 3 THEN '_sh' WHEN 4 THEN '_' WHEN 5 THEN '_bf_x' ELSE '' END AS key FROM part)""")
def key_valid(spark, d):
    ends = F.element_at(F.array(*[F.lit(x) for x in ("_bf", "_hll", "_cms", "_sh", "_", "_bf_x", "")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    keys = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat("p_name", ends).alias("key"))
    return keys.withColumn("valid", access.key_valid(F.col("key")))


# Scans


def _page(where: str, number: int, size: int, table: str = "live") -> str:
    return with_(KV, LWW, LIVE) + f"SELECT key, seq FROM {table} WHERE {where} ORDER BY key LIMIT {size} OFFSET {size * (number - 1)}"


@query(_page("starts_with(key, 'u00000')", 1, 20))
def prefix_scan_p1(spark, d):
    return access.page(access.prefix(kv_log(spark, d), "u00000"), 1, 20).select("key", "seq")


@query(_page("starts_with(key, 'u00000')", 2, 20))
def prefix_scan_p2(spark, d):
    return access.page(access.prefix(kv_log(spark, d), "u00000"), 2, 20).select("key", "seq")


@query(_page("key BETWEEN 'u000010' AND 'u000050/5'", 1, 30))
def range_scan_p1(spark, d):
    return access.page(access.between(kv_log(spark, d), "u000010", "u000050/5"), 1, 30).select("key", "seq")


@query(_page("key BETWEEN 'u000010' AND 'u000050/5'", 1, 30))
def page_prev(spark, d):
    return access.page_prev(access.between(kv_log(spark, d), "u000010", "u000050/5"), 2, 30).select("key", "seq")


@query(with_(KV, LWW) + "SELECT key, seq, tombstone FROM lww WHERE starts_with(key, 'u00000')")
def scan_with_tombstones(spark, d):
    return access.prefix(kv_log(spark, d), "u00000", include_tombstones=True).select("key", "seq", "tombstone")


@query(with_(KV, LWW, LIVE) + "SELECT key, seq FROM live WHERE starts_with(key, 'u0000')")
def prefix_iterate(spark, d):
    return access.prefix(kv_log(spark, d), "u0000").select("key", "seq")


@query(with_(KV, LWW, LIVE) + "SELECT key, seq FROM live WHERE key BETWEEN 'u000020/0' AND 'u000020/9'")
def range_iterate(spark, d):
    return access.between(kv_log(spark, d), "u000020/0", "u000020/9").select("key", "seq")


@query(with_(KV, LWW, LIVE) + "SELECT bucket, key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM (SELECT split_part(key, '/', 1) AS bucket, key FROM live)")
def iter_walk(spark, d):
    rows = merge.live_state(kv_log(spark, d)).select(F.substring_index("key", "/", 1).alias("bucket"), "key")
    return access.walk(rows)


@query(with_(KV, LWW) + "SELECT key, seq, tombstone FROM lww ORDER BY key")
def full_scan_sorted(spark, d):
    return merge.lww(kv_log(spark, d)).orderBy("key").select("key", "seq", "tombstone")


@query(with_(KV) + f", m AS (SELECT min(key) AS least FROM kv) SELECT source, key, change_time, seq, CAST(row_number() OVER (ORDER BY change_time DESC, seq DESC) AS INT) AS age FROM (SELECT seq // {CAP} AS source, key, max(change_time) AS change_time, max(seq) AS seq FROM kv, m WHERE key = least GROUP BY 1, 2)")
def min_key_sources(spark, d):
    return access.min_key_sources(kv_log(spark, d).withColumn("source", F.floor(F.col("seq") / CAP)), "source")


def _per_run(where: str) -> str:
    return with_(KV) + f"SELECT run_id, key, seq, CAST(place AS INT) AS place FROM (SELECT seq // {CAP} AS run_id, key, seq, row_number() OVER (PARTITION BY seq // {CAP} ORDER BY key, seq DESC) AS place FROM kv WHERE NOT tombstone AND {where}) WHERE place <= 5"


@query(_per_run("starts_with(key, 'u0000')"))
def bulk_prefix_per_run(spark, d):
    log = kv_log(spark, d).withColumn("run_id", F.floor(F.col("seq") / CAP)).where(F.col("key").startswith("u0000"))
    return access.first_per_run(log, "run_id", 5).select("run_id", "key", "seq", "place")


@query(_per_run("key BETWEEN 'u000010' AND 'u000050'"))
def bulk_range_per_run(spark, d):
    log = kv_log(spark, d).withColumn("run_id", F.floor(F.col("seq") / CAP)).where(F.col("key").between("u000010", "u000050"))
    return access.first_per_run(log, "run_id", 5).select("run_id", "key", "seq", "place")


@query(with_(KV) + "SELECT key, max(change_time) AS last_used, max(seq) AS last_seq FROM kv GROUP BY key ORDER BY last_used DESC, last_seq DESC LIMIT 25")
def lru_topk(spark, d):
    return access.most_recent(kv_log(spark, d), 25)


# Runs and compaction


def _runs(spark, d):
    return runs.flush(kv_log(spark, d), CAP)


@query(with_(KV, RUNS) + "SELECT run_id, level, key, seq, tombstone FROM runs")
def flush_runs(spark, d):
    return _runs(spark, d).select("run_id", "level", "key", "seq", "tombstone")


@query(with_(KV, RUNS, STATS) + "SELECT * FROM stats")
def run_stats(spark, d):
    return runs.run_stats(_runs(spark, d))


@query(with_(KV, RUNS, STATS) + "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id % 3 ORDER BY run_id) AS INT) AS new_run FROM stats")
def renumber_runs(spark, d):
    """Runs dealt over three levels, whose numbers have gaps then, numbered again within each."""
    return runs.renumber(runs.run_stats(_runs(spark, d)).withColumn("level", F.col("run_id") % 3)).select("run_id", "new_run")


@query(with_(KV, RUNS, STATS) + "SELECT least(CAST(run_id % 5 AS INT), 3) AS level, count(*) + 1 AS next_run FROM stats GROUP BY 1")
def next_run_slot(spark, d):
    stats = runs.run_stats(_runs(spark, d)).withColumn("level", (F.col("run_id") % 5).cast("int"))
    return runs.next_slot(stats, 4)


@query(with_(KV, RUNS, STATS) + "SELECT a.run_id AS upper_run, b.run_id AS lower_run FROM stats a JOIN stats b ON a.min_key <= b.max_key AND a.max_key >= b.min_key WHERE a.run_id % 2 = 0 AND b.run_id % 2 = 1")
def overlap_runs(spark, d):
    """Even and odd runs of the whole flushed log, as an upper and a lower level, whose key ranges meet."""
    stats = runs.run_stats(_runs(spark, d))
    return runs.overlaps(stats.where("run_id % 2 = 0"), stats.where("run_id % 2 = 1")).select("upper_run", "lower_run")


@query(with_(KV, RUNS, STATS) + "SELECT level, count(*) AS n_runs, count(*) >= 5 AND level < 3 AS compact FROM (SELECT CAST(run_id % 4 AS INT) AS level FROM stats) GROUP BY level")
def compaction_plan_size(spark, d):
    return runs.plan_size_tiered(runs.run_stats(_runs(spark, d)).withColumn("level", (F.col("run_id") % 4).cast("int")), 5, 4)


@query(with_(KV, RUNS, STATS) + "SELECT level, count(*) AS n_runs, min(run_id) AS oldest_run, CAST(2 * pow(2, level) AS BIGINT) AS run_limit, count(*) >= 2 * pow(2, level) AND level < 3 AS compact FROM (SELECT CAST(run_id % 4 AS INT) AS level, run_id FROM stats) GROUP BY level")
def compaction_plan_level(spark, d):
    return runs.plan_leveled(runs.run_stats(_runs(spark, d)).withColumn("level", (F.col("run_id") % 4).cast("int")), 2, 2, 4)


@query(with_(KV) + f"SELECT run_id, 1 AS level, key, seq, tombstone FROM (SELECT seq // {CAP * 4} AS run_id, key, seq, tombstone, row_number() OVER (PARTITION BY seq // {CAP * 4}, key ORDER BY change_time DESC, seq DESC) AS rn FROM kv) WHERE rn = 1")
def compact_size_tiered(spark, d):
    return runs.compact(_runs(spark, d), 4).select("run_id", "level", "key", "seq", "tombstone")


@query(with_(KV, RUNS, STATS) + """, b AS (SELECT min_key AS low, max_key AS high FROM stats WHERE run_id = 0), met AS (SELECT run_id FROM stats, b WHERE run_id % 2 = 1 AND min_key <= high AND max_key >= low),
 every AS (SELECT key, seq, tombstone, change_time FROM runs WHERE run_id = 0 OR run_id IN (SELECT run_id FROM met)) SELECT key, seq, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY change_time DESC, seq DESC) AS rn FROM every) WHERE rn = 1""")
def compact_leveled(spark, d):
    own = _runs(spark, d)
    lower = own.where("run_id % 2 = 1")
    return runs.compact_leveled(own.where("run_id % 2 = 0"), lower, runs.run_stats(lower), 0).select("key", "seq", "tombstone")


@query("SELECT n_regionkey AS level, 5 * pow(5.0, n_regionkey + 1) AS size_bound, 5 * pow(10.0, n_regionkey + 1) * 5 AS level_bound FROM nation GROUP BY n_regionkey")
def compaction_bounds(spark, d):
    levels = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("level")).distinct()
    size, level = runs.bounds(5, 5, 10, F.col("level"))
    return levels.select("level", size.alias("size_bound"), level.alias("level_bound"))


@query(with_(KV, RUNS, SIZED) + "SELECT run_id, ordinal, key, \"offset\" FROM placed WHERE ordinal % 10 = 0")
def sparse_index(spark, d):
    return runs.sparse_index(_runs(spark, d), 10).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(with_(KV, RUNS, SIZED) + ", entries AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY key) AS entry FROM placed WHERE ordinal % 10 = 0), ends AS (SELECT run_id, min(key) AS min_key, max(key) AS max_key FROM runs GROUP BY run_id) SELECT e.run_id, entry, key, min_key, max_key FROM entries e JOIN ends USING (run_id) WHERE entry % 5 = 0")
def summary_index(spark, d):
    return runs.summary_index(_runs(spark, d), 10, 5).withColumn("entry", F.col("entry").cast("bigint"))


@query(with_(KV, RUNS, SIZED) + "SELECT run_id, 0::BIGINT AS start, CAST(sum(record_size) AS BIGINT) AS \"end\" FROM sized GROUP BY run_id")
def offset_bounds(spark, d):
    return runs.offset_bounds(_runs(spark, d))


@query(with_(KV) + "SELECT key, seq, 29 + strlen(key) + CASE WHEN tombstone THEN 0 ELSE 16 END AS record_size FROM kv")
def record_size(spark, d):
    return kv_log(spark, d).select("key", "seq", runs.record_size().alias("record_size"))


@query(with_(KV) + "SELECT key, row_number() OVER (ORDER BY key) AS key_id FROM (SELECT DISTINCT key FROM kv)")
def dict_encode(spark, d):
    return runs.dict_encode(kv_log(spark, d))


@query(with_(KV) + "SELECT seq, key FROM kv")
def dict_decode(spark, d):
    """Keys as numbers of the dictionary, and back."""
    log = kv_log(spark, d).select("seq", "key")
    dictionary = runs.dict_encode(log)
    return runs.dict_decode(log.join(dictionary, "key").select("seq", "key_id"), dictionary)


@query(with_(KV) + ", s AS (SELECT seq, 37 + strlen(key) + CASE WHEN value IS NULL THEN 0 ELSE 8 END AS wal_bytes FROM kv) SELECT seq, wal_bytes, CAST(coalesce(sum(wal_bytes) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 20000 AS segment FROM s")
def wal_segments(spark, d):
    return wal.segments(kv_log(spark, d), 20000)


@query(with_(KV) + "SELECT key, seq FROM kv WHERE seq > 700")
def wal_tail(spark, d):
    return wal.tail(kv_log(spark, d), 700).select("key", "seq")


def _store(spark, d) -> store.RunStore:
    """The log flushed in five runs, four of which are compacted into one of the next level; their files are gone."""
    log, own = kv_log(spark, d), store.RunStore(spark, workspace.new_folder(spark, "store"), tables=4)
    last = log.agg(F.max("seq").alias("seq")).collect()[0]["seq"] or 0
    step = last // 5 + 1
    for i in range(5):
        own.flush(log.where((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)))
        if i == 3:
            own.compact(0)
    return own


@query(with_(KV, LWW, LIVE, WANTED) + "SELECT key, value, seq FROM live WHERE key IN (SELECT key FROM wanted)")
def store_multi_get(spark, d):
    """Read from written runs after a compaction, not from the log."""
    return _store(spark, d).multi_get(_wanted(spark, d)).select("key", "value", "seq")


@query(with_(KV, LWW, LIVE) + "SELECT key, value, seq FROM live WHERE key BETWEEN 'u000010' AND 'u000050/5'")
def store_range(spark, d):
    return merge.live_state(_store(spark, d).within("u000010", "u000050/5")).select("key", "value", "seq")


@query(with_(KV) + f", n AS (SELECT level, run_id, count(*) AS n_records, min(key) AS min_key, max(key) AS max_key FROM (SELECT DISTINCT CASE WHEN seq // step < 4 THEN 1 ELSE 0 END AS level, CASE WHEN seq // step < 4 THEN 5 ELSE 6 END AS run_id, key FROM kv, (SELECT max(seq) // 5 + 1 AS step FROM kv)) GROUP BY ALL) SELECT CAST(level AS INT) AS level, CAST(run_id AS BIGINT) AS run_id, n_records, min_key, max_key FROM n")
def store_manifest(spark, d):
    """The runs left after a compaction of four into one and one more flush."""
    runs_left = [(r["level"], r["run_id"], r["n_records"], r["min_key"], r["max_key"]) for r in _store(spark, d).runs()]
    return spark.createDataFrame(runs_left, "level int, run_id long, n_records long, min_key string, max_key string")


@query(
    with_(KV)
    + """, s AS (SELECT key, seq, CAST(coalesce(sum(37 + strlen(key) + CASE WHEN value IS NULL THEN 0 ELSE 8 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 20000 AS old FROM kv),
 kept AS (SELECT *, max(seq) OVER (PARTITION BY old) AS last FROM s) SELECT key, seq, CAST(dense_rank() OVER (ORDER BY old) - 1 AS INT) AS segment FROM kept WHERE last > 700"""
)
def wal_truncate(spark, d):
    """The written log once the segments that hold nothing above record 700 are deleted and the others numbered again."""
    path = workspace.new_folder(spark, "wal")
    wal.append_segments(kv_log(spark, d), path, 20000)
    wal.truncate(spark, path, 700)
    good, _ = wal.read(spark, path)
    return good.select("key", "seq", "segment")


@query(with_(KV, LWW, LIVE) + "SELECT count(*) AS n_live, 0::BIGINT AS n_missing, 0::BIGINT AS n_extra FROM live")
def recover_equals_state(spark, d):
    """Replaying flushed runs and the log's tail gives the state that the whole log gives."""
    log = kv_log(spark, d)
    flushed = runs.flush(log.where("seq <= 700"), CAP).select(log.columns)
    replayed = merge.live_state(merge.union_runs(flushed, wal.tail(log, 700))).select("key", "seq").withColumn("side", F.lit(1))
    whole = merge.live_state(log).select("key", "seq").withColumn("side", F.lit(2))
    both = replayed.unionByName(whole).groupBy("key", "seq").agg(F.sum("side").alias("sides"))
    return both.agg(F.count(F.when(F.col("sides") >= 2, 1)).alias("n_live"), F.count(F.when(F.col("sides") == 2, 1)).alias("n_missing"), F.count(F.when(F.col("sides") == 1, 1)).alias("n_extra"))


# Integrity

TEXT = "key || '|' || CAST(seq AS VARCHAR) || '|' || CASE WHEN tombstone THEN 'true' ELSE 'false' END"
LEAVES = f"leaves AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS idx, key, seq, {fnv_sql('txt', '1')} AS hash FROM (SELECT *, {TEXT} AS txt FROM runs))"
CHANGED = LEAVES.replace("leaves AS", "changed AS").replace(f"{TEXT} AS txt FROM runs", "key || '|' || CAST(CASE WHEN seq % 97 = 0 THEN seq + 1 ELSE seq END AS VARCHAR) || '|' || CASE WHEN tombstone THEN 'true' ELSE 'false' END AS txt FROM runs")
CRC_TABLE_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


@query(
    with_(KV)
    + f""", byte AS (SELECT key, seq, {BYTES.format("txt")} AS bytes FROM (SELECT key, seq, {TEXT} AS txt FROM kv))
 SELECT key, seq, xor(list_reduce(bytes, lambda h, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda c, i: {CRC_TABLE_STEP}, xor(h, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM byte"""
)
def crc32_records(spark, d):
    return integrity.with_crc(kv_log(spark, d)).select("key", "seq", "crc")


@query(with_(KV, RUNS, LEAVES) + "SELECT run_id, idx, key, hash FROM leaves")
def merkle_leaves(spark, d):
    return integrity.merkle_leaves(_runs(spark, d))


@query(with_(KV, RUNS, LEAVES) + "SELECT run_id, CAST(sum(hash) AS BIGINT) AS root, count(*) AS n_leaves, CAST(ceil(log2(count(*))) AS INT) AS height FROM leaves GROUP BY run_id")
def merkle_root(spark, d):
    return integrity.merkle_root(integrity.merkle_leaves(_runs(spark, d)))


@query(with_(KV, RUNS, LEAVES) + "SELECT run_id, CAST(level AS INT) AS level, idx >> level AS idx, CAST(sum(hash) AS BIGINT) AS hash FROM leaves, (SELECT unnest(range(0, 10))::INT AS level) GROUP BY 1, 2, 3")
def merkle_levels(spark, d):
    return integrity.merkle_levels(integrity.merkle_leaves(_runs(spark, d)), 9)


def _changed(spark, d):
    own = _runs(spark, d)
    return integrity.merkle_leaves(own), integrity.merkle_leaves(own.withColumn("seq", F.when(F.col("seq") % 97 == 0, F.col("seq") + 1).otherwise(F.col("seq"))))


@query(with_(KV, RUNS, LEAVES, CHANGED) + "SELECT run_id, idx, a.hash AS old_hash, b.hash AS new_hash FROM leaves a JOIN changed b USING (run_id, idx) WHERE a.hash <> b.hash")
def merkle_diff(spark, d):
    return integrity.merkle_diff(*_changed(spark, d))


@query(with_(KV, RUNS, LEAVES, CHANGED) + "SELECT run_id, CASE WHEN count(*) FILTER (WHERE a.hash <> b.hash) > 0 THEN 'changed' ELSE 'same' END AS status, count(*) FILTER (WHERE a.hash <> b.hash) AS n_changed FROM leaves a JOIN changed b USING (run_id, idx) GROUP BY run_id")
def validate_runs(spark, d):
    return integrity.validate(*_changed(spark, d))


# Sketches


@query("SELECT p_partkey, CAST(floor(-p_partkey * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(round((CAST(floor(-p_partkey * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) // p_partkey) * ln(2)) AS INT) AS hashes FROM part WHERE p_partkey > 0")
def bloom_params(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").where("p_partkey > 0").select("p_partkey")
    return sketches.bloom_create(parts, F.col("p_partkey"), F.lit(0.01))


def _turned(x: str, r: int, bits: int = 32, kind: str = "UBIGINT") -> str:
    return f"((({x} % {1 << (bits - r)}::{kind}) * {1 << r}::{kind}) + ({x} // {1 << (bits - r)}::{kind}))"


def _number(first: int, n: int, kind: str) -> str:
    """n bytes of the list b from place `first` on, the lowest first."""
    return "(" + " + ".join(f"b[{first + i}]::{kind} * {1 << 8 * i}::{kind}" for i in range(n)) + ")"


#: Murmur3 of keys of nine bytes, which all keys of the log have: two numbers of four bytes and one byte, or of eight bytes and one.
M32, M64, W = "4294967296::UBIGINT", "18446744073709551616::UHUGEINT", "UHUGEINT"
PUT32 = lambda k: f"({_turned(f'({k} * 3432918353::UBIGINT % {M32})', 15)} * 461845907::UBIGINT % {M32})"
MURMUR32 = f"""m0 AS (SELECT key, i, xor(i::UBIGINT, {PUT32(_number(1, 4, "UBIGINT"))}) AS h, b FROM (SELECT key, {BYTES.format("key")} AS b FROM keys), (SELECT unnest(range(0, (SELECT hashes FROM size))) AS i)),
 m1 AS (SELECT key, i, b, xor(({_turned("h", 13)} * 5 + 3864292196::UBIGINT) % {M32}, {PUT32(_number(5, 4, "UBIGINT"))}) AS h FROM m0),
 m2 AS (SELECT key, i, xor(xor(({_turned("h", 13)} * 5 + 3864292196::UBIGINT) % {M32}, {PUT32("b[9]::UBIGINT")}), 9::UBIGINT) AS h FROM m1),
 m3 AS (SELECT key, i, xor(h, h // 65536) * 2246822507::UBIGINT % {M32} AS h FROM m2), m4 AS (SELECT key, i, xor(h, h // 8192) * 3266489909::UBIGINT % {M32} AS h FROM m3),
 places AS (SELECT key, CAST(xor(h, h // 65536) % (SELECT bits FROM size) AS BIGINT) AS pos FROM m4)"""
BLOOM_SIZE = "size AS (SELECT bits, CAST(round((bits // n) * ln(2)) AS INT) AS hashes FROM (SELECT n, CAST(floor(-n * ln(0.01) / (ln(2) * ln(2))) AS UBIGINT) AS bits FROM (SELECT greatest(count(*), 1) AS n FROM members)))"
ALL_KEYS = "keys AS (SELECT DISTINCT key FROM kv)"
MIX64 = lambda x: f"xor({x}, {x} // 8589934592::{W})"
MURMUR64 = f"""n0 AS (SELECT key, xor({_turned(f"({_number(1, 8, W)} * 9782798678568883157::{W} % {M64})", 31, 64, W)} * 5545529020109919103::{W} % {M64}, 9::{W}) AS a, xor({_turned(f"(b[9]::{W} * 5545529020109919103::{W} % {M64})", 33, 64, W)} * 9782798678568883157::{W} % {M64}, 9::{W}) AS b FROM (SELECT key, {BYTES.format("key")} AS b FROM keys)),
 n1 AS (SELECT key, (a + b) % {M64} AS a, (a + b + b) % {M64} AS b FROM n0), n2 AS (SELECT key, {MIX64("a")} * 18397679294719823053::{W} % {M64} AS a, {MIX64("b")} * 18397679294719823053::{W} % {M64} AS b FROM n1),
 n3 AS (SELECT key, {MIX64("a")} * 14181476777654086739::{W} % {M64} AS a, {MIX64("b")} * 14181476777654086739::{W} % {M64} AS b FROM n2), hashed AS (SELECT key, ({MIX64("a")} + {MIX64("b")}) % {M64} AS h FROM n3)"""


def registers_sql(bits: int) -> str:
    zeros = f"coalesce(list_position(list_transform(range(0, 63), lambda i: (h // pow(2, i)::{W}) % 2 = 1), true) - 1, 63)"
    return f"registers AS (SELECT CAST(h // {1 << (64 - bits)}::{W} AS BIGINT) AS reg, CAST(max({zeros} + 1) AS INT) AS rank FROM hashed GROUP BY 1)"


def _members(spark, d) -> DataFrame:
    return merge.live_state(kv_log(spark, d)).select("key")


@query(with_(KV, LWW, LIVE, "members AS (SELECT key FROM live)", ALL_KEYS, BLOOM_SIZE, MURMUR32) + "SELECT key, bool_and(pos IN (SELECT pos FROM places WHERE key IN (SELECT key FROM members))) AS maybe FROM places GROUP BY key")
def bloom_membership(spark, d):
    """Every key that was ever written, asked of a filter over the live ones."""
    members = _members(spark, d)
    n = max(members.count(), 1)
    return sketches.bloom_contains(kv_log(spark, d).select("key").distinct(), sketches.bloom_add(members, n, 0.01), n, 0.01)


@query(with_(KV, ALL_KEYS, "members AS (SELECT key FROM keys)", BLOOM_SIZE, MURMUR32) + "SELECT DISTINCT pos FROM places")
def bloom_bits(spark, d):
    keys = kv_log(spark, d).select("key").distinct()
    return sketches.bloom_add(keys, max(keys.count(), 1), 0.01)


WIDTH, ROWS = 200, 4
CMS = f"""hashed AS (SELECT key, n, {fnv_sql("key", "1a")} AS h FROM (SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'u' || CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 1)),
 asked AS (SELECT key, n, CAST(r AS INT) AS "row", ((h + r) % 4294967296) % 4294967295 % {WIDTH} AS bucket FROM hashed, (SELECT unnest(range(0, {ROWS})) AS r)), cells AS (SELECT "row", bucket, CAST(sum(n) AS BIGINT) AS cnt FROM asked GROUP BY 1, 2)"""


def _items(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(F.col("event_type").alias("key")).unionAll(events.select(F.concat(F.lit("u"), F.col("user_id").cast("string"))))


@query(with_(CMS) + 'SELECT "row", bucket, cnt FROM cells')
def cms_table(spark, d):
    return sketches.cms_update(_items(spark, d), WIDTH, ROWS)


@query(with_(CMS) + 'SELECT key, min(cnt) AS estimate FROM asked JOIN cells USING ("row", bucket) GROUP BY key')
def cms_estimate(spark, d):
    items = _items(spark, d)
    return sketches.cms_estimate(items.select("key").distinct(), sketches.cms_update(items, WIDTH, ROWS), WIDTH, ROWS)


@query("SELECT count(*) AS n_keys, 0::BIGINT AS n_under FROM (SELECT event_type FROM events UNION SELECT 'u' || CAST(user_id AS VARCHAR) FROM events)")
def cms_never_under(spark, d):
    items = _items(spark, d)
    truth = items.groupBy("key").agg(F.count("*").alias("n"))
    got = sketches.cms_estimate(truth, sketches.cms_update(items, WIDTH, ROWS), WIDTH, ROWS)
    return truth.join(got, "key").agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("estimate") < F.col("n"), 1)).alias("n_under"))


@query("SELECT p_partkey, CAST(pow(2, length(bin(p_partkey))) AS BIGINT) AS m, CAST(length(bin(p_partkey)) AS INT) AS b, 0.7213::DOUBLE / (1::DOUBLE + 1.079::DOUBLE / pow(2, length(bin(p_partkey)))) AS alpha FROM part WHERE p_partkey > 0")
def hll_params(spark, d):
    return sketches.hll_create(spark.read.parquet(f"{d}/part.parquet").where("p_partkey > 0").select("p_partkey"), F.col("p_partkey"))


@query(with_(KV, ALL_KEYS, MURMUR64, registers_sql(10)) + "SELECT reg, rank FROM registers")
def hll_registers(spark, d):
    return sketches.hll_add(kv_log(spark, d).select("key"), 1000)


@query(with_(KV, ALL_KEYS, MURMUR64, registers_sql(7)) + "SELECT (SELECT count(*) FROM keys) AS n_exact, CAST(floor(0.7213::DOUBLE / (1::DOUBLE + 1.079::DOUBLE / 128) * 128 * 128 / (coalesce(sum(pow(2::DOUBLE, -rank)), 0) + 128 - count(*))) AS BIGINT) AS estimate FROM registers")
def hll_estimate(spark, d):
    """Exact count, and the raw estimate from 128 registers."""
    keys = kv_log(spark, d).select("key")
    got = sketches.hll_count(sketches.hll_add(keys, 64), 64)
    return keys.agg(F.count_distinct("key").alias("n_exact")).join(F.broadcast(got)).select("n_exact", "estimate")


@query(with_(KV) + "SELECT count(DISTINCT key) AS n FROM kv")
def count_distinct_exact(spark, d):
    return kv_log(spark, d).agg(F.count_distinct("key").alias("n"))


STOP = ", ".join(f"'{w}'" for w in sketches.STOP_WORDS)
HASH64 = f"list_reduce(list_transform({BYTES.format('word')}, lambda b: b::UHUGEINT), lambda h, b: xor((h * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, b), 14695981039346656037::UHUGEINT)"
SIMHASH = f"""words AS (SELECT doc_id, word, count(*) AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+')) AS word FROM documents) WHERE word <> '' AND word NOT IN ({STOP}) GROUP BY 1, 2),
 kinds AS (SELECT word, {HASH64} AS h FROM (SELECT DISTINCT word FROM words)),
 signs AS (SELECT word, h >= 9223372036854775808::UHUGEINT AS neg, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN 18446744073709551616::UHUGEINT - h ELSE h END AS mag FROM kinds),
 bits AS (SELECT word, i, CASE WHEN i = 0 THEN neg ELSE (mag >> (63 - i)::UHUGEINT) % 2::UHUGEINT = 1 END AS bit FROM signs, (SELECT unnest(range(0, 64)) AS i)),
 prints AS (SELECT doc_id, string_agg(CASE WHEN s > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS fingerprint FROM (SELECT doc_id, i, sum(CASE WHEN bit THEN w ELSE -w END) AS s FROM words JOIN bits USING (word) GROUP BY 1, 2) GROUP BY doc_id)"""
ONE = "one AS (SELECT fingerprint, min(doc_id) AS doc_id FROM prints GROUP BY 1)"
DISTANCE = "len(list_filter(range(1, 65), lambda i: substr(a.fingerprint, i, 1) <> substr(b.fingerprint, i, 1)))"


def _prints(spark, d):
    return sketches.simhash(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


@query(with_(SIMHASH) + "SELECT doc_id, fingerprint FROM prints")
def simhash_docs(spark, d):
    return _prints(spark, d).select("doc_id", sketches.print_text(F.col("print")).alias("fingerprint"))


@query(with_(SIMHASH) + f"SELECT a.doc_id AS a_id, b.doc_id AS b_id, CAST({DISTANCE} AS INT) AS distance FROM prints a JOIN prints b ON b.doc_id = a.doc_id + 1")
def hamming_pairs(spark, d):
    prints = _prints(spark, d)
    a, b = prints.select(F.col("doc_id").alias("a_id"), F.col("print").alias("x")), prints.select(F.col("doc_id").alias("b_id"), F.col("print").alias("y"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", "b_id", sketches.hamming(F.col("x"), F.col("y")).alias("distance"))


@query(with_(SIMHASH, ONE) + f"SELECT a.doc_id AS a_id, b.doc_id AS b_id, CAST({DISTANCE} AS INT) AS distance FROM one a JOIN one b ON a.doc_id < b.doc_id WHERE {DISTANCE} <= 3")
def near_dup_docs(spark, d):
    return sketches.near_pairs(_prints(spark, d), 3)


@query(with_(SIMHASH, ONE) + "SELECT prints.doc_id, one.doc_id AS class_id FROM prints JOIN one USING (fingerprint)")
def near_dup_members(spark, d):
    """Documents of each class in near_dup_docs, which has the pairs between classes; those of one class are at distance 0."""
    return sketches.print_classes(_prints(spark, d))


# Hash functions, rate limits, request log


@query(f"SELECT p_partkey, {fnv_sql('p_name', '1a')} AS fnv1a, {fnv_sql('p_name', '1')} AS fnv1 FROM part")
def fnv_hashes(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    return parts.select("p_partkey", hashing.fnv1a_32(F.col("p_name")).alias("fnv1a"), hashing.fnv1_32(F.encode("p_name", "UTF-8")).alias("fnv1"))


UNIT = 20000
BUCKET = f"""e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 f(user_id, rn, tokens, last, ok) AS (SELECT user_id, 1::BIGINT, 2::BIGINT, ts, 1::BIGINT FROM e WHERE rn = 1
 UNION ALL SELECT g.user_id, g.rn, g.avail - CASE WHEN g.avail >= 1 THEN 1 ELSE 0 END, CASE WHEN g.add <> 0 THEN g.ts ELSE g.last END, g.ok + CASE WHEN g.avail >= 1 THEN 1 ELSE 0 END
 FROM (SELECT e.user_id, e.rn, e.ts, f.last, f.ok, ((epoch_us(e.ts) - epoch_us(f.last)) // 1000000) // {UNIT} AS add, least(3, f.tokens + ((epoch_us(e.ts) - epoch_us(f.last)) // 1000000) // {UNIT}) AS avail FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) g)"""


@query("WITH RECURSIVE " + BUCKET + " SELECT user_id, max(rn) AS n_requests, max(ok) AS n_allowed FROM f GROUP BY user_id")
def token_bucket(spark, d):
    return ratelimit.token_bucket(spark.read.parquet(f"{d}/events.parquet"), "user_id", rate=1, most=3, unit_seconds=UNIT)


@query("SELECT verdict, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM (SELECT strftime(ts, '%H:%M:%S') AS t, CASE WHEN event_type = 'error' THEN 'BLOCKED' ELSE 'ALLOWED' END AS verdict FROM events) GROUP BY verdict")
def request_summary(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    lines = events.select(F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(", 1, "), F.when(F.col("event_type") == "error", "BLOCKED").otherwise("ALLOWED")).alias("value"))
    return ratelimit.request_summary(ratelimit.parse_requests(lines))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
