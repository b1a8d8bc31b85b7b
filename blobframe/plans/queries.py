"""Driver queries of the store over the given tables, each with its DuckDB oracle.

The tables stand in for the store's data: documents are objects (256-byte chunks), conversations are objects with versions,
orders and lineitem are files, versions and manifests whose chunks are parts, suppliers are nodes, events are requests. What a
replica answers is simulated from hashes, alike in Spark and DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import CHUNK_SIZE, DEV_SECRET, HTTP_BUCKETS, PRESIGN_TTL_SECONDS, REPLICA_BUCKETS, Limiter, StoreConfig
from ..functions import chunking, hashing, presign
from ..operators import catalog, gc, metrics, ratelimit, replication, ring
from ..sources import objects
from . import service

SMALL = 256
NOW_MS = 1_700_000_000_000
NODES = tuple(f"node-{i}" for i in range(5))
REPLICAS, QUORUM = 3, 2
LIMIT = Limiter(capacity=3.0, refill_per_second=5e-6)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> DataFrame:
    return objects.from_text(objects.spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")), "doc_id", "text")


def doc_chunks(spark, sf_dir, size: int = SMALL) -> DataFrame:
    return chunking.chunk(docs(spark, sf_dir), size)


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp without time zone, whatever the session's zone."""
    t = F.col(ts)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds * 1000 + F.floor(F.expr(f"extract(second from {ts})") * 1000).cast("bigint")


def five_nodes(spark) -> DataFrame:
    return spark.createDataFrame([(n, f"http://{n}", i) for i, n in enumerate(NODES)], "node_id string, url string, add_order int")


def placed_chunks(spark, sf_dir) -> DataFrame:
    keys = doc_chunks(spark, sf_dir).groupBy("chunk_hash").agg(F.max("chunk_size").alias("chunk_size"))
    return ring.place(keys, ring.arcs(five_nodes(spark), REPLICAS))


CHUNKED = """objs as (select 'file_' || doc_id as file_id, encode(text) as d from documents where text is not null),
cut as (select file_id, d, unnest(range(0, ((octet_length(d) + {n} - 1) // {n})::bigint))::int as seq from objs),
chunks as (select file_id, seq, sha256(d[seq::bigint * {n} + 1 : seq::bigint * {n} + {n}]) as chunk_hash, octet_length(d[seq::bigint * {n} + 1 : seq::bigint * {n} + {n}])::int as chunk_size from cut)"""
C256 = CHUNKED.format(n=SMALL)
POS = "('0x' || substr(sha1({k}), 1, 8))::ubigint::bigint"
FIVE = "nodes as (select 'node-' || i as node_id, i as add_order from range(0, 5) t(i))"
POINTS = f"points as (select {POS.format(k="node_id || '#vnode' || v")} as position, node_id, add_order, v as vnode from nodes, range(0, 100) r(v))"


def placement_sql(keys: str, n: int = REPLICAS) -> str:
    """placed(chunk_hash, rank, node_id) from keys(chunk_hash), by the least distance clockwise of each node."""
    return f"""kp as (select chunk_hash, {POS.format(k="chunk_hash")} as kpos from ({keys})),
near as (select chunk_hash, node_id, add_order, min((position - kpos + 4294967296) % 4294967296) as dist from kp, points group by all),
placed as (select chunk_hash, (row_number() over (partition by chunk_hash order by dist, add_order) - 1)::int as rank, node_id from near qualify rank < {n})"""


@query(f"with {C256} select file_id, seq, chunk_hash, chunk_size from chunks")
def chunk_manifest(spark, sf_dir):
    return doc_chunks(spark, sf_dir)


@query(f"with {CHUNKED.format(n=CHUNK_SIZE)} select file_id, seq, chunk_hash, chunk_size from chunks")
def default_chunk_manifest(spark, sf_dir):
    return doc_chunks(spark, sf_dir, CHUNK_SIZE)


SAVINGS = """sum(s * n)::bigint as total_bytes, sum(s)::bigint as unique_bytes, sum(n)::bigint as chunk_rows, count(*) as unique_chunks,
(sum(s * n) - sum(s))::bigint as saved_bytes, round((sum(s * n) - sum(s)) * 100.0 / sum(s * n), 1) as saved_pct"""


@query(f"with {C256}, per as (select chunk_hash, count(*) as n, max(chunk_size) as s from chunks group by 1) select {SAVINGS} from per")
def dedup_savings(spark, sf_dir):
    return catalog.dedup_savings(doc_chunks(spark, sf_dir))


@query(f"with {C256}, per as (select source, chunk_hash, count(*) as n, max(chunk_size) as s from chunks join documents on file_id = 'file_' || doc_id group by 1, 2) select source, {SAVINGS} from per group by 1")
def dedup_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    # the source travels with the object, so no join brings it back
    rows = d.select(F.struct("doc_id", "source").alias("file_id"), F.encode("text", "UTF-8").alias("data"))
    return catalog.dedup_savings(chunking.chunk(rows, SMALL).withColumn("source", F.col("file_id.source")), "source")


@query(f"with {C256} select chunk_hash, count(*) as refcount from chunks group by 1")
def refcounts(spark, sf_dir):
    return catalog.refcounts(doc_chunks(spark, sf_dir))


@query(f"with {C256} select chunk_hash, count(*) as refcount, count(distinct file_id) as files from chunks group by 1 having count(distinct file_id) > 1")
def shared_chunks(spark, sf_dir):
    per = doc_chunks(spark, sf_dir).groupBy("chunk_hash", "file_id").agg(F.count("*").alias("n"))
    return per.groupBy("chunk_hash").agg(F.sum("n").alias("refcount"), F.count("*").alias("files")).where("files > 1")


@query(f"with {C256}, got as (select file_id, count(*) as chunk_count, sum(chunk_size)::bigint as size from chunks group by 1) select file_id, chunk_count, size from got")
def manifest_rollup(spark, sf_dir):
    return doc_chunks(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("chunk_count"), F.sum("chunk_size").alias("size"))


def conversation_versions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select(
        F.concat(F.lit("ver_"), "conv_id", F.lit("_"), "turn").alias("version_id"), F.concat(F.lit("file_"), "conv_id").alias("file_id"),
        F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"), (F.lit(NOW_MS) + F.col("turn") * 1000).alias("created_at"), F.encode("text", "UTF-8").alias("data"),
    )


VERS = f"""vers as (select 'ver_' || conv_id || '_' || turn as version_id, 'file_' || conv_id as file_id, octet_length(encode(text))::bigint as size,
{NOW_MS} + turn * 1000 as created_at, encode(text) as d from conversations where text is not null)"""


@query(f"with {VERS}, n as (select file_id, version_id, size, created_at, row_number() over (partition by file_id order by created_at, version_id)::int as version_no, count(*) over (partition by file_id) as k from vers) select file_id, version_id, size, created_at, version_no, version_no = k as is_current from n")
def version_history(spark, sf_dir):
    return catalog.history(conversation_versions(spark, sf_dir).drop("data"))


@query(f"with {VERS} select file_id, arg_max(version_id, created_at) as current_version_id from vers group by 1")
def current_version(spark, sf_dir):
    return catalog.current_versions(conversation_versions(spark, sf_dir), F.col("created_at"))


@query(f"with {VERS}, cur as (select file_id, arg_max(version_id, created_at) as version_id from vers group by 1) select v.file_id, v.version_id, v.size, v.created_at from vers v join cur using (version_id)")
def live_versions(spark, sf_dir):
    v = conversation_versions(spark, sf_dir).drop("data")
    current = catalog.current_versions(v, F.col("created_at")).select(F.col("current_version_id").alias("version_id"))
    return v.join(current, "version_id", "left_semi").select("file_id", "version_id", "size", "created_at")


@query(f"with {VERS} select file_id, min(created_at) as created_at, arg_max(version_id, created_at) as current_version_id, string_agg(version_id || ':' || size, ',' order by created_at) as versions, count(*) as version_count from vers group by 1")
def file_metadata(spark, sf_dir):
    v = conversation_versions(spark, sf_dir).drop("data")
    rows = v.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "version_id", "size"))).alias("v"))
    text = F.array_join(F.transform("v", lambda x: F.concat(x["version_id"], F.lit(":"), x["size"].cast("string"))), ",")
    return rows.select("file_id", F.col("v")[0]["created_at"].alias("created_at"), F.element_at("v", -1)["version_id"].alias("current_version_id"), text.alias("versions"), F.size("v").cast("long").alias("version_count"))


CONV = f"""{VERS}, cut as (select version_id, file_id, created_at, d, unnest(range(0, ((octet_length(d) + 63) // 64)::bigint)) as seq from vers),
man as (select version_id, file_id, created_at, sha256(d[seq * 64 + 1 : seq * 64 + 64]) as chunk_hash from cut),
cur as (select file_id, arg_max(version_id, created_at) as version_id from vers group by 1)"""


@query(f"with {CONV} select distinct chunk_hash from man where chunk_hash not in (select chunk_hash from man where version_id in (select version_id from cur))")
def conversation_orphans(spark, sf_dir):
    v = conversation_versions(spark, sf_dir)
    m = chunking.chunk(v, 64, key="version_id")
    return catalog.orphans(m, catalog.live_manifest(m, catalog.current_versions(v, F.col("created_at"))))


@query(f"with {CONV}, gone as (select chunk_hash, count(*) as k from man where version_id not in (select version_id from cur) group by 1), al as (select chunk_hash, count(*) as n from man group by 1) select chunk_hash, n - coalesce(k, 0) as refcount from al left join gone using (chunk_hash)")
def supersede_refcounts(spark, sf_dir):
    v = conversation_versions(spark, sf_dir)
    m = chunking.chunk(v, 64, key="version_id")
    old = catalog.history(v.drop("data")).where("not is_current")
    return catalog.delete_versions(v.drop("data"), m, catalog.refcounts(m), old)[2]


def order_store(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(current, manifest) of the store in which a customer is a file, an order a version and a part a chunk."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("version_id"), "o_orderdate")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("chunk_hash"))
    return catalog.current_versions(o, F.col("o_orderdate")), m


STORE = "cur as (select o_custkey as file_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as version_id from orders group by 1), man as (select l_orderkey as version_id, l_partkey as chunk_hash from lineitem)"


@query(f"with {STORE} select distinct chunk_hash from man where chunk_hash not in (select chunk_hash from man where version_id in (select version_id from cur))")
def orphans(spark, sf_dir):
    current, m = order_store(spark, sf_dir)
    return catalog.orphans(m, catalog.live_manifest(m, current))


@query(f"with {STORE}, o as (select o_custkey as file_id, chunk_hash, version_id in (select version_id from cur) as live from man join orders on version_id = o_orderkey) select distinct chunk_hash from (select file_id, chunk_hash from o where not live except select file_id, chunk_hash from o where live)")
def orphans_naive_diff(spark, sf_dir):
    current, m = order_store(spark, sf_dir)
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("file_id"))
    rows = m.join(files, "version_id").join(current.select(F.col("current_version_id").alias("version_id"), F.lit(True).alias("live")), "version_id", "left")
    return catalog.dropped_by_file(rows.where("live is null"), rows.where("live"))


@query("select doc_id, sha256(encode(text)) as digest, true as intact from documents where octet_length(encode(text)) > 0")
def reassemble_digest(spark, sf_dir):
    cut = chunking.chunk(docs(spark, sf_dir), SMALL, keep_data=True)
    # each distinct chunk once, as a store holds it
    store = cut.groupBy("chunk_hash").agg(F.first("data").alias("data"))
    whole = chunking.reassemble(cut.select("file_id", "seq", "chunk_hash"), store)
    return whole.select(F.substring("file_id", 6, 30).cast("long").alias("doc_id"), F.sha2("data", 256).alias("digest"), (F.col("missing") == 0).alias("intact"))


LOST = "('0x' || substr(sha1(chunk_hash), 1, 2))::int < 16"


@query(f"with {C256} select file_id, seq, chunk_hash from chunks where {LOST}")
def missing_chunks(spark, sf_dir):
    m = doc_chunks(spark, sf_dir)
    held = m.select("chunk_hash").distinct().where(hashing.hash_byte(F.col("chunk_hash"), 0) >= 16)
    return m.join(held, "chunk_hash", "left_anti").select("file_id", "seq", "chunk_hash")


@query(f"with {C256} select file_id, count(*) filter (where {LOST}) as missing, arg_min(chunk_hash, seq) filter (where {LOST}) as first_missing from chunks group by 1")
def first_missing(spark, sf_dir):
    cut = chunking.chunk(docs(spark, sf_dir), SMALL, keep_data=True)
    store = cut.where(hashing.hash_byte(F.col("chunk_hash"), 0) >= 16).groupBy("chunk_hash").agg(F.first("data").alias("data"))
    return chunking.reassemble(cut.select("file_id", "seq", "chunk_hash"), store).select("file_id", "missing", "first_missing")


@query(f"with {FIVE}, {POINTS} select position, node_id, add_order::int as add_order, vnode::int as vnode from points")
def ring_points(spark, sf_dir):
    return ring.points(five_nodes(spark))


@query(f"with {C256}, {FIVE}, {POINTS}, {placement_sql('select distinct chunk_hash from chunks')} select chunk_hash, rank, node_id from placed")
def placement(spark, sf_dir):
    return ring.ranked(placed_chunks(spark, sf_dir))


SUPPLIERS = "nodes as (select 'node-' || s_suppkey as node_id, s_suppkey as add_order from supplier)"


def supplier_nodes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("node-"), "s_suppkey").alias("node_id"), F.col("s_suppkey").cast("int").alias("add_order"))


@query(f"with {SUPPLIERS}, {POINTS}, {placement_sql('select distinct sha256(encode(text)) as chunk_hash from documents where text is not null')} select chunk_hash, rank, node_id from placed")
def placement_at_scale(spark, sf_dir):
    keys = docs(spark, sf_dir).select(hashing.sha256_hex(F.col("data")).alias("chunk_hash")).distinct()
    return ring.ranked(ring.place(keys, ring.arcs(supplier_nodes(spark, sf_dir), REPLICAS)))


@query(f"with {C256}, {FIVE}, {POINTS}, {placement_sql('select distinct chunk_hash from chunks', 1)} select node_id, count(*) as owned from placed group by 1")
def ring_balance(spark, sf_dir):
    return ring.ranked(placed_chunks(spark, sf_dir)).where("rank = 0").groupBy("node_id").agg(F.count("*").alias("owned"))


@query(f"""with {C256}, {FIVE}, {POINTS}, kp as (select chunk_hash, {POS.format(k="chunk_hash")} as kpos from (select distinct chunk_hash from chunks)),
near as (select chunk_hash, node_id, add_order, min((position - kpos + 4294967296) % 4294967296) as dist from kp, points group by all),
b as (select chunk_hash, node_id from near qualify row_number() over (partition by chunk_hash order by dist, add_order) = 1),
a as (select chunk_hash, node_id from near where node_id <> 'node-1' qualify row_number() over (partition by chunk_hash order by dist, add_order) = 1)
select b.node_id as old_owner, a.node_id as new_owner, count(*) as moved from b join a using (chunk_hash) where b.node_id <> a.node_id group by 1, 2""")
def ring_movement(spark, sf_dir):
    nodes = five_nodes(spark)
    keys = doc_chunks(spark, sf_dir).select("chunk_hash").distinct()
    after = ring.remove_nodes(nodes, nodes.where("node_id = 'node-1'"))
    moved = ring.movement(ring.place(keys, ring.arcs(nodes, 1)), ring.place(keys, ring.arcs(after, 1)))
    return moved.groupBy("old_owner", "new_owner").agg(F.count("*").alias("moved"))


@query(f"with {C256}, {FIVE}, {POINTS}, {placement_sql('select distinct chunk_hash from chunks')}, s as (select chunk_hash, max(chunk_size) as z from chunks group by 1) select node_id, count(*) as chunk_count, sum(z)::bigint as total_bytes from placed join s using (chunk_hash) group by 1")
def node_load(spark, sf_dir):
    placed = placed_chunks(spark, sf_dir).select("chunk_size", F.explode("nodes").alias("node_id"))
    return placed.groupBy("node_id").agg(F.count("*").alias("chunk_count"), F.sum("chunk_size").alias("total_bytes"))


@query(f"select count(*) as nodes, count(*) * 100 as points from supplier")
def ring_size(spark, sf_dir):
    nodes = supplier_nodes(spark, sf_dir)
    return nodes.agg(F.count_distinct("node_id").alias("nodes")).select("nodes", (F.col("nodes") * 100).alias("points"))


def state(chunk: str = "chunk_hash", node: str = "node_id") -> tuple[Column, Column]:
    key = F.concat(chunk, node)
    return hashing.hash_byte(key, 0), hashing.hash_byte(key, 1)


def attempts(spark, sf_dir) -> DataFrame:
    """Simulated replies of all replicas of all chunks, in place of a network."""
    rows = placed_chunks(spark, sf_dir).select("chunk_hash", "chunk_size", F.posexplode("nodes").alias("rank", "node_id"))
    a, b = state()
    status = F.when(a < 20, None).when(a < 40, 404).when(a < 56, 409).when(a < 60, 503).otherwise(200)
    outcome = replication.status_outcome(status, body_ok=a >= 68, latency_ms=b * 12.0)
    return rows.withColumn("outcome", outcome).withColumn("deduped", b % 2 == 0).withColumn("latency_s", b / 1000.0)


ATT = f"""{C256}, {FIVE}, {POINTS}, {placement_sql('select distinct chunk_hash from chunks')},
raw as (select chunk_hash, rank, node_id, ('0x' || substr(sha1(chunk_hash || node_id), 1, 2))::int as a, ('0x' || substr(sha1(chunk_hash || node_id), 3, 2))::int as b from placed),
att as (select *, case when a < 20 or b * 12.0 > 3000 then 'network_error' when a < 40 then 'not_found' when a < 56 then 'corrupt' when a < 60 then 'http_503' when a < 68 then 'integrity_mismatch' else 'ok' end as outcome, b % 2 = 0 as deduped from raw),
size as (select chunk_hash, max(chunk_size) as z from chunks group by 1)"""
QUO = f"""quo as (select chunk_hash, count(*) filter (where outcome = 'ok') as acks, count(*) as of, coalesce(bool_and(deduped) filter (where outcome = 'ok'), true) as dd, max(z) as z from att join size using (chunk_hash) group by 1)"""


@query(f"with {ATT}, {QUO} select chunk_hash, acks, \"of\", acks >= 2 as quorum_met, acks >= 2 and dd as deduped, case when acks >= 2 and dd then z else 0 end::bigint as saved_bytes, case when acks < 2 then 'quorum ' || acks || '/2' end as error from quo")
def quorum_writes(spark, sf_dir):
    return replication.quorum(attempts(spark, sf_dir), QUORUM)


@query(f"with {ATT}, {QUO}, m as (select file_id, seq, acks >= 2 as met from chunks join quo using (chunk_hash)), f as (select file_id, min(seq) filter (where not met) as abort_seq, count(*) as chunks from m group by 1) select file_id, abort_seq, chunks, coalesce(abort_seq + 1, chunks)::bigint as attempted, abort_seq is null as committed from f")
def upload_abort_point(spark, sf_dir):
    return replication.upload_abort(doc_chunks(spark, sf_dir), replication.quorum(attempts(spark, sf_dir), QUORUM))


@query(f"with {ATT}, f as (select chunk_hash, min(rank) filter (where outcome = 'ok') as r, arg_max(outcome, rank) as last from att group by 1) select f.chunk_hash, case when r is not null then 'ok' when last = 'not_found' then 'missing' else 'unavailable' end as result, a.node_id as served_by, r as served_rank from f left join att a on a.chunk_hash = f.chunk_hash and a.rank = f.r")
def read_failover(spark, sf_dir):
    return replication.read_results(attempts(spark, sf_dir))


@query(f"""with {ATT}, f as (select chunk_hash, min(rank) filter (where outcome = 'ok') as r from att group by 1),
seen as (select case when outcome = 'ok' and rank > 0 then 'failover_success' when outcome = 'ok' then null when outcome = 'not_found' and rank = 0 then null else outcome end as reason from att join f using (chunk_hash) where r is null or rank <= r)
select reason, count(*) as failovers, count(*) filter (where reason = 'integrity_mismatch') as integrity_failures from seen where reason is not null group by 1""")
def failover_metrics(spark, sf_dir):
    return replication.failovers(attempts(spark, sf_dir))


@query(f"""with {C256}, s as (select distinct chunk_hash, ('0x' || substr(sha1(chunk_hash), 5, 2))::int as k from chunks),
t as (select case when k < 8 then 422 when k < 90 then 200 else 201 end as put_status, case when k >= 90 then 404 when k < 8 then 409 else 200 end as get_status from s) select put_status, get_status, count(*) as chunks from t group by 1, 2""")
def node_replies(spark, sf_dir):
    k = hashing.hash_byte(F.col("chunk_hash"), 2)
    rows = doc_chunks(spark, sf_dir).select("chunk_hash").distinct()
    rows = rows.select(replication.put_status(k >= 8, k < 90).alias("put_status"), replication.get_status(k < 90, k >= 8).alias("get_status"))
    return rows.groupBy("put_status", "get_status").agg(F.count("*").alias("chunks"))


def order_sweep(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(reference counts over all versions, swept orphans); node-3 and node-4 cannot be reached."""
    current, m = order_store(spark, sf_dir)
    m = m.withColumn("chunk_hash", F.sha2(F.col("chunk_hash").cast("string"), 256))
    live = catalog.live_manifest(m, current)
    counts = catalog.add_refcounts(catalog.refcounts(m), m.join(live.select("version_id").distinct(), "version_id", "left_anti"), -1)
    nodes = five_nodes(spark)
    gone = counts.where("refcount <= 0").select("chunk_hash")
    placed = ring.ranked(ring.place(gone, ring.arcs(nodes, 2))).select("chunk_hash", "node_id")
    sizes = table(spark, sf_dir, "part").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("chunk_hash"), F.col("p_size").alias("chunk_size"))
    return counts, gc.sweep(gone, placed, nodes.where("add_order < 3"), sizes)


SWEEP = f"""{STORE}, m as (select version_id, sha256(chunk_hash::varchar) as chunk_hash from man),
counts as (select chunk_hash, count(*) filter (where version_id in (select version_id from cur)) as refcount from m group by 1),
{FIVE}, {POINTS}, {placement_sql('select chunk_hash from counts where refcount <= 0', 2)},
swept as (select chunk_hash, count(*) filter (where node_id in ('node-0', 'node-1', 'node-2')) as reached from placed group by 1),
sized as (select chunk_hash, reached, reached > 0 as reclaimed, p_size as chunk_size from swept left join part on sha256(p_partkey::varchar) = chunk_hash)"""


@query(f"with {SWEEP} select count(*) as scanned, count(*) filter (where reclaimed) as reclaimed_chunks, count(*) filter (where reclaimed) * {CHUNK_SIZE} as reclaimed_bytes_hint, coalesce(sum(chunk_size) filter (where reclaimed), 0)::bigint as reclaimed_bytes_exact from sized")
def gc_sweep(spark, sf_dir):
    return gc.summary(order_sweep(spark, sf_dir)[1])


@query(f"with {SWEEP} select chunk_hash, refcount from counts where refcount > 0")
def gc_next_state(spark, sf_dir):
    counts, swept = order_sweep(spark, sf_dir)
    return gc.next_counts(counts, swept)


def hmac_sql(message: str) -> str:
    inner, outer = ("'" + "".join(f"\\x{b:02X}" for b in p) + "'::blob" for p in hashing.hmac_pads(DEV_SECRET))
    return f"sha256({outer} || unhex(sha256({inner} || encode({message}))))"


EXPIRES = f"({NOW_MS} + doc_id * 1000 + {PRESIGN_TTL_SECONDS * 1000})"
PATH = "'/files/' || doc_id || '/download-presigned'"


@query(f"with s as (select doc_id, {PATH} as p, {EXPIRES}::bigint as e from documents), g as (select *, {hmac_sql("'GET:' || p || ':' || e")} as sig from s) select doc_id, p || '?expires=' || e || '&sig=' || sig as url, e as expires_at, sig as signature from g")
def presign_urls(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    path = F.concat(F.lit("/files/"), "doc_id", F.lit("/download-presigned"))
    return d.select("doc_id", presign.presign(F.lit("GET"), path, F.lit(NOW_MS) + F.col("doc_id") * 1000).alias("s")).select("doc_id", "s.*")


@query("select doc_id, case doc_id % 8 when 1 then 'expired' when 2 then 'missing' when 3 then 'malformed' when 4 then 'tampered' when 6 then 'tampered' when 7 then 'missing' else 'ok' end as verdict from documents")
def presign_verify(spark, sf_dir):
    made = presign_urls(spark, sf_dir).withColumn("k", F.col("doc_id") % 8)
    expires = F.when(F.col("k") == 2, "").when(F.col("k") == 3, "soon").otherwise(F.col("expires_at").cast("string"))
    sig = F.when(F.col("k") == 4, F.concat(F.substring("signature", 1, 60), F.lit("zzzz"))).when(F.col("k") == 5, F.upper("signature")).when(F.col("k") != 7, F.col("signature"))
    # method bound at 6; one millisecond late at 1; exactly at the expiry, still valid, elsewhere
    method = F.when(F.col("k") == 6, "DELETE").otherwise("GET")
    now = F.col("expires_at") + F.when(F.col("k") == 1, 1).otherwise(0)
    path = F.concat(F.lit("/files/"), "doc_id", F.lit("/download-presigned"))
    return made.select("doc_id", presign.verify(method, path, expires, sig, now).alias("verdict"))


def requests(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = hashing.hash_byte(F.col("event_id").cast("string"), 0)
    return e.select(
        F.col("user_id").cast("string").alias("client"), epoch_ms("ts").alias("ts_ms"), F.col("event_id").alias("request_id"), F.col("event_type").alias("route"),
        (F.col("value") / 100).alias("latency_s"), F.when(k < 200, 200).when(k < 220, 201).when(k < 245, 429).otherwise(503).alias("status"),
    )


REQ = """req as (select user_id::varchar as client, epoch_us(ts) // 1000 as ts_ms, event_id as request_id, event_type as route, value / 100 as latency_s,
('0x' || substr(sha1(event_id::varchar), 1, 2))::int as k from events), log as (select *, case when k < 200 then 200 when k < 220 then 201 when k < 245 then 429 else 503 end as status from req)"""
BUCKET = f"""with recursive {REQ}, o as (select client, ts_ms, request_id, row_number() over (partition by client order by ts_ms, request_id) as n from req),
s as (select client, request_id, n, ts_ms, true as allowed, {LIMIT.capacity}::double - 1 as tokens from o where n = 1 union all
select o.client, o.request_id, o.n, o.ts_ms, t.v >= 1, case when t.v >= 1 then t.v - 1 else t.v end from s join o on o.client = s.client and o.n = s.n + 1,
lateral (select case when o.ts_ms > s.ts_ms then least({LIMIT.capacity}::double, s.tokens + (o.ts_ms - s.ts_ms)::double / 1000.0::double * {LIMIT.refill_per_second}::double) else s.tokens end as v) t)"""


@query(f"{BUCKET} select client, ts_ms, request_id, allowed from (select s.client, s.ts_ms, s.request_id, s.allowed from s)")
def rate_limit_verdicts(spark, sf_dir):
    return ratelimit.verdicts(requests(spark, sf_dir), LIMIT)


@query(f"{BUCKET} select client, count(*) as requests, count(*) filter (where not allowed) as rejected from s group by 1")
def rate_limit_by_client(spark, sf_dir):
    v = ratelimit.verdicts(requests(spark, sf_dir), LIMIT)
    return v.groupBy("client").agg(F.count("*").alias("requests"), F.count_if(~F.col("allowed")).alias("rejected"))


@query("select count(distinct user_id) as clients from events")
def limiter_size(spark, sf_dir):
    return requests(spark, sf_dir).agg(F.count_distinct("client").alias("clients"))


def histogram_sql(src: str, value: str, bounds, labels: str) -> str:
    cells = " union all ".join(f"select {labels}, '{metrics.le_text(b)}' as le, count(*) filter (where {value} <= {b}) as bucket_count from {src} group by all" for b in bounds)
    return f"{cells} union all select {labels}, '+Inf' as le, count({value}) as bucket_count from {src} group by all"


@query(f"with {REQ} {histogram_sql('log', 'latency_s', HTTP_BUCKETS, 'route, status')}")
def http_histogram(spark, sf_dir):
    return metrics.histogram(requests(spark, sf_dir), "latency_s", HTTP_BUCKETS, "route", "status").drop("le_value")


@query(f"with {REQ} select route, status, count(latency_s) as n, round(sum(latency_s), 4) as total from log group by 1, 2")
def http_histogram_sums(spark, sf_dir):
    return metrics.histogram_sums(requests(spark, sf_dir), "latency_s", "route", "status").withColumn("total", F.round("total", 4))


@query(f"with {ATT}, lat as (select node_id, case when outcome = 'ok' then 'success' else 'error' end as outcome, b / 1000.0 as latency_s from att) {histogram_sql('lat', 'latency_s', REPLICA_BUCKETS, 'node_id, outcome')}")
def replica_latency_histogram(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("outcome", F.when(F.col("outcome") == "ok", "success").otherwise("error"))
    return metrics.histogram(a, "latency_s", REPLICA_BUCKETS, "node_id", "outcome").drop("le_value")


@query(f"with {REQ}, l as (select route, list_sort(list(latency_s)) as v from log group by 1) select route, p::int as p, v[least(len(v) - 1, floor(p / 100.0 * len(v)))::bigint + 1] as value, len(v) as n from l, (values (50), (90), (99), (100)) t(p)")
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(requests(spark, sf_dir), "latency_s", (50, 90, 99, 100), "route")


BOUNDS = ", ".join(f"({i}, {b})" for i, b in enumerate(HTTP_BUCKETS))


@query(f"""with {REQ}, b as (select route, i, le, count(*) filter (where latency_s <= le) as c from log, (values {BOUNDS}) t(i, le) group by 1, 2, 3),
n as (select route, count(*) as n from log group by 1), w as (select b.*, n, lag(le, 1, 0.0) over (partition by route order by i) as lo, lag(c, 1, 0) over (partition by route order by i) as below from b join n using (route)),
h as (select route, min_by(lo::double + (le::double - lo::double) * (0.99::double * n - below) / (c - below), i) as q from w where c >= 0.99::double * n group by 1)
select n.route, round(coalesce(q, {max(HTTP_BUCKETS)}), 4) as p99 from n left join h using (route)""")
def histogram_p99(spark, sf_dir):
    cells = metrics.histogram(requests(spark, sf_dir), "latency_s", HTTP_BUCKETS, "route")
    return metrics.histogram_quantile(cells, 0.99, "route").select("route", F.round("quantile", 4).alias("p99"))


@query(f"with {REQ} select route, (ts_ms // 300000 * 300)::bigint as window_start, count(*) as events, count(*) / 300.0::double as rate from log group by 1, 2")
def request_rate_5m(spark, sf_dir):
    return metrics.window_rate(requests(spark, sf_dir), "ts_ms", 300, "route")


@query(f"with {REQ} select status, (ts_ms // 300000 * 300)::bigint as window_start, count(*) as events, count(*) / 300.0::double as rate from log where status not in (200, 201) group by 1, 2")
def error_rate_5m(spark, sf_dir):
    return metrics.window_rate(requests(spark, sf_dir), "ts_ms", 300, "status", where=~F.col("status").isin(200, 201))


@query(f"with {REQ} select count(*) filter (where status in (200, 201)) as completed, count(*) filter (where status = 429) as limited, count(*) filter (where status = 503) as other, round(count(*) filter (where status in (200, 201)) / 8.0, 2) as per_second from log")
def load_summary(spark, sf_dir):
    return metrics.load_summary(requests(spark, sf_dir), "status", 8.0)


@query(f"""with {ATT}, {QUO}, seen as (select outcome, rank, min(rank) filter (where outcome = 'ok') over (partition by chunk_hash) as r from att)
select 'dedup_bytes_saved' as metric, sum(case when acks >= 2 and dd then z else 0 end)::bigint as value from quo union all
select 'quorum_write_failures', count(*) filter (where acks < 2) from quo union all
select 'integrity_failures', count(*) filter (where outcome = 'integrity_mismatch' and (r is null or rank < r)) from seen""")
def cumulative_stats(spark, sf_dir):
    a = attempts(spark, sf_dir)
    q = replication.quorum(a, QUORUM).agg(F.sum("saved_bytes").alias("s"), F.count_if(~F.col("quorum_met")).alias("f"))
    rows = F.array(F.struct(F.lit("dedup_bytes_saved").alias("metric"), F.col("s").alias("value")), F.struct(F.lit("quorum_write_failures").alias("metric"), F.col("f").alias("value")))
    failed = replication.failovers(a).agg(F.coalesce(F.sum("integrity_failures"), F.lit(0)).alias("value"))
    return q.select(F.inline(rows)).unionByName(failed.select(F.lit("integrity_failures").alias("metric"), "value"))


@query("select route || ' ' || n as line from (select 'requests_total{route=\"' || event_type || '\"}' as route, count(*) as n from events group by event_type)")
def metrics_text(spark, sf_dir):
    n = requests(spark, sf_dir).groupBy("route").agg(F.count("*").alias("value"))
    return metrics.exposition(n.select(F.lit("requests_total").alias("metric"), F.create_map(F.lit("route"), F.col("route")).alias("labels"), "value"))


@query(f"""with {VERS}, cur as (select file_id, arg_max(version_id, created_at) as version_id from vers group by 1)
select file_id, 200 as status, sha256(d) as digest, octet_length(d)::bigint as size from cur join vers using (file_id, version_id)""")
def download(spark, sf_dir):
    v = conversation_versions(spark, sf_dir)
    cut = chunking.chunk(v, 64, key="version_id", keep_data=True)
    files = catalog.current_versions(v, F.col("created_at")).withColumn("created_at", F.lit(NOW_MS).cast("long"))
    store = cut.groupBy("chunk_hash").agg(F.first("data").alias("data"))
    got = service.download(service.Tables(files, v.drop("data"), cut.select("version_id", "seq", "chunk_hash"), store), files)
    return got.select("file_id", "status", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("size"))


@query("select doc_id, case when octet_length(encode(text)) > 2000 then 413 else 201 end as status from documents where text is not null")
def body_limit_split(spark, sf_dir):
    return objects.body_split(docs(spark, sf_dir), 2000).select(F.substring("file_id", 6, 30).cast("long").alias("doc_id"), "status")


@query("select doc_id, case doc_id % 4 when 0 then true when 1 then false when 2 then false else doc_id % 8 = 3 end as valid from documents")
def hash_validity(spark, sf_dir):
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    k = F.col("doc_id") % 8
    text = F.when(k % 4 == 0, h).when(k % 4 == 1, F.concat(F.lit("X"), F.substring(h, 2, 63))).when(k % 4 == 2, F.substring(h, 1, 63)).when(k == 3, h).otherwise(F.concat(h, F.lit("0")))
    return table(spark, sf_dir, "documents").select("doc_id", hashing.is_chunk_hash(text).alias("valid"))


@query(f"with {C256} select distinct chunk_hash, substr(chunk_hash, 1, 2) || '/' || substr(chunk_hash, 3, 2) || '/' || chunk_hash as path from chunks")
def path_shard(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("chunk_hash").distinct().select("chunk_hash", hashing.chunk_path(F.col("chunk_hash")).alias("path"))


@query("select * from (select 'orders_without_customer' as audit, count(*) as violations from orders where o_custkey not in (select c_custkey from customer) union all select 'lineitem_without_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'customers_without_version', count(*) from customer where c_custkey not in (select o_custkey from orders))")
def fk_audit(spark, sf_dir):
    o, m, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")

    def audit(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("audit"), "violations")

    return (
        audit("orders_without_customer", o.join(c, o.o_custkey == c.c_custkey, "left_anti"))
        .unionByName(audit("lineitem_without_order", m.join(o, m.l_orderkey == o.o_orderkey, "left_anti")))
        .unionByName(audit("customers_without_version", c.join(o, o.o_custkey == c.c_custkey, "left_anti")))
    )


@query("select 'node-' || i as node_id, 'http://127.0.0.1:410' || i as url, i::int as add_order from range(0, 3) t(i)")
def topology(spark, sf_dir):
    return objects.topology(spark)


PAGES = "objs as (select page_id, encode(html) as d from pages where html is not null), cut as (select page_id, d, unnest(range(0, ((octet_length(d) + 1023) // 1024)::bigint)) as seq from objs)"


@query(f"with {PAGES}, held as (select distinct sha256(d[seq * 1024 + 1 : seq * 1024 + 1024]) as h from cut where page_id % 2 = 0) select distinct sha256(d[seq * 1024 + 1 : seq * 1024 + 1024]) as chunk_hash from cut where sha256(d[seq * 1024 + 1 : seq * 1024 + 1024]) not in (select h from held)")
def store_put_new(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("html is not null")
    cut = chunking.chunk(objects.from_text(p, "page_id", "html").withColumn("file_id", F.substring("file_id", 6, 30).cast("long")), 1024, keep_data=True)
    return catalog.store_put(cut.where("file_id % 2 = 0").select("chunk_hash").distinct(), cut).select("chunk_hash")


EMPTY_TABLES = {"files": schemas.FILES, "versions": schemas.VERSIONS, "manifest": schemas.MANIFEST, "store": "chunk_hash string, data binary"}


def uploaded(spark, sf_dir, where: str = "true", limit: int = 2000) -> tuple[service.Tables, DataFrame]:
    """(tables, replies) after the upload of documents into an empty store; bodies over `limit` bytes are refused."""
    empty = service.Tables(**{k: spark.createDataFrame([], s) for k, s in EMPTY_TABLES.items()})
    bodies = table(spark, sf_dir, "documents").where(where).select(F.col("doc_id").alias("request_id"), F.encode("text", "UTF-8").alias("data"))
    return service.upload(empty, bodies, NOW_MS, StoreConfig(chunk_size=SMALL), limit)


FILE_ID = f"'file_' || substr(sha256(doc_id || '/{NOW_MS}'), 1, 24)"


def upload_sql(where: str = "true", limit: int = 2000, body: str = "text", now: int = NOW_MS) -> str:
    """up(request_id, d, status, file_id, version_id, size) of the uploaded documents."""
    return f"""raw as (select doc_id as request_id, encode({body}) as d, {FILE_ID} as file_id from documents where {where}),
up as (select *, case when d is null then 400 when octet_length(d) > {limit} then 413 else 201 end as status,
'ver_' || substr(sha256(file_id || '/{now}/' || sha256(d)), 1, 24) as version_id, octet_length(d)::bigint as size from raw)"""


@query(f"with {upload_sql()} select request_id, status, case when status = 201 then file_id end as file_id, case when status = 201 then version_id end as version_id, case when status = 201 then (size + {SMALL} - 1) // {SMALL} end as chunk_count, case when status = 201 then size end as size from up")
def upload_replies(spark, sf_dir):
    return uploaded(spark, sf_dir)[1]


@query(f"with {upload_sql()} select file_id, {NOW_MS}::bigint as created_at, version_id as current_version_id from up where status = 201")
def upload_files(spark, sf_dir):
    return uploaded(spark, sf_dir)[0].files


@query(f"with {upload_sql()} select version_id, file_id, size, {NOW_MS}::bigint as created_at from up where status = 201")
def upload_versions(spark, sf_dir):
    return uploaded(spark, sf_dir)[0].versions


@query(f"with {upload_sql()}, c as (select version_id, d, unnest(range(0, (size + {SMALL} - 1) // {SMALL}))::int as seq from up where status = 201) select version_id, seq, sha256(d[seq::bigint * {SMALL} + 1 : seq::bigint * {SMALL} + {SMALL}]) as chunk_hash from c")
def upload_manifest(spark, sf_dir):
    return uploaded(spark, sf_dir)[0].manifest


@query(f"with {upload_sql()}, c as (select d, unnest(range(0, (size + {SMALL} - 1) // {SMALL})) as seq from up where status = 201), b as (select d[seq * {SMALL} + 1 : seq * {SMALL} + {SMALL}] as x from c) select distinct sha256(x) as chunk_hash, octet_length(x)::int as size from b")
def upload_store(spark, sf_dir):
    return uploaded(spark, sf_dir)[0].store.select("chunk_hash", F.octet_length("data").alias("size"))


LATER_MS = NOW_MS + 1000


def updated(spark, sf_dir) -> tuple[service.Tables, DataFrame]:
    """(tables, replies) after an update of all documents' files, of which only those with even ids were uploaded."""
    t, _ = uploaded(spark, sf_dir, "doc_id % 2 = 0 and text is not null", 1 << 30)
    file_id = hashing.deterministic_id("file", F.col("doc_id").cast("string"), F.lit(str(NOW_MS)))
    body = F.when(F.col("doc_id") % 5 != 0, F.encode(F.concat("text", F.lit("!")), "UTF-8"))
    bodies = table(spark, sf_dir, "documents").where("text is not null").select(file_id.alias("file_id"), body.alias("data"))
    return service.update(t, bodies, LATER_MS, StoreConfig(chunk_size=SMALL), 4000)


UPDATED = f"""old as (select doc_id, {FILE_ID} as file_id, sha256(encode(text)) as h, case when doc_id % 5 <> 0 then encode(text || '!') end as d from documents where text is not null),
new as (select doc_id, file_id, d, case when doc_id % 2 <> 0 then 404 when d is null then 400 when octet_length(d) > 4000 then 413 else 200 end as status,
'ver_' || substr(sha256(file_id || '/{LATER_MS}/' || sha256(d)), 1, 24) as version_id, 'ver_' || substr(sha256(file_id || '/{NOW_MS}/' || h), 1, 24) as previous_version_id from old)"""


@query(f"with {UPDATED} select file_id, status, case when status = 200 then version_id end as version_id, case when status = 200 then previous_version_id end as previous_version_id from new")
def update_replies(spark, sf_dir):
    return updated(spark, sf_dir)[1]


@query(f"with {UPDATED} select case when status = 200 then version_id else previous_version_id end as version_id, file_id, case when status = 200 then {LATER_MS} else {NOW_MS} end::bigint as created_at from new where doc_id % 2 = 0")
def update_versions(spark, sf_dir):
    return updated(spark, sf_dir)[0].versions.select("version_id", "file_id", "created_at")


@query(f"""with g as (select doc_id as request_id, {FILE_ID} as file_id, doc_id % 8 as k, text from documents where text is not null)
select request_id, file_id, case k when 1 then 'expired' when 2 then 'missing' when 3 then 'malformed' when 4 then 'tampered' when 6 then 'tampered' when 7 then 'tampered' else 'ok' end as verdict,
case when k in (1, 2, 3, 4, 6, 7) then 403 else 200 end as status, case when k in (0, 5) then sha256(encode(text)) end as digest from g""")
def presigned_fetch(spark, sf_dir):
    t, replies = uploaded(spark, sf_dir, "text is not null", 1 << 30)
    made = replies.select("request_id", "file_id", presign.presign(F.lit("GET"), F.concat(F.lit("/files/"), "file_id", F.lit("/download-presigned")), F.lit(NOW_MS)).alias("s"))
    k, at = F.col("request_id") % 8, F.col("s.expires_at").cast("string")
    # nothing at 2, a word at 3, numbers that no signature can be for at 6 and 7
    expires = F.when(k == 2, "").when(k == 3, "soon").when(k == 6, "1e30").when(k == 7, F.concat(at, F.lit(".5"))).otherwise(at)
    sig = F.when(k == 4, F.reverse("s.signature")).otherwise(F.col("s.signature"))
    asked = made.select("request_id", "file_id", expires.alias("expires"), sig.alias("sig"), (F.lit(NOW_MS) + F.when(k == 1, 400_000).otherwise(0)).alias("now_ms"))
    got = service.presigned_download(t, asked)
    return got.select("request_id", "file_id", "verdict", "status", F.sha2("data", 256).alias("digest"))


HOSTILE = {
    "1e30": "tampered", "Infinity": "tampered", "-Infinity": "expired", "-1e400": "expired", "1e400": "tampered", "NaN": "malformed", "nan": "malformed", "inf": "malformed", "1d": "malformed", "1,000": "malformed", "0x10": "malformed",
    "9007199254740993": "tampered", "99999999999999999999": "tampered", "-5": "expired", "0": "expired", "abc": "malformed", "1e": "malformed", ".": "malformed", "1e309": "tampered", "": "missing",
}


@query("with t(expires, verdict) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in HOSTILE.items()) + ") select n_nationkey, expires, verdict from nation, t")
def presign_hostile(spark, sf_dir):
    expires = F.explode(F.array(*[F.lit(k) for k in HOSTILE])).alias("expires")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", expires)
    return rows.select("n_nationkey", "expires", presign.verify(F.lit("GET"), F.lit("/x"), F.col("expires"), F.lit("ab" * 32), F.lit(NOW_MS)).alias("verdict"))


@query(f"with {C256}, held as (select distinct chunk_hash from chunks where substr(file_id, 6)::bigint % 2 = 0) select distinct chunk_hash, chunk_hash in (select chunk_hash from held) as deleted from chunks where substr(file_id, 6)::bigint % 3 = 0")
def chunk_delete(spark, sf_dir):
    m = doc_chunks(spark, sf_dir).withColumn("k", F.substring("file_id", 6, 30).cast("long"))
    return catalog.store_delete(m.where("k % 2 = 0").select("chunk_hash").distinct(), m.where("k % 3 = 0"))[1]


@query(f"with {C256}, h as (select chunk_hash, bool_or(substr(file_id, 6)::bigint % 2 = 0) as held from chunks group by 1) select chunk_hash, case when not held then 404 when {LOST} then 409 else 200 end as status from h")
def chunk_get(spark, sf_dir):
    cut = chunking.chunk(docs(spark, sf_dir), SMALL, keep_data=True).withColumn("k", F.substring("file_id", 6, 30).cast("long"))
    damaged = F.when(hashing.hash_byte(F.col("chunk_hash"), 0) < 16, F.encode(F.lit("damaged"), "UTF-8")).otherwise(F.col("data"))
    store = cut.where("k % 2 = 0").dropDuplicates(["chunk_hash"]).select("chunk_hash", damaged.alias("data"))
    return catalog.store_get(store, cut).select("chunk_hash", "status")


@query("with o as (select i, list_transform(range(0, 4), lambda j: sha256('7/' || i || '/' || j)) as runs from range(0, 20) t(i)) select 'file_' || i as file_id, sha256(unhex(substr(list_aggregate(runs, 'string_agg', ''), 1, 200))) as digest, 100 as size from o")
def seeded_bytes(spark, sf_dir):
    return objects.seeded_objects(spark, 20, 100, 7).select("file_id", F.sha2("data", 256).alias("digest"), F.octet_length("data").alias("size"))


@query(f"with {VERS}, c as (select version_id, d, unnest(range(0, ((octet_length(d) + 63) // 64)::bigint)) as seq from vers) select version_id, string_agg(sha256(d[seq * 64 + 1 : seq * 64 + 64]), ',' order by seq) as hashes, count(*)::int as chunk_count from c group by 1")
def ordered_hashes(spark, sf_dir):
    m = chunking.chunk(conversation_versions(spark, sf_dir), 64, key="version_id")
    return catalog.version_hashes(m).select("version_id", F.array_join("hashes", ",").alias("hashes"), "chunk_count")


@query(f"with {C256}, n as (select chunk_hash, count(*) as n from chunks where substr(file_id, 6)::bigint % 2 = 1 group by 1) select distinct chunk_hash, coalesce(n, 0) as refcount from chunks left join n using (chunk_hash) where substr(file_id, 6)::bigint % 2 = 0")
def refcount_lookup(spark, sf_dir):
    m = doc_chunks(spark, sf_dir).withColumn("k", F.substring("file_id", 6, 30).cast("long"))
    return catalog.refcount_of(m.where("k % 2 = 0").select("chunk_hash").distinct(), catalog.refcounts(m.where("k % 2 = 1")))


def after_delete(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, versions, manifest, counts) after the versions of every third turn are deleted, the last ones of files among them."""
    v = conversation_versions(spark, sf_dir)
    m = chunking.chunk(v, 64, key="version_id").select("version_id", "seq", "chunk_hash")
    gone = v.where(((F.col("created_at") - NOW_MS) / 1000).cast("long") % 3 == 0)
    return catalog.current_versions(v, F.col("created_at")), *catalog.delete_versions(v.drop("data"), m, catalog.refcounts(m), gone)


@query(f"with {VERS} select version_id, file_id, size, created_at from vers where ((created_at - {NOW_MS}) // 1000) % 3 <> 0")
def delete_versions_left(spark, sf_dir):
    return after_delete(spark, sf_dir)[1]


@query(f"with {CONV}, keep as (select chunk_hash, count(*) filter (where ((created_at - {NOW_MS}) // 1000) % 3 <> 0) as refcount from man group by 1) select chunk_hash, refcount from keep")
def delete_versions_refcounts(spark, sf_dir):
    return after_delete(spark, sf_dir)[3]


@query(f"with {VERS}, c as (select file_id, arg_max(version_id, created_at) as current_version_id, max(created_at) as tm from vers group by 1) select file_id, current_version_id from c where ((tm - {NOW_MS}) // 1000) % 3 = 0")
def dangling_pointer_audit(spark, sf_dir):
    files, versions, *_ = after_delete(spark, sf_dir)
    return catalog.dangling_pointers(files, versions)


@query(f"with {VERS}, cut as (select version_id, file_id, d, unnest(range(0, ((octet_length(d) + 63) // 64)::bigint)) as seq from vers), man as (select version_id, sha256(d[seq * 64 + 1 : seq * 64 + 64]) as chunk_hash, octet_length(d[seq * 64 + 1 : seq * 64 + 64]) as z from cut), cur as (select file_id, arg_max(version_id, created_at) as version_id from vers group by 1), idle as (select chunk_hash, max(z) as z from man where chunk_hash not in (select chunk_hash from man where version_id in (select version_id from cur)) group by 1) select count(*) as chunks, coalesce(sum(z), 0)::bigint as bytes from idle")
def unreferenced_bytes(spark, sf_dir):
    v = conversation_versions(spark, sf_dir)
    m = chunking.chunk(v, 64, key="version_id")
    return catalog.unreferenced(m, catalog.live_manifest(m, catalog.current_versions(v, F.col("created_at"))))


@query(f"with {C256}, {FIVE}, {POINTS}, {placement_sql('select distinct chunk_hash from chunks')} select chunk_hash, rank, 'http://' || node_id as url from placed")
def replica_urls(spark, sf_dir):
    return replication.with_urls(ring.ranked(placed_chunks(spark, sf_dir)), five_nodes(spark)).select("chunk_hash", "rank", "url")


@query(f"with {C256}, s as (select chunk_hash, max(chunk_size) as z from chunks group by 1) select count(*) * {REPLICAS} as chunk_count, (sum(z) * {REPLICAS})::bigint as total_bytes from s")
def cluster_total(spark, sf_dir):
    return node_load(spark, sf_dir).agg(F.sum("chunk_count").alias("chunk_count"), F.sum("total_bytes").alias("total_bytes"))


@query("select doc_id, 'file_' || substr(sha256(doc_id || '/' || source), 1, 24) as id from documents where source is not null")
def deterministic_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null")
    return d.select("doc_id", hashing.deterministic_id("file", F.col("doc_id").cast("string"), F.col("source")).alias("id"))


@query(f"with {C256}, per as (select source, chunk_hash, count(*) as n, max(chunk_size) as s from chunks join documents on file_id = 'file_' || doc_id group by 1, 2) select source, printf('%.1f%%', (sum(s * n) - sum(s)) * 100.0 / sum(s * n)) as saved from per group by 1")
def dedup_percent(spark, sf_dir):
    return dedup_by_source(spark, sf_dir).select("source", catalog.percent_text(F.col("saved_bytes"), F.col("total_bytes")).alias("saved"))


@query("select case when event_id % 3 = 0 then 'user-' || user_id else '10.0.0.' || (event_id % 7) end as client, count(*) as requests from events group by 1")
def client_keys(spark, sf_dir):
    k = F.col("event_id") % 3
    header = F.when(k == 0, F.concat(F.lit("user-"), "user_id")).when(k == 1, "")
    address = F.concat(F.lit("10.0.0."), F.col("event_id") % 7)
    return table(spark, sf_dir, "events").select(ratelimit.client_key(header, address).alias("client")).groupBy("client").agg(F.count("*").alias("requests"))


@query(f"{BUCKET} select log.route, case when s.allowed then log.status else 429 end as status, count(*) as requests from s join log using (request_id) group by 1, 2")
def admission_hook(spark, sf_dir):
    return ratelimit.admission(requests(spark, sf_dir), LIMIT).groupBy("route", "status").agg(F.count("*").alias("requests"))


#: A chunk's simulated time: windows of five minutes over three hours.
CHUNK_MS = f"({NOW_MS} + ('0x' || substr(sha1(chunk_hash), 9, 2))::int * 42000)::bigint"
STEP = "(tm // 300000 * 300)::bigint as window_start, count(*) as events, count(*) / 300.0::double as rate"


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("at", (F.lit(NOW_MS) + hashing.hash_byte(F.col("chunk_hash"), 4) * 42_000).cast("bigint"))


@query(f"with {ATT}, {QUO}, q as (select {CHUNK_MS} as tm from quo where acks < {QUORUM}) select {STEP} from q group by 1")
def quorum_failure_rate_5m(spark, sf_dir):
    q = timed(replication.quorum(attempts(spark, sf_dir), QUORUM))
    return metrics.window_rate(q, "at", 300, where=~F.col("quorum_met"))


SEEN = """f as (select chunk_hash, min(rank) filter (where outcome = 'ok') as r from att group by 1),
seen as (select {at} as tm, case when outcome = 'ok' and rank > 0 then 'failover_success' when outcome = 'ok' then null when outcome = 'not_found' and rank = 0 then null else outcome end as reason from att join f using (chunk_hash) where r is null or rank <= r)""".replace("{at}", CHUNK_MS)


def timed_failovers(spark, sf_dir) -> DataFrame:
    start = (F.floor(F.col("at") / 300_000) * 300).alias("window_start")
    a = timed(attempts(spark, sf_dir))
    return replication.failovers(a.select("chunk_hash", "rank", "node_id", "outcome", start), "window_start")


@query(f"with {ATT}, {SEEN} select reason, {STEP} from seen where reason is not null group by 1, 2")
def failover_rate_5m(spark, sf_dir):
    return timed_failovers(spark, sf_dir).select("reason", "window_start", F.col("failovers").alias("events"), (F.col("failovers") / F.lit(300.0)).alias("rate"))


@query(f"with {ATT}, {SEEN} select {STEP} from seen where reason = 'integrity_mismatch' group by 1")
def integrity_failure_rate_5m(spark, sf_dir):
    f = timed_failovers(spark, sf_dir).where("integrity_failures > 0")
    return f.select("window_start", F.col("integrity_failures").alias("events"), (F.col("integrity_failures") / F.lit(300.0)).alias("rate"))
