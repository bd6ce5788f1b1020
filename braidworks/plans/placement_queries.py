"""Placement over suppliers, parts and nations as tasks and nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidworks.operators import placement

from .registry import query, read

_TASKS = "(SELECT s_suppkey, s_nationkey, CAST(floor(s_acctbal) AS BIGINT) + 2000 AS mem_size, CAST(s_suppkey % 17 AS DOUBLE) AS cpu_load, s_suppkey % 5 <> 0 AS migratable FROM supplier)"
_UTILITY = f"(SELECT *, 25.0::DOUBLE + mem_size / 12.5::DOUBLE / 1000 AS move_us FROM {_TASKS})"


def _tasks(spark, d):
    s = F.col("s_suppkey")
    memory, load = F.floor("s_acctbal").cast("long") + 2000, (s % 17).cast("double")
    return read(spark, d, "supplier").select("s_suppkey", "s_nationkey", memory.alias("mem_size"), load.alias("cpu_load"), (s % 5 != 0).alias("migratable"))


@query(f"SELECT s_suppkey, round(move_us, 6) AS move_us, round(cpu_load / move_us, 6) AS cpu_utility, round(mem_size / move_us, 6) AS mem_utility FROM {_UTILITY}")
def pl_utility(spark, d):
    rows = placement.with_utility(_tasks(spark, d))
    return rows.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("move_us", "cpu_utility", "mem_utility")])


@query(f"""
SELECT s_suppkey, s_nationkey FROM (
  SELECT *, row_number() OVER w AS r, coalesce(sum(mem_size) OVER (PARTITION BY s_nationkey ORDER BY mem_size / move_us DESC, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed
  FROM {_UTILITY} WHERE migratable WINDOW w AS (PARTITION BY s_nationkey ORDER BY mem_size / move_us DESC, s_suppkey))
WHERE r = 1 OR freed < 9000 OR r <= 2""")
def pl_pick_tasks(spark, d):
    rows = placement.with_utility(_tasks(spark, d))
    return placement.pick_tasks(rows, "s_nationkey", "mem_utility", "s_suppkey", F.col("mem_size"), 9000, 2, F.col("migratable")).select("s_suppkey", "s_nationkey")


@query("""
WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS ip, n_nationkey % 4 = 0 AS isol FROM nation),
turn AS (SELECT ip, row_number() OVER (ORDER BY ip) - 1 AS i, count(*) OVER () AS k FROM n WHERE NOT isol),
t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey % 40 END AS hint, CASE WHEN s_suppkey % 3 = 0 THEN 900 + s_suppkey END AS prev FROM supplier),
needy AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS nth FROM t WHERE hint IS NULL AND prev IS NULL)
SELECT t.s_suppkey, coalesce(CAST(CASE WHEN hint IS NOT NULL THEN (SELECT ip FROM n WHERE ip = hint) WHEN prev IS NOT NULL THEN prev ELSE turn.ip END AS BIGINT), -1) AS host
FROM t LEFT JOIN needy ON needy.s_suppkey = t.s_suppkey LEFT JOIN turn ON turn.i = needy.nth % turn.k""")
def pl_initial_hosts(spark, d):
    s = F.col("s_suppkey")
    tasks = read(spark, d, "supplier").select("s_suppkey", F.when(s % 7 == 0, s % 40).alias("hint"), F.when(s % 3 == 0, s + 900).alias("prev_host"))
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ip"), (F.col("n_nationkey") % 4 == 0).alias("isol"))
    return placement.initial_hosts(tasks, nodes, "s_suppkey").select("s_suppkey", F.coalesce("host", F.lit(-1).cast("long")).alias("host"))


_NODES = (
    "(SELECT CAST(n_nationkey AS BIGINT) AS ip, n_nationkey % 4 = 0 AS isol, n_nationkey % 6 = 1 AS acquired, (n_nationkey * 5) % 16 AS node_cores,"
    " 1000 + n_nationkey * 300 AS node_mem, n_nationkey AS pos FROM nation)"
)


@query(f"""
WITH r AS (SELECT s_suppkey AS req_id, s_nationkey AS requestor, s_suppkey % 2 = 0 AS pressure, s_suppkey % 19 AS cores, (s_suppkey % 30) * 250 AS mem, s_suppkey % 25 AS turn FROM supplier),
c AS (SELECT req_id, ip, (node_cores >= cores) AS first_round, (pos < turn) AS wrapped, pos, pressure FROM r, {_NODES}
  WHERE ip <> requestor AND NOT isol AND NOT acquired AND node_mem >= mem + 1024)
SELECT r.req_id, coalesce((SELECT arg_min(ip, (NOT first_round, wrapped, pos)) FROM c WHERE c.req_id = r.req_id AND (first_round OR pressure)), 0) AS ip FROM r""")
def pl_migration_dest(spark, d):
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    requests = read(spark, d, "supplier").select(
        s.alias("req_id"), F.col("s_nationkey").alias("requestor"), (s % 2 == 0).alias("mem_pressure"), (s % 19).alias("cores"), ((s % 30) * 250).alias("mem_mbs"), (s % 25).alias("turn")
    )
    nodes = read(spark, d, "nation").select(
        n.cast("long").alias("ip"), (n % 4 == 0).alias("isol"), (n % 6 == 1).alias("acquired"), ((n * 5) % 16).alias("cores"), (n * 300 + 1000).alias("mem_mbs"), n.alias("pos"))
    return placement.migration_destinations(requests, nodes).select("req_id", F.coalesce("ip", F.lit(0).cast("long")).alias("ip"))


_LOG = """SELECT o_custkey % 40 AS lpid, o_orderkey AS seq,
  CASE WHEN o_orderkey % 20 < 8 THEN 'destination' WHEN o_orderkey % 20 < 11 THEN 'acquire' WHEN o_orderkey % 20 < 17 THEN 'release' WHEN o_orderkey % 20 < 18 THEN 'report' ELSE 'place' END AS kind,
  o_custkey * 7 % 27 AS ip, o_orderkey % 3 = 0 AS mem_pressure, o_orderkey * 5 % 17 AS cores, o_orderkey * 11 % 31 * 250 AS mem_mbs FROM orders"""


@query(f"""
WITH RECURSIVE n AS (SELECT list(ip ORDER BY ip) AS ips, list(isol ORDER BY ip) AS isols, list(acquired ORDER BY ip) AS taken, list(CAST(node_cores AS BIGINT) ORDER BY ip) AS cpu,
    list(CAST(node_mem AS BIGINT) ORDER BY ip) AS mem FROM {_NODES}),
log AS (SELECT *, row_number() OVER (PARTITION BY lpid ORDER BY seq) AS i FROM ({_LOG})),
r AS (
  SELECT lpid, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, '' AS kind, CAST(NULL AS BIGINT) AS k, taken, cpu, mem, CAST(0 AS BIGINT) AS turn FROM (SELECT DISTINCT lpid FROM log), n
  UNION ALL
  SELECT lpid, i, seq, kind, k,
    CASE WHEN k IS NULL OR kind IN ('place', 'report') THEN taken ELSE list_transform(taken, lambda x, j: CASE WHEN j = k + 1 THEN kind <> 'release' ELSE x END) END,
    CASE WHEN k IS NULL OR kind <> 'report' THEN cpu ELSE list_transform(cpu, lambda x, j: CASE WHEN j = k + 1 THEN cores ELSE x END) END,
    CASE WHEN k IS NULL OR kind <> 'report' THEN mem ELSE list_transform(mem, lambda x, j: CASE WHEN j = k + 1 THEN mem_mbs ELSE x END) END,
    CASE WHEN k IS NOT NULL AND kind IN ('destination', 'place') THEN k + 1 ELSE turn END
  FROM (
    SELECT *, CASE kind
        WHEN 'destination' THEN coalesce(
          list_min(list_filter(ranked, lambda x: fits[x % 100 + 1] AND cpu[x % 100 + 1] >= cores)), CASE WHEN mem_pressure THEN list_min(list_filter(ranked, lambda x: fits[x % 100 + 1])) END) % 100
        WHEN 'place' THEN list_min(list_filter(ranked, lambda x: NOT isols[x % 100 + 1])) % 100
        WHEN 'report' THEN list_position(ips, ip) - 1
        ELSE CASE WHEN taken[list_position(ips, ip)] = (kind = 'release') THEN list_position(ips, ip) - 1 END END AS k
    FROM (
      SELECT log.*, r.taken, r.cpu, r.mem, r.turn, n.ips, n.isols,
        list_transform(range(len(n.ips)), lambda x: CASE WHEN x >= r.turn THEN x ELSE x + 100 END) AS ranked,
        list_transform(range(len(n.ips)), lambda x: NOT n.isols[x + 1] AND NOT r.taken[x + 1] AND r.mem[x + 1] >= log.mem_mbs + 1024 AND n.ips[x + 1] <> log.ip) AS fits
      FROM r JOIN log ON log.lpid = r.lpid AND log.i = r.i + 1, n)))
SELECT lpid, seq, kind, coalesce(n.ips[k + 1], -1) AS ip FROM r, n WHERE i > 0""")
def pl_migration_log(spark, d):
    o, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey")
    kind = F.when(o % 20 < 8, "destination").when(o % 20 < 11, "acquire").when(o % 20 < 17, "release").when(o % 20 < 18, "report").otherwise("place")
    log = read(spark, d, "orders").select(
        (c % 40).alias("lpid"), o.alias("seq"), kind.alias("kind"), (c * 7 % 27).alias("ip"), (o % 3 == 0).alias("mem_pressure"), (o * 5 % 17).alias("cores"), (o * 11 % 31 * 250).alias("mem_mbs"))
    lpids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))
    nodes = read(spark, d, "nation").select(
        lpids.alias("lpid"), n.cast("long").alias("ip"), (n % 4 == 0).alias("isol"), (n % 6 == 1).alias("acquired"), ((n * 5) % 16).alias("cores"), (n * 300 + 1000).alias("mem_mbs"))
    return placement.placements(log, nodes).withColumn("ip", F.coalesce("ip", F.lit(-1).cast("long")))


@query("""
WITH RECURSIVE s AS (SELECT s_nationkey AS ip, s_acctbal AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier WHERE s_nationkey % 4 <> 0),
r AS (SELECT ip, i, x AS a FROM s WHERE i = 1
 UNION ALL SELECT s.ip, s.i, CASE WHEN a = 0 THEN x ELSE 0.25 * x + 0.75 * a END FROM r JOIN s ON s.ip = r.ip AND s.i = r.i + 1)
SELECT ip, round(arg_max(a, i), 6) AS cores, round(arg_max(a, i) * 2, 6) AS mem_mbs FROM r GROUP BY 1""")
def pl_free_resources(spark, d):
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").alias("ip"), (F.col("n_nationkey") % 4 == 0).alias("isol"))
    reports = read(spark, d, "supplier").select(F.col("s_nationkey").alias("ip"), F.col("s_suppkey").alias("seq"), F.col("s_acctbal").alias("cores"), (F.col("s_acctbal") * 2).alias("mem_mbs"))
    found = placement.free_resources(reports, nodes, 0.25)
    return found.select("ip", F.round("cores", 6).alias("cores"), F.round("mem_mbs", 6).alias("mem_mbs"))
