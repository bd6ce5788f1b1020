"""Placement of work on nodes, as queries over load and node tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import numbered

# Microseconds that any migration takes, link speed in GB/s (100 Gb), headroom in MB.
FIXED_US, LINK_GBS, HEADROOM_MB = 25.0, 100 / 8, 1024


#: Nodes of a cluster at most: what is broadcast of them.
MOST_NODES = 100_000


def of_checked_size(nodes: DataFrame) -> DataFrame:
    if nodes.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    return nodes


def with_utility(loads: DataFrame, mem: str = "mem_size", load: str = "cpu_load") -> DataFrame:
    """PL01: microseconds that moving takes, and load and memory freed a microsecond."""
    time = F.lit(FIXED_US) + F.col(mem) / F.lit(LINK_GBS) / 1000
    return loads.withColumn("move_us", time).withColumn("cpu_utility", F.col(load) / F.col("move_us")).withColumn("mem_utility", F.col(mem) / F.col("move_us"))


def pick_tasks(loads: DataFrame, node: str, utility: str, order: str, mem_mbs: Column, least_mbs: float, least_tasks: int, migratable: Column | None = None) -> DataFrame:
    """PL02: of each node, the tasks of highest utility until both memory and number suffice; one at least.

    Memory adds up in whole MB. Ties go by the order column.
    """
    rows = loads if migratable is None else loads.where(migratable)
    best = Window.partitionBy(node).orderBy(F.desc(utility), F.asc(order))
    before = F.coalesce(F.sum(F.floor(mem_mbs).cast("long")).over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("rank", F.row_number().over(best)).withColumn("freed_before", before)
    return ranked.where((F.col("rank") == 1) | (F.col("freed_before") < least_mbs) | (F.col("rank") <= least_tasks))


def initial_hosts(tasks: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """PL03: a task's hinted host (if it's a node), else its last one, else the nodes in turn, isolated ones left out.

    `nodes` (ip, isol) is a cluster's list: small, and broadcast as such. Turns are taken in the
    order of `order`, of those tasks only that need one.
    """
    nodes = of_checked_size(nodes)
    turns = nodes.where("not isol").agg(F.array_sort(F.collect_list("ip")).alias("turn"), F.count(F.lit(1)).alias("n_open"))
    known = nodes.select(F.col("ip").alias("hint"), F.lit(True).alias("hint_known"))
    needs = F.col("hint").isNull() & F.col("prev_host").isNull()
    needy = numbered(tasks.where(needs), [order], "__nth").unionByName(tasks.where(~needs), allowMissingColumns=True)
    rows = needy.join(F.broadcast(known), "hint", "left").crossJoin(F.broadcast(turns))  # one row of turns
    turn = F.try_element_at(F.col("turn"), (F.pmod(F.col("__nth"), F.greatest(F.col("n_open"), F.lit(1))) + 1).cast("int"))
    host = F.when(F.col("hint").isNotNull(), F.when(F.col("hint_known"), F.col("hint"))).when(F.col("prev_host").isNotNull(), F.col("prev_host")).otherwise(turn)
    return rows.withColumn("host", host).drop("turn", "n_open", "hint_known", "__nth")


def migration_destinations(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """PL04 for a cluster that stands still: (req_id, ip): the first node in turn order from `turn` on that fits; null if none does.

    A node fits that isn't the requestor, isolated or taken. First by cores and memory with
    headroom; then, under memory pressure, by memory alone. Each request is judged as if it were the
    only one; `placements` takes them in order, as the cluster's controller does. `requests`: req_id, requestor, mem_pressure, cores, mem_mbs, turn; `nodes`: ip, isol,
    acquired, cores, mem_mbs, pos (the turn order), a cluster's list: small.
    """
    n = of_checked_size(nodes).select(F.col("ip"), "isol", "acquired", F.col("cores").alias("node_cores"), F.col("mem_mbs").alias("node_mem"), "pos")
    listed = F.broadcast(n.agg(F.array_sort(F.collect_list(F.struct("pos", "ip", "isol", "acquired", "node_cores", "node_mem"))).alias("nodes")))
    rows = requests.crossJoin(listed)  # one row
    enough_mem = lambda x: x["node_mem"] >= F.col("mem_mbs") + HEADROOM_MB
    open_ = lambda x: (x["ip"] != F.col("requestor")) & ~x["isol"] & ~x["acquired"]
    turned = F.concat(F.filter("nodes", lambda x: x["pos"] >= F.col("turn")), F.filter("nodes", lambda x: x["pos"] < F.col("turn")))
    first = F.filter(turned, lambda x: open_(x) & (x["node_cores"] >= F.col("cores")) & enough_mem(x))
    second = F.filter(turned, lambda x: open_(x) & enough_mem(x) & F.col("mem_pressure"))
    return rows.select("req_id", F.coalesce(F.try_element_at(first, F.lit(1))["ip"], F.try_element_at(second, F.lit(1))["ip"]).alias("ip"))


class Cluster:
    """Nodes of one process in order of their address, and the turn: the place where the next search begins."""

    def __init__(self, nodes: list[dict]):
        listed = sorted({n["ip"]: n for n in nodes}.values(), key=lambda n: n["ip"])
        self.ips, self.at = [n["ip"] for n in listed], 0
        self.place = {ip: k for k, ip in enumerate(self.ips)}
        self.isolated, self.taken = (np.array([bool(n[c]) for n in listed], bool) for c in ("isol", "flag"))
        self.cores, self.memory = (np.array([n[c] or 0.0 for n in listed], float) for c in ("cores", "mem_mbs"))

    def in_turn(self, fits: np.ndarray) -> int | None:
        """The first that fits from the turn on, round the circle; the turn moves behind it."""
        places = np.flatnonzero(fits)
        if not len(places):
            return None
        later = int(np.searchsorted(places, self.at))
        found = int(places[later if later < len(places) else 0])
        self.at = found + 1
        return found

    def destination(self, requestor: int, pressure: bool, cores: float, memory: float) -> int | None:
        fits = ~self.isolated & ~self.taken & (self.memory >= memory + HEADROOM_MB)
        if requestor in self.place:
            fits[self.place[requestor]] = False
        found = self.in_turn(fits & (self.cores >= cores))
        if found is None and pressure:
            found = self.in_turn(fits)
        if found is not None:
            self.taken[found] = True
        return found

    def take(self, ip: int, taken: bool) -> int | None:
        """Takes or frees a node; None if it's not there or is so already."""
        k = self.place.get(ip)
        if k is None or self.taken[k] == taken:
            return None
        self.taken[k] = taken
        return k

    def report(self, ip: int, cores: float, memory: float) -> int | None:
        k = self.place.get(ip)
        if k is not None:
            self.cores[k], self.memory[k] = cores, memory
        return k

    def answer(self, entry: dict) -> int | None:
        kind, ip, cores, memory = entry["kind"], entry["ip"], entry["cores"] or 0.0, entry["mem_mbs"] or 0.0
        if kind == "destination":
            k = self.destination(ip, bool(entry["flag"]), cores, memory)
        elif kind == "place":
            k = self.in_turn(~self.isolated)
        elif kind in ("acquire", "release"):
            k = self.take(ip, kind == "acquire")
        else:
            k = self.report(ip, cores, memory) if kind == "report" else None
        return None if k is None else self.ips[k]


def placements(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """PL03, PL04: (lpid, seq, kind, ip) of each entry of a controller's log, each answered in the state that those before it have left.

    `log` has lpid, seq, kind, ip, mem_pressure, cores, mem_mbs. Kinds: `destination` looks for a node other than `ip` from the turn on, as
    `migration_destinations` does, takes it and moves the turn behind it (where none is found nothing changes); `place` gives the next node in turn that isn't
    isolated, whether it's taken or not; `acquire` takes a node by address, `release` frees one; `report` sets a node's free cores and
    memory. The answer is the node's address, null where there's none (or where a node to be taken or freed was so already). `nodes` has lpid, ip,
    isol, acquired, cores, mem_mbs; an address listed twice counts once.

    A process's entries depend on each other, so they are one stream: sorted by (seq, kind, ip), with the process's nodes before them, and
    folded batch by batch with nothing kept but the nodes. Processes are independent. Entries without lpid or seq take no part.
    """
    listed = nodes.select("lpid", F.lit(None).cast(log.schema["seq"].dataType).alias("seq"), F.lit("node").alias("kind"), "ip", F.col("acquired").alias("flag"), "cores", "mem_mbs", "isol")
    entries = log.where("lpid IS NOT NULL AND seq IS NOT NULL").select("lpid", "seq", "kind", "ip", F.col("mem_pressure").alias("flag"), "cores", "mem_mbs", F.lit(False).alias("isol"))
    rows = listed.where("lpid IS NOT NULL AND ip IS NOT NULL").unionByName(entries)
    ordered = rows.withColumns({c: F.col(c).cast("double") for c in ("cores", "mem_mbs")}).repartition("lpid").sortWithinPartitions("lpid", F.asc_nulls_first("seq"), "kind", "ip")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lpid, listed, cluster = None, [], None
        for batch in batches:
            answers, kept = [], []
            for k, entry in enumerate(batch.to_pylist()):
                if entry["lpid"] != lpid:
                    lpid, listed, cluster = entry["lpid"], [], None
                if entry["seq"] is None:
                    listed.append(entry)
                    continue
                cluster = cluster or Cluster(listed)
                answers.append(cluster.answer(entry))
                kept.append(k)
            out = batch.select(["lpid", "seq", "kind"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(answers, batch.schema.field("ip").type)], ["lpid", "seq", "kind", "ip"])

    return ordered.mapInArrow(fold, ordered.select("lpid", "seq", "kind", "ip").schema)


def free_resources(reports: DataFrame, nodes: DataFrame, weight: float) -> DataFrame:
    """PL05: smoothed free cores and memory of nodes that aren't isolated, from their reports in order of `seq`."""
    from .latency import ewma

    cores = ewma(reports, "ip", ["seq"], "cores", weight).withColumnRenamed("average", "cores")
    memory = ewma(reports, "ip", ["seq"], "mem_mbs", weight).withColumnRenamed("average", "mem_mbs")
    return nodes.where("not isol").select("ip").join(cores, "ip").join(memory, "ip")
