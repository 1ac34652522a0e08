"""Host, process and port reports as time-series rows, by declared fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.timeparse import utc_us

# Names of the figures a host reports, and where a report holds them. Paths of tables with ``items`` that start with @ lie in the item, '#' is its place.
_CPU = {"user": "user", "system": "system", "nice": "nice", "idle": "idle", "iowait": "iowait", "interrupt": "irq", "softirq": "softirq", "stolen": "stolen", "guest": "guest"}
_STATES = {
    "closed": "close", "closewait": "closeWait", "closing": "closing", "estab": "established", "finwait1": "finWait1", "finwait2": "finWait2", "lastack": "lastAck", "listen": "listen",
    "syn_recv": "synRecv", "syn_sent": "syncSent", "timewait": "timeWait",
}
_NET = {
    "speed_recv": "speedRecv", "speed_sent": "speedSent", "speed_packets_recv": "speedPacketsRecv", "speed_packets_sent": "speedPacketsSent", "packets_recv": "packetsRecv",
    "packets_sent": "packetsSent", "bytes_recv": "bytesRecv", "bytes_sent": "bytesSent", "errors": "errors", "dropped": "dropped", "overruns": "overruns", "carrier": "carrier", "collisions": "collisions",
}
_MEM = {"buffer": "buffers", "cached": "cached", "free": "free", "total": "total", "usable": "available", "used": "used", "shared": "shared", "pct_used": "usedPercent"}
_IO = {"await": "await", "svctm": "svctm", "r_s": "speedIORead", "w_s": "speedIOWrite", "util": "util", "avgrq_sz": "avgrq_sz", "avgqu_sz": "avgqu_sz", "wkb_s": "speedByteWrite", "rkb_s": "speedByteRead"}
_ENV = {"maxfiles": "env.maxfiles", "allocated_files": "env.allocated_files", "login_user": "env.login_user", "proc_running_current": "env.proc_running_current",
        "procs_blocked_current": "env.procs_blocked_current", "procs_processes_total": "env.procs_processes_total", "procs_ctxt_total": "env.procs_ctxt_total",
        "procs": "system.info.procs", "procs_zombie": "system.info.procsZombie", "uptime": "system.info.uptime"}
#: Who reports: these are dimensions of every table.
REPORTER = {"ip": "ip", "bk_target_ip": "ip", "bizid": "bizid", "cloudid": "cloudid", "bk_agent_id": "bk_agent_id", "bk_biz_id": "bk_biz_id", "bk_host_id": "bk_host_id", "hostname": "bkmonitorbeat.hostname"}


@dataclass(frozen=True)
class Report:
    """One table: ``items`` is a list of which each element gives a row; dimensions and metrics by the path they have."""

    metrics: dict[str, str]
    dimensions: dict[str, str] = field(default_factory=dict)
    items: str = ""


def _under(prefix: str, names: dict[str, str]) -> dict[str, str]:
    return {k: prefix + v for k, v in names.items()}


REPORTS: dict[str, Report] = {
    "cpu_summary": Report({"usage": "data.cpu.total_usage", **_under("data.cpu.total_stat.", _CPU)}),
    "cpu_usage": Report({"usage": "@"}, {"device_name": "cpu#"}, "data.cpu.per_usage"),
    "cpu_detail": Report(_under("@", _CPU), {"device_name": "@cpu"}, "data.cpu.per_stat"),
    "load": Report({f"load{n}": f"data.load.load_avg.load{n}" for n in (1, 5, 15)} | {"per_cpu_load": "data.load.per_cpu_load"}),
    "mem": Report(_under("data.mem.meminfo.", _MEM)),
    "swap": Report({"swap_in": "data.mem.swap_in", "swap_out": "data.mem.swap_out", "free": "data.mem.vmstat.free", "total": "data.mem.vmstat.total", "used": "data.mem.vmstat.used", "pct_used": "data.mem.vmstat.usedPercent"}),
    "net": Report(_under("@", _NET), {"device_name": "@name"}, "data.net.dev"),
    "netstat": Report({f"cur_tcp_{k}": f"data.net.netstat.{v}" for k, v in _STATES.items()} | {"cur_udp_indatagrams": "data.net.protocolstat.udp.inDatagrams", "cur_udp_outdatagrams": "data.net.protocolstat.udp.outDatagrams"}),
    "disk": Report({"free": "@free", "total": "@total", "used": "@used"}, {"device_name": "@device", "device_type": "@fstype", "mount_point": "@mountpoint"}, "data.disk.usage"),
    "inode": Report({"free": "@inodesFree", "total": "@inodesTotal", "used": "@inodesUsed"}, {"device_name": "@device", "mountpoint": "@mountpoint"}, "data.disk.usage"),
    "io": Report(_under("@", _IO), {"device_name": "@name"}, "data.disk.diskstat"),
    "env": Report({"timezone": "data.timezone", **_under("data.", _ENV)}, {"city": "data.city", "uname": "data.env.uname"}),
    "proc": Report({"cpu_pct": "@cpu_pct", "fd_open": "@fd_open", "mem_res": "@mem_res", "mem_pct": "@mem_pct"}, {"name": "@name", "pid": "@pid", "username": "@username", "state": "@state"}, "data.perf"),
    "proc_port": Report({"proc_exists": "@exists", "port_health": "@porthealth"}, {"bind_ip": "@bindip", "protocol": "@protocol", "name": "@name", "display_name": "@displayname"}, "data.processes"),
}
#: Ratios that follow from other figures: numerator, denominator; in percent.
RATIOS = {"mem": {"pct_used": ("used", "total"), "pct_usable": ("usable", "total")}, "disk": {"in_use": ("used", "total")}, "inode": {"in_use": ("used", "total")}, "swap": {}}


def _at(df: DataFrame, path: str) -> Column | None:
    """The column at a dotted path, or nothing where the schema has none."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return F.col(path)


def host_rows(df: DataFrame, report: str, keep: tuple[str, ...] = (), time: str = "data.utctime") -> DataFrame:
    """``keep..., time, dimensions, metrics`` of a report's table: time in epoch seconds (null where it can't be read), dimensions as texts, metrics as doubles.

    What the schema doesn't hold, what is null and what is no number is left out; rows without any metric don't come out; empty lists give no row."""
    spec = REPORTS[report]
    rows = df
    if spec.items:
        if _at(df, spec.items) is None:
            rows = df.where(F.lit(False)).withColumn("_place", F.lit(0)).withColumn("_item", F.lit(None).cast("struct<>"))
        else:
            rows = df.select("*", F.posexplode(spec.items).alias("_place", "_item"))

    def column(path: str) -> Column | None:
        if path == "@":
            return F.col("_item")
        if "#" in path:
            return F.concat(F.lit(path.replace("#", "")), F.col("_place").cast("string"))
        return _at(rows, "_item." + path[1:]) if path.startswith("@") else _at(rows, path)

    def number(c: Column) -> Column:
        v = c.try_cast("double")
        return F.when(~F.isnan(v), v)

    figures = {k: number(c) for k, p in spec.metrics.items() if (c := column(p)) is not None}
    for name, (a, b) in RATIOS.get(report, {}).items():
        if name not in figures and a in figures and b in figures:
            figures[name] = F.when(figures[b] > 0, figures[a] * 100.0 / figures[b])
    told = {k: c.cast("string") for k, p in {**REPORTER, **spec.dimensions}.items() if (c := column(p)) is not None}
    as_map = lambda pairs, kind: F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).cast(f"map<string,{kind}>"), lambda _, v: v.isNotNull())
    stamp = _at(df, time)
    at = F.floor(utc_us(df.sparkSession, stamp) / 1_000_000).cast("long") if stamp is not None else F.lit(None).cast("long")
    out = rows.select(*keep, at.alias("time"), as_map(told, "string").alias("dimensions"), as_map(figures, "double").alias("metrics"))
    return out.where(F.size("metrics") > 0)
