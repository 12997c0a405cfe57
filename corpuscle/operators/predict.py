"""Cost, latency, capacity and availability predictions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import numeric
from corpuscle.operators.batches import in_batches

GRID_POINTS, TAIL_MASS, SPAN = 1024, 1e-6, 4  # fixed values of the latency grid

#: Kinds that take no part in serving a request.
NON_SERVING = ["vpc", "subnet", "security_group", "iam_role", "internet_gateway", "cloudwatch_log_group", "ecs_cluster"]


def serving(resources: DataFrame, kind: str = "kind") -> DataFrame:
    """Resources that a request stops at; an unknown kind serves."""
    return resources.where(~F.coalesce(F.col(kind).isin(NON_SERVING), F.lit(False)))


def applicable_limits(resources: DataFrame, limits: DataFrame) -> DataFrame:
    """Resources with the limits of their service that apply to them.

    resources: id, service, kind. limits: limit_id, service, applies (the kinds that it applies to; null: all), value.
    """
    return resources.join(limits, "service").where(F.col("applies").isNull() | F.array_contains("applies", F.col("kind")))


# -- cost


def resource_cost(resources: DataFrame, hourly: DataFrame, storage: DataFrame, hours: float, region: str) -> DataFrame:
    """Monthly cost of database instances: id, monthly_usd, unpriced (sorted names of what has no rate).

    resources: id, region, engine, class, deployment, storage_type, storage_gb, backup_days. hourly: engine, class,
    deployment, hour_usd. storage: storage_type, deployment, gb_usd. Rates of another region are not used.
    """
    rows = resources.join(F.broadcast(hourly), ["engine", "class", "deployment"], "left").join(F.broadcast(storage), ["storage_type", "deployment"], "left")
    here = F.col("region") == region
    cents = lambda x: F.coalesce(numeric.usd(x), F.lit(0.0))
    missing = F.array_compact(F.array(
        F.when(~here, F.concat(F.lit("region:"), "region")), F.when(here & F.col("hour_usd").isNull(), F.concat(F.lit("instanceClass:"), "class")),
        F.when(here & F.col("gb_usd").isNull(), F.concat(F.lit("storageType:"), "storage_type")), F.when(here & F.col("storage_type").isin("io1", "io2"), F.lit("provisionedIops")),
        F.when(here & (F.coalesce("backup_days", F.lit(7)) > 0), F.lit("backupStorageBeyondAllocated"))))
    total = F.when(here, numeric.usd(cents(F.col("hour_usd") * hours) + cents(F.col("gb_usd") * F.col("storage_gb")))).otherwise(0.0)
    return rows.select("id", total.alias("monthly_usd"), F.array_sort(missing).alias("unpriced"))


def roll_up(costs: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Sums in whole cents, so that the order of addition does not matter."""
    return costs.groupBy(*keys).agg((F.sum(F.floor(F.col(amount) * 100 + 0.5)) / 100).alias("total_usd"), F.count("*").alias("items"))


def sensitivity(rows: DataFrame, id_col: str, cost, assumptions: dict[str, float], probe: float = 1.000001) -> DataFrame:
    """(id, assumption) for every assumption whose small change moves a row's cost.

    ``cost`` maps a dict of columns, one an assumption, to a column; each assumption costs one more column, no join.
    """
    base = {k: F.lit(v) for k, v in assumptions.items()}
    moved = [F.when(cost(base | {k: F.lit(v * probe)}) != cost(base), F.lit(k)) for k, v in assumptions.items()]
    return rows.select(id_col, F.explode(F.array_compact(F.array(*moved))).alias("assumption"))


def revise(estimates: DataFrame, affected: DataFrame, id_col: str, recomputed: DataFrame) -> DataFrame:
    """Estimates with the affected rows priced anew and the others carried over; ``fresh`` tells which."""
    again = recomputed.join(affected, id_col, "left_semi").withColumn("fresh", F.lit(True))
    kept = estimates.join(affected, id_col, "left_anti").withColumn("fresh", F.lit(False))
    return again.unionByName(kept)


# -- latency


def contribution(rows: DataFrame, override: Column, contract: Column, default: Column) -> DataFrame:
    """Adds service_ms by precedence, where it came from, and the resource's queue."""
    source = F.when(override.isNotNull(), "override").when(contract.isNotNull(), "contract").otherwise("default")
    rows = rows.withColumns({"service_ms": F.coalesce(override, contract, default), "basis": source})
    return rows.withColumn("queue", numeric.queue(F.col("service_ms"), F.col("arrival_rps"), F.col("servers")))


def _mass(q, step: float) -> np.ndarray:
    """Probability mass of a resource's time on the grid; the negligible tail falls into one bin."""
    mass = np.zeros(GRID_POINTS)
    if q.model == "fixed" or q.service_ms <= 0:
        mass[min(GRID_POINTS - 1, max(0, int(q.service_ms // step)))] = 1
        return mass
    t, mu, p = np.arange(1, GRID_POINTS) * step, 1 / q.service_ms, q.wait_probability
    above = np.exp(-mu * t)
    if q.queue_ms > 0 and p > 0:
        nu = p / q.queue_ms
        gap = nu - mu
        if abs(gap) < 1e-12 * mu:
            above = above * (1 - p + p * (1 + mu * t))
        else:
            above = (1 - p) * above + p * (nu * above - mu * np.exp(-nu * t)) / gap
    small = np.flatnonzero(above < TAIL_MASS)
    if len(small):
        above[small[0] :] = 0
    edges = np.concatenate([[1.0], above, [0.0]])
    return np.maximum(0, edges[:-1] - edges[1:])


def convolve(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Distribution of a sum; what lies beyond the grid counts in its last bin. None: no time as yet."""
    if a is None:
        return b
    full = np.convolve(a, b)
    out = full[:GRID_POINTS].copy()
    out[-1] += full[GRID_POINTS:].sum()
    return out


def slowest(branches: list[np.ndarray]) -> np.ndarray:
    """Distribution of the greatest of independent times: product of the cumulative shares, differenced."""
    both = np.prod([np.cumsum(b) for b in branches], axis=0)
    out = np.maximum(0, np.diff(both, prepend=0))
    out[-1] += max(0.0, 1 - both[-1])
    return out


def quantile(mass: np.ndarray, q: float, step: float) -> float:
    if q <= 0:
        return 0.0
    upto = np.cumsum(mass)
    k = int(np.searchsorted(upto, q))
    if k >= len(mass):
        return len(mass) * step
    before = upto[k] - mass[k]
    return (k + ((q - before) / mass[k] if mass[k] > 0 else 0.0)) * step


def path_latency(segments: DataFrame, path: str = "path") -> DataFrame:
    """path, mean_ms, p50_ms, p95_ms, p99_ms, saturated (ids) of request paths.

    segments: path, pos, branch (null: in line; else the branches of one pos run in parallel), step, id, queue, p99.
    Times in line add up by convolution, parallel branches take the slowest; a mean in line is the sum of means, that of a
    fan-out is read off the grid. A path's few resources are one row's work; paths spread over tasks, many to a batch.
    """

    def compose(rows: list[dict]) -> list:
        first = lambda v: (v is not None, v if v is not None else 0)
        rows.sort(key=lambda r: (first(r["pos"]), first(r["branch"]), first(r["step"])))
        span = SPAN * sum(r["p99"] for r in rows if r["p99"] is not None)
        step = (span if span > 0 else 1.0) / GRID_POINTS
        mass = lambda r: _mass(SimpleNamespace(**r["queue"]), step)
        total, mean = None, 0.0
        for _, part in groupby(rows, key=lambda r: r["pos"]):
            branches = []
            for branch, inner in groupby(part, key=lambda r: r["branch"]):
                one = None
                for r in inner:
                    if branch is None:
                        total, mean = convolve(total, mass(r)), mean + r["queue"]["total_ms"]
                    else:
                        one = convolve(one, mass(r))
                if one is not None:
                    branches.append(one)
            if branches:
                most = slowest(branches) if len(branches) > 1 else branches[0]
                total, mean = convolve(total, most), mean + float((most * (np.arange(GRID_POINTS) + 0.5)).sum() * step)
        full = sorted(r["id"] for r in rows if r["queue"]["saturated"])
        return [mean, *(quantile(total, q, step) for q in (0.5, 0.95, 0.99)), full]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [compose(rows) for rows in b.column(1).to_pylist()]
            columns = [pa.array([x[k] for x in done], pa.float64() if k < 4 else pa.list_(pa.string())) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [path, "mean_ms", "p50_ms", "p95_ms", "p99_ms", "saturated"])

    kind = segments.schema[path].dataType.simpleString()
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes, much work, not to be put together
    held = segments.repartition(parts, path).groupBy(path).agg(F.collect_list(F.struct("pos", "branch", "step", "id", "queue", "p99")).alias("held"))
    return in_batches(held, solve, f"{path} {kind}, mean_ms double, p50_ms double, p95_ms double, p99_ms double, saturated array<string>")


# -- capacity


def bottlenecks(resources: DataFrame, limits: DataFrame) -> DataFrame:
    """id, limit_id, breaking_rps and rank of every limit that a rate within the ceiling reaches, the first to break first.

    resources: id, service, servers, service_ms. limits: limit_id, service ('*': all), value. Usage is the number of requests
    in flight, by Little's law, over the time spent in the resource's queue at that rate.
    """
    from corpuscle.operators.relational import wildcard_join

    rows = wildcard_join(resources, limits, "service").select("id", "limit_id", *(F.col(c).cast("double") for c in ("service_ms", "servers", "value")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            service, servers, limit = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            usage = lambda rps: rps * total_ms(service, rps, servers) / 1000  # noqa: E731, B023
            lo, hi = np.zeros(len(limit)), np.full(len(limit), numeric.RPS_CEILING)
            for _ in range(numeric.BISECTIONS):
                mid = (lo + hi) / 2
                reached, open_ = usage(mid) >= limit, hi - lo > numeric.RPS_TOLERANCE
                lo, hi = np.where(open_ & ~reached, mid, lo), np.where(open_ & reached, mid, hi)
            rate = np.where(usage(np.zeros(len(limit))) >= limit, 0.0, hi)
            breaks = usage(np.full(len(limit), numeric.RPS_CEILING)) >= limit
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rate, pa.float64())], ["id", "limit_id", "breaking_rps"]).filter(pa.array(breaks))

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "limit_id")}
    found = rows.mapInArrow(solve, f"id {kinds['id']}, limit_id {kinds['limit_id']}, breaking_rps double")
    return found.orderBy("breaking_rps", "id", "limit_id")


def total_ms(service: np.ndarray, rps: np.ndarray, servers: np.ndarray) -> np.ndarray:
    """Time in a queue of exponential times, for whole arrays: ``numeric.queue`` on every row at once. Null counts as no limit's reach."""
    c = np.maximum(1, np.floor(np.nan_to_num(servers, nan=1.0) + 0.5))
    with np.errstate(divide="ignore", invalid="ignore"):
        capacity = c * 1000.0 / service
        rho = np.minimum(np.maximum(0.0, rps) / capacity, numeric.SATURATION)
        offered, blocked, wait = c * rho, np.ones(len(c)), np.zeros(len(c))
        for n in range(1, int(c.max(initial=0)) + 1):
            blocked = np.where(n <= c, offered * blocked / (n + offered * blocked), blocked)
        wait = np.where(rho > 0, blocked / (1 - rho * (1 - blocked)), 0.0)
        waited = wait / (capacity * (1 - rho)) * 1000
    return np.where(service > 0, waited + service, np.maximum(0.0, np.nan_to_num(service)))


def with_percentile(rows: DataFrame, queue: str, q: float, name: str, steps: int = 80) -> DataFrame:
    """Adds the time that a share q of a queue's requests does not exceed: ``numeric.percentile_ms`` for a batch at once."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(b.schema.get_field_index(queue))
            field = lambda k: held.field(k).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731, B023
            service, wait, p, total = (field(k) for k in ("service_ms", "queue_ms", "wait_probability", "total_ms"))
            fixed = np.array([m == "fixed" for m in held.field("model").to_pylist()], bool)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                mu, nu = 1 / service, p / wait

                def above(t: np.ndarray, mu=mu, nu=nu, p=p, wait=wait) -> np.ndarray:
                    served, gap = np.exp(-mu * t), nu - mu
                    moving = np.where(np.abs(gap) < 1e-12 * mu, served * (1 - p + p * (1 + mu * t)), (1 - p) * served + p * (nu * served - mu * np.exp(-nu * t)) / gap)
                    return np.where(t <= 0, 1.0, np.where((wait > 0) & (p > 0), moving, served))

                lo, hi = np.zeros(len(total)), np.maximum(total, 1.0)
                for _ in range(200):
                    short = above(hi) > 1 - q
                    if not short.any():
                        break
                    hi = np.where(short, hi * 2, hi)
                for _ in range(steps):
                    mid = (lo + hi) / 2
                    more, done = above(mid) > 1 - q, hi - lo <= 1e-12 * np.maximum(1.0, hi)
                    lo, hi = np.where(~done & more, mid, lo), np.where(~done & ~more, mid, hi)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(fixed, service, (lo + hi) / 2), pa.float64())], [*b.schema.names, name])

    return rows.mapInArrow(solve, rows.withColumn(name, F.lit(0.0)).schema)


# -- availability


def parallel(availability: str, correlation: float) -> Column:
    """Availability of arms of which one suffices, a share of failures taking all at once."""
    independent = F.product(1 - F.col(availability))
    return 1 - ((1 - correlation) * independent + correlation * (1 - F.min(availability)))


def composite(members: DataFrame, correlation: float = 0.1) -> DataFrame:
    """One row: composite availability, weakest member, downtime a month.

    members: id, group, zone, availability. Members of a zone multiply, zones stand in for each other, groups multiply.
    """
    arms = members.groupBy("group", "zone").agg(F.product("availability").alias("arm"))
    groups = arms.groupBy("group").agg(parallel("arm", correlation).alias("a"))
    whole = groups.agg(F.coalesce(F.product("a"), F.lit(1.0)).alias("composite"))
    weakest = members.agg(F.min_by("id", F.struct("availability", "id")).alias("weakest"))
    return whole.join(F.broadcast(weakest)).withColumn("downtime_minutes", numeric.downtime_minutes(F.col("composite")))


def objective(composite_: Column) -> Column:
    """Struct: the highest rung of the ladder met, the next one, the error budget in minutes; nulls below it."""
    rungs = F.array(*map(F.lit, numeric.SLO_LADDER))
    met = F.array_max(F.filter(rungs, lambda r: r <= composite_))
    return F.struct(met.alias("target"), F.array_min(F.filter(rungs, lambda r: r > composite_)).alias("next"), numeric.downtime_minutes(met).alias("budget_minutes"))


def best_practices(instances: DataFrame) -> DataFrame:
    """id, rule, severity of database instances that are not spread over zones, keep no backups or are burstable.

    instances: id, class, multi_az, backup_days.
    """
    rules = F.array_compact(F.array(
        F.when(~F.coalesce("multi_az", F.lit(False)), F.struct(F.lit("multi-az").alias("rule"), F.lit("high").alias("severity"))),
        F.when(F.coalesce("backup_days", F.lit(7)) == 0, F.struct(F.lit("backups").alias("rule"), F.lit("high").alias("severity"))),
        F.when(F.col("class").rlike(r"^db\.t[0-9]"), F.struct(F.lit("burstable").alias("rule"), F.lit("low").alias("severity")))))
    return instances.select("id", F.explode(rules).alias("r")).select("id", "r.*")
