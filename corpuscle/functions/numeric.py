"""Numbers: money, vectors, ranks, queues. Plain columns unless a function says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the capacity model.
SATURATION = 0.95
MINUTES_PER_MONTH = 43_200
SLO_LADDER = (0.99, 0.995, 0.999, 0.9995, 0.9999)
RPS_CEILING, RPS_TOLERANCE, BISECTIONS = 100_000.0, 0.5, 40
CONNECTIONS_CEILING = 5000
MEMORY_GIB_PER_UNIT = {"t": 8, "m": 8, "c": 4, "r": 16, "x": 64}
UNITS_BY_SIZE = {"micro": 0.125, "small": 0.25, "medium": 0.5, "large": 1, "xlarge": 2, "2xlarge": 4, "4xlarge": 8, "8xlarge": 16, "12xlarge": 24, "16xlarge": 32, "24xlarge": 48}
CONNECTION_BYTES = {"postgres": 9_531_392, "mysql": 12_582_880, "mariadb": 12_582_880}


def half_up(x: Column, scale: int = 1) -> Column:
    """Rounds halves towards plus infinity at 1/scale."""
    return F.floor(x * scale + 0.5) / scale


def usd(x: Column) -> Column:
    """An amount rounded to cents."""
    return half_up(x, 100)


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine, from 0 to 2; null for a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, 1 - dot(a, b) / scale)


def unit(a: Column) -> Column:
    """A vector scaled to length 1; a zero vector as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def erlang_b(servers: Column, offered: Column) -> Column:
    """Blocking probability by the recursion over the server count."""
    step = lambda b, n: offered * b / (n + offered * b)
    return F.aggregate(F.sequence(F.lit(1), servers.cast("int")), F.lit(1.0), step)


def erlang_c(servers: Column, utilisation: Column) -> Column:
    """Probability that an arrival waits."""
    c = F.greatest(F.lit(1), half_up(servers).cast("int"))
    b = erlang_b(c, c * utilisation)
    return F.when(~(utilisation > 0), 0.0).when(utilisation >= 1, 1.0).otherwise(b / (1 - utilisation * (1 - b)))


def kingman(arrival_cv: Column, service_cv: Column) -> Column:
    return (arrival_cv * arrival_cv + service_cv * service_cv) / 2


def queue(service_ms: Column, arrival_rps: Column, servers: Column, arrival_cv: Column | None = None, service_cv: Column | None = None, fixed: Column | None = None) -> Column:
    """Struct of a resource's queue: model, servers, utilisation, saturated, wait_probability, queue_ms, total_ms.

    Beyond the saturation threshold the wait stays at its value there.
    """
    one = F.lit(1.0)
    c = F.greatest(F.lit(1), half_up(servers).cast("int"))
    capacity = c * 1000.0 / service_ms
    rho = F.greatest(F.lit(0.0), arrival_rps) / capacity
    held = F.least(rho, F.lit(SATURATION))
    wait = erlang_c(c, held)
    wait_ms = wait / (capacity * (1 - held)) * 1000 * kingman(one if arrival_cv is None else arrival_cv, one if service_cv is None else service_cv)
    plain = ~(service_ms > 0) if fixed is None else (fixed | ~(service_ms > 0))
    plain = F.coalesce(plain, F.lit(True))
    served = F.greatest(F.lit(0.0), service_ms)
    return F.struct(
        F.when(plain, "fixed").when(c == 1, "m/m/1").otherwise("m/m/c").alias("model"), c.alias("servers"),
        F.when(plain, 0.0).otherwise(rho).alias("utilisation"), F.when(plain, False).otherwise(rho >= SATURATION).alias("saturated"),
        F.when(plain, 0.0).otherwise(wait).alias("wait_probability"), F.when(plain, 0.0).otherwise(wait_ms).alias("queue_ms"),
        F.when(plain, served).otherwise(wait_ms + service_ms).alias("total_ms"), served.alias("service_ms"))


def survival(q: Column, t: Column) -> Column:
    """Probability that a request spends longer than t ms at a queue: wait and service are exponential."""
    mu = 1 / q["service_ms"]
    nu = q["wait_probability"] / q["queue_ms"]
    gap = nu - mu
    served, p = F.exp(-mu * t), q["wait_probability"]
    alike = served * (1 - p + p * (1 + mu * t))
    general = (1 - p) * served + p * (nu * served - mu * F.exp(-nu * t)) / gap
    moving = F.when(~(q["queue_ms"] > 0) | ~(p > 0), served).when(F.abs(gap) < 1e-12 * mu, alike).otherwise(general)
    still = F.when(t < q["service_ms"], 1.0).otherwise(0.0)
    return F.when(t <= 0, 1.0).when((q["model"] == "fixed") | ~(q["service_ms"] > 0), still).otherwise(moving)


def percentile_ms(q: Column, quantile: float, steps: int = 80) -> Column:
    """Time that a share of requests does not exceed, by bisection of ``survival``; a fixed resource's is its time.

    The queue is bound once a row, not worked out anew at each step. ``predict.with_percentile`` does the same for batches.
    """
    return F.transform(F.array(q), lambda held: _percentile_ms(held, quantile, steps))[0]


def _percentile_ms(q: Column, quantile: float, steps: int) -> Column:
    target = F.lit(1 - quantile)
    # total_ms is the mean, so that survival at total_ms / (1 - quantile) is at most the target
    doublings = min(200, math.ceil(-math.log2(1 - quantile)) + 2) if 0 < quantile < 1 else 200
    high = F.aggregate(F.sequence(F.lit(1), F.lit(doublings)), F.greatest(q["total_ms"], F.lit(1.0)), lambda h, _: F.when(survival(q, h) > target, h * 2).otherwise(h))
    start = F.struct(F.lit(0.0).alias("lo"), high.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = survival(q, mid) > target
        done = s["hi"] - s["lo"] <= 1e-12 * F.greatest(F.lit(1.0), s["hi"])
        return F.struct(F.when(done | ~above, s["lo"]).otherwise(mid).alias("lo"), F.when(done | above, s["hi"]).otherwise(mid).alias("hi"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
    return F.when(q["model"] == "fixed", q["service_ms"]).otherwise((ends["lo"] + ends["hi"]) / 2)


def breaking_rate(usage, limit: Column) -> Column:
    """Least request rate at which ``usage(rate)``, which never falls, reaches a limit.

    0 if it does at rest, null if not even at the ceiling or the limit is null; else the upper end of a bracket no wider than the tolerance.
    """
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(RPS_CEILING).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        done, reached = s["hi"] - s["lo"] <= RPS_TOLERANCE, usage(mid) >= limit
        return F.struct(F.when(done | reached, s["lo"]).otherwise(mid).alias("lo"), F.when(done | ~reached, s["hi"]).otherwise(mid).alias("hi"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)
    return F.when(limit.isNull() | (usage(F.lit(RPS_CEILING)) < limit), F.lit(None).cast("double")).when(usage(F.lit(0.0)) >= limit, 0.0).otherwise(ends["hi"])


def little(rps: Column, seconds: Column) -> Column:
    """Requests in flight: rate times time spent."""
    return rps * seconds


def arrival_rate(requests_per_month: Column, hours_per_month: Column) -> Column:
    return F.when(hours_per_month > 0, requests_per_month / (hours_per_month * 3600)).otherwise(0.0)


def mean_of_median(median: Column) -> Column:
    """Mean of an exponential time with this median."""
    return median / F.log(F.lit(2.0))


def downtime_minutes(availability: Column) -> Column:
    """Minutes a month, to a tenth."""
    return half_up((1 - availability) * MINUTES_PER_MONTH, 10)


def max_connections(instance_class: Column, engine: Column) -> Column:
    """Default connection limit of a database instance; the ceiling for classes and engines not known."""
    lookup = lambda d, key: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in (kv[0], float(kv[1])))), key)
    pattern = r"^db\.([a-z])[0-9]+[a-z]*\.(.+)$"
    known = instance_class.rlike(pattern)
    gib = lookup(MEMORY_GIB_PER_UNIT, F.regexp_extract(instance_class, pattern, 1)) * lookup(UNITS_BY_SIZE, F.regexp_extract(instance_class, pattern, 2))
    fits = F.floor(F.try_divide(F.when(known, gib) * float(2**30), lookup(CONNECTION_BYTES, engine)))
    return F.least(F.lit(CONNECTIONS_CEILING), F.coalesce(fits, F.lit(CONNECTIONS_CEILING))).cast("long")


def rrf(ranks_and_weights: list[tuple[Column, float]], k: int = 60) -> Column:
    """Reciprocal rank fusion: sum of weight / (k + rank) over the lists that have the item."""
    return sum((F.coalesce(F.lit(w) / (k + r), F.lit(0.0)) for r, w in ranks_and_weights), F.lit(0.0))


def bm25_weight(idf, tf, length, mean_length, k1: float = 1.2, b: float = 0.75):
    """A term's part of a score; of columns, numbers or arrays."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def bm25_term(tf: Column, df: Column, docs: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return bm25_weight(F.log(1 + (docs - df + 0.5) / (df + 0.5)), tf, length, mean_length, k1, b)


def search_breadth(limit: Column) -> Column:
    """Candidates that an approximate index would look at for a limit."""
    return F.least(F.lit(400), F.greatest(F.lit(40), 4 * limit))
