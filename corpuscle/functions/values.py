"""Arrays, maps, JSON and lenient conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units by the spellings that offers use. An unknown unit drops its row.
UNITS = {
    "hrs": "Hrs", "hr": "Hrs", "hour": "Hrs", "hours": "Hrs", "gb-mo": "GB-Mo", "gb-month": "GB-Mo", "gb-months": "GB-Mo", "gb": "GB", "gigabytes": "GB",
    "requests": "Requests", "request": "Requests", "api requests": "Requests", "iops-mo": "IOPS-Mo", "acu-hr": "ACU-Hr", "acu-hrs": "ACU-Hr",
    "lcu-hrs": "LCU-Hrs", "lcu-hr": "LCU-Hrs", "vcpu-hours": "vCPU-Hours", "vcpu-hrs": "vCPU-Hours",
}


def distinct_sorted(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def get_or(m: Column, key, default: Column) -> Column:
    return F.coalesce(F.element_at(m, key), default)


def present(m: Column) -> Column:
    """A map without null values."""
    return F.map_filter(m, lambda _, v: v.isNotNull())


def sorted_map(m: Column) -> Column:
    """A map's entries in key order, as an array of structs."""
    return F.array_sort(F.map_entries(m))


def pointer(*parts) -> Column:
    """A JSON pointer; '~' and '/' in parts are escaped."""
    cells = [F.lit(p) if isinstance(p, (str, int)) else p for p in parts]
    escaped = [F.regexp_replace(F.regexp_replace(c.cast("string"), "~", "~0"), "/", "~1") for c in cells]
    return F.concat(*(x for c in escaped for x in (F.lit("/"), c)))


def nested(m: Column, *keys) -> Column:
    """A value some maps down, null where a key is missing."""
    for k in keys:
        m = F.try_element_at(m, F.lit(k) if isinstance(k, str) else k)
    return m


def either_case(document: Column, camel: str, snake: str) -> Column:
    return F.coalesce(F.get_json_object(document, f"$.{camel}"), F.get_json_object(document, f"$.{snake}"))


def port(text: Column) -> Column:
    """First number of a port declaration if it is a port; a range gives its low end, a protocol is ignored."""
    n = F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long")
    return F.when(n.between(1, 65535), n.cast("int"))


def container_port(text: Column) -> Column:
    """Container side of a compose port: what follows the last ':' before a protocol."""
    return port(F.element_at(F.split(F.regexp_replace(text, "/.*$", ""), ":"), -1))


def lenient_int(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(-?\d+)", 1).try_cast("long")


def lenient_flag(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "1", "on"), True).when(low.isin("false", "no", "0", "off"), False)


def unit_name(unit: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    return F.try_element_at(table, F.lower(F.trim(unit)))
