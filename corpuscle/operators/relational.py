"""Joins, folds and picks with fixed semantics over any tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], order: list, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in an order that has no ties."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= keep).drop("__r")


def attach_latest(left: DataFrame, right: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Left rows with the first right row of their key, or nulls: a lateral join with limit 1."""
    return left.join(latest(right, keys, order), keys, "left")


def in_given_order(rows: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays as rows with their place, from 1."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("ord", "z")
    return rows.select(*(c for c in rows.columns if c not in arrays), zipped).select("*", (F.col("ord") + 1).alias("place"), "z.*").drop("ord", "z")


def either_end(edges: DataFrame, nodes: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """Edges that touch a node at either end, each once: two semi-joins in place of an OR-join."""
    a, b = edges.join(nodes, edges[source] == nodes[node], "left_semi"), edges.join(nodes, edges[target] == nodes[node], "left_semi")
    return a.unionByName(b).distinct()


def longest_prefix(names: DataFrame, prefixes: DataFrame, name: str, prefix: str, sep: str = "/") -> DataFrame:
    """Names with the longest listed prefix, whole segments only, or null.

    A name's own prefixes are exploded and joined by equality; nothing compares all pairs.
    """
    parts = F.split(name, sep)
    tries = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep)))
    hits = names.select(name).distinct().withColumn("__p", tries).join(prefixes.select(F.col(prefix).alias("__p"), *[c for c in prefixes.columns if c != prefix]), "__p")
    best = hits.groupBy(name).agg(F.max_by("__p", F.length("__p")).alias(prefix))
    return names.join(best, name, "left")


def nearest_ancestor(paths: DataFrame, owners: DataFrame, path: str, owner: str) -> DataFrame:
    """Paths with the deepest owner that is the path's directory or one above it; '.' owns all, if listed."""
    parts = F.split(path, "/")
    tries = F.explode(F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    hits = paths.select(path).distinct().withColumn("__p", tries).join(owners.select(F.col(owner).alias("__p")).distinct(), "__p")
    depth = F.when(F.col("__p") == ".", 0).otherwise(F.size(F.split("__p", "/")))
    return paths.join(hits.groupBy(path).agg(F.max_by("__p", depth).alias(owner)), path, "left")


def only_match(asked: DataFrame, offers: DataFrame, on: list, id_col: str, take: list[str]) -> DataFrame:
    """Asked rows with the one offer that meets the condition; nulls if none or several do.

    Where the condition is columns of one name, offers are counted before the join, so that no pairs of a key are made.
    """
    if all(isinstance(c, str) for c in on):
        single = offers.groupBy(*on).agg(F.count("*").alias("__n"), *(F.min(c).alias(c) for c in take if c not in on)).where("__n = 1").drop("__n")
        found = single.withColumn("__met", F.lit(True))
        out = asked.join(found, on, "left")
        return out.select(*asked.columns, *((F.when(F.col("__met"), F.col(c)) if c in on else F.col(c)).alias(c) for c in take if c not in asked.columns))
    hits = asked.join(offers, on).groupBy(id_col).agg(F.count("*").alias("__n"), *(F.min(c).alias(c) for c in take)).where("__n = 1").drop("__n")
    return asked.join(hits, id_col, "left")


def wildcard_join(left: DataFrame, right: DataFrame, key: str, star: str = "*") -> DataFrame:
    """Left rows with right rows of their key or of the wildcard: two equi-joins, no OR."""
    exact = left.join(right.where(F.col(key) != star), key)
    any_ = left.withColumn("__s", F.lit(star)).join(right.where(F.col(key) == star).withColumnRenamed(key, "__s"), "__s").drop("__s")
    return exact.unionByName(any_)


def dangling(rows: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows with a reference that no target has."""
    return rows.where(F.col(ref).isNotNull()).join(targets, rows[ref] == targets[key], "left_anti")


#: Sources and targets of a tile of pairs, and how many ways the sources of a need are dealt.
TILE_SOURCES, TILE_TARGETS, SLOTS = 4096, 256, 32


def _dealt(rows: DataFrame, key: str, item: str, alike: Column, slots: int, size: int) -> DataFrame:
    """The distinct items of a key as sorted arrays ``__of`` of at most ``size``, all of one slot and alike."""
    held = rows.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item, alike.alias("__alike"), F.pmod(F.xxhash64(item), F.lit(slots)).cast("int").alias("__slot"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes, much work, not to be put together
    place = F.dense_rank().over(Window.partitionBy(key, "__slot", "__alike").orderBy(item))
    held = held.repartition(parts, key, "__slot").withColumn("__block", F.floor((place - 1) / size))
    return held.groupBy(key, "__slot", "__alike", "__block").agg(F.array_sort(F.collect_set(item)).alias("__of"))


def offered(needs: DataFrame, nodes: DataFrame, declared: DataFrame | Column, need: str, offer: str, source: str, target: str, alike: tuple[Column, Column] | None = None) -> DataFrame:
    """(source, target) where a node offers a capability that a source needs and no edge is declared.

    ``declared``: the edges, or where a rule gives them, that rule as a condition on the row. ``alike``: what the rule
    looks at, of a source and of a target; it changes the order of rows alone.

    There may be very many pairs. They are not shuffled: arrays of sources and of targets meet, and each two are a tile
    of pairs, written source by source. So a column's values repeat at once or after a few hundred rows, which files
    keep in a small part of the room that pairs in any order take. Each side is made distinct before they meet.
    """
    a, b = alike or (F.lit(0), F.lit(0))
    asked = _dealt(needs, need, source, a, SLOTS, TILE_SOURCES).select(need, "__slot", F.col("__of").alias("__sources"))
    offers = _dealt(nodes, offer, target, b, 1, TILE_TARGETS).select(offer, F.col("__of").alias("__targets"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("__to"))
    tiles = asked.join(offers.hint("merge"), (F.col(need) == F.col(offer)) & (F.col("__slot") == F.col("__to")))
    found = tiles.select(need, "__targets", F.explode("__sources").alias(source)).select(need, source, F.explode("__targets").alias(target))
    found = found.where(F.col(source) != F.col(target)).select(source, target, need)
    if isinstance(declared, Column):
        return found.where(~F.coalesce(declared, F.lit(False)))
    return found.join(declared.select(source, target), [source, target], "left_anti")


def allowed_pair(a: Column, b: Column, a_allows: Column, b_allows: Column) -> Column:
    """Whether either end's list allows the other."""
    return F.coalesce(F.array_contains(a_allows, b), F.lit(False)) | F.coalesce(F.array_contains(b_allows, a), F.lit(False))


def deepest_container(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, depth: str, cell: float) -> DataFrame:
    """Points (x, y) with the deepest box (x0, y0, x1, y1) that holds them, or null.

    Boxes are listed under the grid cells they meet, points under theirs; cells are joined by equality. Points at one
    place are looked up once, and of boxes that take the same part of a cell only the deepest stays there.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    cells = boxes.where("x0 <= x1 and y0 <= y1").withColumn("__cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("__cy", F.explode(F.sequence(at("y0"), at("y1"))))
    # a side beyond the cell holds all of the cell's points: null
    inner = lambda c, k: F.when(at(c) == F.col(k), F.col(c)).alias(f"__{c}")
    part = ["__cx", "__cy", "__x0", "__x1", "__y0", "__y1"]
    cells = cells.select("__cx", "__cy", inner("x0", "__cx"), inner("x1", "__cx"), inner("y0", "__cy"), inner("y1", "__cy"), F.struct(F.col(depth), F.col(box_id)).alias("__b"))
    cells = cells.groupBy(*part).agg(F.max("__b").alias("__b"))
    places = points.select("x", "y").where("x is not null and y is not null").distinct().withColumns({"__cx": at("x"), "__cy": at("y")})
    within = lambda c: (F.col(c) >= F.coalesce(f"__{c}0", c)) & (F.col(c) <= F.coalesce(f"__{c}1", c))
    best = places.join(cells, ["__cx", "__cy"]).where(within("x") & within("y")).groupBy("x", "y").agg(F.max("__b")[box_id].alias(box_id))
    return points.join(best, ["x", "y"], "left")


def first_of(rows: DataFrame, keys: list, order: str) -> DataFrame:
    """Rows less the later ones of each key."""
    return latest(rows, keys, [order])


def merged(rows: DataFrame, key: str, order: str, scalars: list[str], sets: list[str]) -> DataFrame:
    """One row a key: scalars take their first non-null value in order, arrays their distinct values, sorted."""
    one = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    many = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    return rows.groupBy(key).agg(*one, *many)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after changes, the last of each key winning; columns of the table."""
    last = latest(changes, keys, [F.desc(order)]).select(*table.columns)
    return table.join(last, keys, "left_anti").unionByName(last)


def coalescing_upsert(changes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Every state of a key: a null in a change keeps the value before."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return changes.select(key, order, *(F.last(c, ignorenulls=True).over(upto).alias(c) for c in columns))


def prefer(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``base``, and of ``extra`` what has no like key there."""
    return base.unionByName(extra.join(base, keys, "left_anti"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that appeared and disappeared, with state; last, one row of nulls whose state is ``unchanged`` and their number."""
    new, gone = after.exceptAll(before).withColumn("state", F.lit("appeared")), before.exceptAll(after).withColumn("state", F.lit("resolved"))
    stayed = before.intersectAll(after).agg(F.concat(F.lit("unchanged "), F.count(F.lit(1))).alias("state"))
    return new.unionByName(gone).unionByName(stayed, allowMissingColumns=True)


def duplicates(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The second and later rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__r", place).where("__r > 1").drop("__r")


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbours: keys, value, first and last order, length."""
    along = Window.partitionBy(*keys).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(along)) | (F.row_number().over(along) == 1)).cast("int")
    runs = rows.withColumn("__c", change).withColumn("__run", F.sum("__c").over(along))
    return runs.groupBy(*keys, "__run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__run")


def with_all(rows: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of a dimension with the sorted values it has, empty if none."""
    return dimension.join(rows, key, "left").groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(value))


def peer_key(links: DataFrame, node: str, peer: str) -> DataFrame:
    """Each node's distinct peers, sorted, as one text."""
    return links.groupBy(node).agg(F.array_join(F.array_sort(F.collect_set(peer)), ",").alias("peer_key"))


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check and number of rows that break it, zero included. A null counts as a break."""
    counted = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    return counted.unpivot([], list(checks), "check", "broken")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assumption_union(rows: DataFrame, keys: list[str], id_col: str, order: str, value: str, gap: str) -> DataFrame:
    """Of each key, ``assumptions`` (id and value of each id's last row in order, sorted by id) and ``gaps`` (distinct, sorted).

    Ids are reduced before they are gathered, so that a key holds one entry an id and not one a row.
    """
    each = rows.groupBy(*keys, id_col).agg(F.max_by(value, order).alias(value), F.collect_set(gap).alias(gap))
    pairs = F.array_sort(F.collect_list(F.when(F.col(id_col).isNotNull(), F.struct(id_col, value))))
    return each.groupBy(*keys).agg(pairs.alias("assumptions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(gap)))).alias("gaps"))


def evidence(rows: DataFrame, keys: list[str], rules: dict[str, Column], path: str) -> DataFrame:
    """Keys, rule and the distinct paths, sorted, of the rows for which that rule is the first to hold."""
    first = F.coalesce(*(F.when(held, F.lit(name)) for name, held in rules.items()))
    return rows.withColumn("rule", first).where("rule is not null").groupBy(*keys, "rule").agg(F.array_sort(F.collect_set(path)).alias("evidence"))


def several_active(runs: DataFrame, owner: str, status: str, active: list[str]) -> DataFrame:
    """Owners with more than one run in an active status, and how many: breaks of the rule that one may be."""
    return runs.where(F.col(status).isin(active)).groupBy(owner).agg(F.count("*").alias("active")).where("active > 1")
