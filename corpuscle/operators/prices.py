"""Price offers: products filtered and sliced by rules, joined to the first tier of their terms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.values import UNITS

#: Attributes that a rate keeps, each with the offer's names for it, the first present winning.
ATTRIBUTES = {
    "instanceType": ["instanceType"], "databaseEngine": ["databaseEngine"], "storageClass": ["storageClass", "volumeApiName"],
    "deploymentOption": ["deploymentOption"], "cacheEngine": ["cacheEngine"], "memory": ["memory"], "vcpu": ["vcpu"],
}


@dataclass(frozen=True)
class Slice:
    """A rule for products: the families and attribute values it asks for, and the services whose rates they are."""

    services: tuple[str, ...]
    families: tuple[str, ...] = ()
    require: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def matches(self) -> Column:
        asked = [F.col("family").isin(*self.families)] if self.families else []
        asked += [F.element_at("attributes", name).isin(*values) for name, values in self.require.items()]
        met = F.lit(True)
        for one in asked:
            met = met & F.coalesce(one, F.lit(False))
        return met


def whitelisted(attributes: Column) -> Column:
    """The attributes that a rate keeps, by name; empty ones and 'NA' are dropped."""
    at = lambda names: F.coalesce(*(F.element_at(attributes, n) for n in names))
    every = F.map_from_arrays(F.array(*map(F.lit, ATTRIBUTES)), F.array(*map(at, ATTRIBUTES.values())))
    return F.map_filter(every, lambda _, v: v.isNotNull() & ~v.isin("", "NA"))


def offered_products(products: DataFrame, slices: list[Slice], regions: list[str]) -> DataFrame:
    """sku, region, services, usage_type, attributes of products on sale: of the current generation, without extended support.

    products: sku, family, attributes map. A product belongs to the first slice that it matches; the rules are one
    expression over its row, no join. A generation that is not named counts as current.
    """
    a = lambda name: F.element_at("attributes", name)
    first = F.coalesce(*(F.when(s.matches(), F.array(*map(F.lit, s.services))) for s in slices))
    current = F.coalesce(a("currentGeneration"), F.lit("")).isin("", "Yes") & ~F.lower(F.coalesce(a("usagetype"), F.lit(""))).contains("extendedsupport")
    rows = products.where(a("regionCode").isin(regions) & current).withColumn("services", first).where("services is not null")
    return rows.select("sku", a("regionCode").alias("region"), "services", F.coalesce(a("usagetype"), F.lit("")).alias("usage_type"), whitelisted(F.col("attributes")).alias("attributes"))


def first_tier(terms: DataFrame) -> DataFrame:
    """sku, unit, usd: of each sku's terms the least code, and of that the dimension that begins lowest (null: 0).

    terms: sku, term, begin, unit, usd; columns beyond these part terms that are alike so far, in their order, and then
    usd and unit do. One aggregate with a partial stage, however many terms a sku has.
    """
    further = [c for c in terms.columns if c not in ("sku", "term", "begin", "unit", "usd")]
    place = F.struct(F.col("term").cast("string"), F.coalesce(F.col("begin").cast("double"), F.lit(0.0)).alias("begin"), *further, "usd", "unit")
    return terms.groupBy("sku").agg(F.min_by(F.struct("unit", "usd"), place).alias("t")).select("sku", "t.*")


def price_rates(products: DataFrame, terms: DataFrame, slices: list[Slice], regions: list[str]) -> DataFrame:
    """service, region, sku, usage_type, unit, usd, attributes: one row a service, region and sku.

    Products and terms meet once, on sku, after products are filtered and terms reduced to their first tier. Rates in
    an unknown unit, or without a finite number, are left out.
    """
    units = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    tiers = first_tier(terms).select("sku", F.element_at(units, F.lower("unit")).alias("unit"), F.col("usd").cast("double").alias("usd"))
    good = tiers.where("unit is not null and usd is not null and not isnan(usd) and abs(usd) < double('infinity')")
    rows = offered_products(products, slices, regions).join(good, "sku").withColumn("service", F.explode("services"))
    return rows.dropDuplicates(["service", "region", "sku"]).select("service", "region", "sku", "usage_type", "unit", "usd", "attributes")
