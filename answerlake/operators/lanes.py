"""Place and band joins: hierarchy cover, fee lookup, domestic scope, numeric ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake.session import small_side


def closure(places: DataFrame) -> DataFrame:
    """(place, ancestor) rows of a place table (place, country, region), itself included."""
    up = F.array_compact(F.array_distinct(F.array("place", "country", "region")))
    return places.select("place", F.explode(up).alias("ancestor")).distinct()


def covered(asked: DataFrame, stated: DataFrame, tree: DataFrame) -> DataFrame:
    """Marks each asked (ident, place) row by whether the text of ``ident`` names the
    place or anything that contains it."""
    forms = asked.join(small_side(tree), "place")
    hits = forms.join(stated.select("ident", F.col("place").alias("ancestor")), ["ident", "ancestor"], "left_semi")
    found = hits.select("ident", "place").distinct().withColumn("hit", F.lit(True))
    return asked.join(found, ["ident", "place"], "left").withColumn("covered", F.coalesce("hit", F.lit(False))).drop("hit")


def scope(origin: Column, destination: Column, home: tuple) -> Column:
    return F.when(origin.isin(*home) & destination.isin(*home), "domestic").otherwise("international")


def quote_fee(segments: DataFrame, fees: DataFrame, places: DataFrame, hub: str, home: tuple[str, ...]) -> DataFrame:
    """Fee of each segment by (hub or other, region or domestic); NULL when the table
    has no such cell. ``fees`` is (row_key, column_key, amount)."""
    region = small_side(places.select(F.col("place").alias("far"), "region"))
    far = F.when(F.col("destination") == hub, F.col("origin")).otherwise(F.col("destination"))
    rows = segments.withColumn("far", far).join(region, "far", "left").withColumns({
        "row_key": F.when(F.col("origin") == hub, "hub").otherwise("other"),
        "column_key": F.when(scope(F.col("origin"), F.col("destination"), home) == "domestic", "domestic")
        .otherwise(F.col("region"))})
    return rows.join(small_side(fees), ["row_key", "column_key"], "left").drop("far", "region")


def band_join(values: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= value <= high as an equi-join on buckets of ``width``, never
    a nested loop. Pre-aggregate ``values`` when many rows share a value."""
    at = F.floor(F.col(value) / width)
    steps = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    left = values.withColumn("bucket", at)
    right = bands.filter(F.col(low) <= F.col(high)).withColumn("bucket", F.explode(steps))
    return left.join(small_side(right), "bucket").filter(F.col(value).between(F.col(low), F.col(high))).drop("bucket")
