"""Map layers: the data behind the place maps (drawing is left to the
caller)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import format_count, marker_radius
from ..functions.places import clean_place_exact
from .aggregate import place_aggregate, units_per_place


def centres_frame(spark: SparkSession, centres: Mapping[str, tuple[float, float]] = K.PLACE_CENTRES) -> DataFrame:
    """The centre dictionary as a literal table (place, lat, lon), whose size
    the planner knows."""
    places = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(float(v[0])).alias("lat"), F.lit(float(v[1])).alias("lon"))
                       for k, v in centres.items()])
    return spark.range(1).select(F.inline(places))


def join_centers(df: DataFrame, centres: DataFrame, place_col: str) -> DataFrame:
    """Attach coordinates; places without a centre are dropped."""
    c = centres.withColumnRenamed("place", "__place")
    return df.join(c, F.col(place_col) == F.col("__place"), "inner").drop("__place")


def asset_map_layer(register: DataFrame, centres: DataFrame, cleaner=clean_place_exact,
                    place_col: str = "kab_kota", value_col: str = "nilai_perolehan",
                    label: str = "Jumlah NUP") -> DataFrame:
    """Asset count and value per known place with coordinates, marker radius
    and popup text."""
    agg = place_aggregate(register, cleaner, centres, place_col=place_col, value_col=value_col)
    layer = join_centers(agg, centres, "kab_kota")
    popup = F.concat(F.lit("<b>"), F.col("kab_kota"), F.lit("</b><br>"), F.lit(label), F.lit(": "),
                     format_count(F.col("jumlah_aset")))
    return layer.select("kab_kota", "lat", "lon", "jumlah_aset", "total_nilai",
                        marker_radius(F.col("jumlah_aset"), K.MARKER_SCALE, K.MARKER_BASE, K.MARKER_MIN).alias("radius"),
                        popup.alias("popup"))


def unit_map_layer(units: DataFrame, centres: DataFrame, place: str | None = None, place_col: str = "Kab/Kota",
                   label: str = "Jumlah Satker") -> DataFrame:
    """Unit count per known place, fixed marker radius."""
    counts = units_per_place(units, place, place_col).filter(F.col("jumlah") > 0)
    layer = join_centers(counts, centres, place_col)
    popup = F.concat(F.lit("<b>"), F.col(place_col), F.lit("</b><br>"), F.lit(label), F.lit(": <b>"),
                     F.col("jumlah").cast("string"), F.lit("</b>"))
    return layer.select(F.col(place_col).alias("kab_kota"), "lat", "lon", "jumlah",
                        F.lit(K.MARKER_FIXED).alias("radius"), popup.alias("popup"))
