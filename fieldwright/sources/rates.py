"""Rate cards: a catalogue of models with prices a token, read offline, as prices a million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE_DDL = "data array<struct<id:string,pricing:map<string,string>,architecture:struct<input_modalities:array<string>,modality:string>,context_length:long>>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row for each model of a catalogue's JSON."""
    return spark.read.schema(CATALOGUE_DDL).option("multiLine", True).json(path).select(F.inline("data"))


def per_million(pricing: Column, kind: str) -> Column:
    """A price a million tokens: 0 where none is named, null where what is named is no number."""
    named = F.coalesce(F.map_contains_key(pricing, kind), F.lit(False))
    return F.round(F.when(named, pricing[kind].try_cast("double")).otherwise(0.0) * 1e6, 6)


def sees_images(modalities: Column, modality: Column) -> Column:
    """Whether `image` is one of the inputs listed; without a list, whether the modality's text names it."""
    listed = F.coalesce(F.array_contains(modalities, "image"), F.lit(False))
    return F.when(modalities.isNotNull(), listed).otherwise(F.coalesce(F.contains(modality, F.lit("image")), F.lit(False)))


def rates(catalogue: DataFrame) -> DataFrame:
    """(id, input_per_mtok, output_per_mtok, vision, context) of models with prices that are numbers and not negative."""
    c = catalogue.select(
        "id", per_million(F.col("pricing"), "prompt").alias("input_per_mtok"), per_million(F.col("pricing"), "completion").alias("output_per_mtok"),
        sees_images(F.col("architecture.input_modalities"), F.col("architecture.modality")).alias("vision"), F.col("context_length").alias("context"),
    )
    return c.where("input_per_mtok >= 0 AND output_per_mtok >= 0")


def vision_models(card: DataFrame, most: float | None = None) -> DataFrame:
    """The models that read images, up to an input price."""
    seeing = card.where("vision")
    return seeing if most is None else seeing.where(F.col("input_per_mtok") <= most)
