"""Seed dimensions from literals (S10): the five sports and five products.

Fixed-size literal tables: they are the one kind of input whose size is
known in advance, so they are always safe to broadcast as dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchflow.functions import constants as K
from matchflow.schemas import PRODUCT, SPORT


def seed_sports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SEED_SPORTS, SPORT)


def seed_products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SEED_PRODUCTS, PRODUCT)
