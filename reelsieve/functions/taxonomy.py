"""Names of sentiments and topics by their number, extension groups by type of video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
SENTIMENTS = (
    "active afraid alarmed alert amazed amused angry calm cheerful confident conscious creative disturbed eager educated "
    "emotional empathetic fashionable feminine grateful inspired jealous loving manly persuaded pessimistic proud sad thrifty youthful"
).split()
TOPICS = (
    "restaurant chocolate chips seasoning petfood alcohol coffee soda cars electronics phone_tv_internet_providers financial "
    "education security software other_service beauty healthcare clothing baby game cleaning home_improvement home_appliance "
    "travel media sports shopping gambling environment animal_right human_right safety smoking_alcohol_abuse domestic_violence "
    "self_esteem political charities"
).split()
AD_TYPES = ("product_demo", "testimonial", "brand_awareness", "tutorial", "entertainment")
KEYWORDS = ("off", "sale", "discount", "free", "save", "deal", "limited", "now", "today", "buy", "get", "order", "call", "visit", "sign up", "download", "try", "percent", "%", "$", "price", "cost")


def names(spark: SparkSession, words: list[str], column: str) -> DataFrame:
    """A dimension of (id, name), numbered from 1; a few dozen rows."""
    return spark.createDataFrame([(i, w) for i, w in enumerate(words, 1)], f"id int, {column} string")
