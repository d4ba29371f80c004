"""Declared schemas of the shared tables; no source is read with inferred types."""

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in fields.items()])


TARGETS = _schema(
    datetime=DateType,
    site_id=StringType,
    depth_m=DoubleType,
    variable=StringType,
    observation=DoubleType,
)

DRIVERS = _schema(
    site_id=StringType,
    reference_datetime=DateType,
    datetime=DateType,
    variable=StringType,
    parameter=IntegerType,
    prediction=DoubleType,
)

# ``parameter`` is a string: it holds member numbers and parameter names alike.
FORECAST = _schema(
    datetime=DateType,
    reference_datetime=DateType,
    model_id=StringType,
    site_id=StringType,
    parameter=StringType,
    family=StringType,
    prediction=DoubleType,
    variable=StringType,
    depth_m=DoubleType,
    duration=StringType,
    project_id=StringType,
)

PRODUCTION_TARGETS = _schema(
    project_id=StringType,
    site_id=StringType,
    datetime=TimestampNTZType,
    duration=StringType,
    depth_m=DoubleType,
    variable=StringType,
    observation=DoubleType,
)

PROVENANCE = _schema(
    date=DateType,
    new_id=StringType,
    model_id=StringType,
    reference_date=StringType,
    pub_date=StringType,
)
