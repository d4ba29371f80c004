"""Season labels under the three rules in use."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_by_month(date: Column) -> Column:
    """Three-month meteorological seasons."""
    m = F.month(date)
    return (
        F.when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .when(m.isin(9, 10, 11), "Fall")
        .otherwise("Winter")
    )


def season_by_doy(date: Column) -> Column:
    """Seasons by day of year: short spring and fall around the mixing of the lake."""
    d = F.dayofyear(date)
    return (
        F.when(d.between(54, 68), "Spring")
        .when(d.between(69, 307), "Summer")
        .when(d.between(308, 353), "Fall")
        .otherwise("Winter")
    )


def stratified_or_mixed(date: Column) -> Column:
    """Two-season rule; months in neither season give NULL and are meant to be dropped."""
    m = F.month(date)
    return F.when(m.isin(7, 8, 9), "Summer").when(m.isin(11, 12, 1), "Winter")
