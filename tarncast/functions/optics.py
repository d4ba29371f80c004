"""Temperature compensation of fluorescence and trophic state indices."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published compensation: slope per degree and reference temperature.
RHO = -0.01
REFERENCE_TEMPERATURE = 20.0
RHO_SWEEP = (-0.008, -0.010, -0.012)


def compensation_factor(temperature: Column, rho=RHO, reference=REFERENCE_TEMPERATURE) -> Column:
    return 1 + rho * (temperature - reference)


def compensate(reading: Column, temperature: Column, rho=RHO, reference=REFERENCE_TEMPERATURE) -> Column:
    """Reading corrected to the reference temperature; applies to single readings, not to means."""
    return reading / compensation_factor(temperature, rho, reference)


def uncompensate(reading: Column, temperature: Column, rho=RHO, reference=REFERENCE_TEMPERATURE) -> Column:
    """The raw reading behind a compensated one."""
    return reading * compensation_factor(temperature, rho, reference)


# Carlson's trophic state indices, with his published constants.
def tsi_secchi(depth: Column) -> Column:
    return 60 - 14.41 * F.ln(depth)


def tsi_chlorophyll(chla: Column) -> Column:
    return 9.81 * F.ln(chla) + 30.6


def tsi_phosphorus(tp: Column) -> Column:
    return 14.42 * F.ln(tp) + 4.15
