"""Units, calendars, links, projections and intervals as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors, calendar offset, the normal quantile of a 95 % interval,
# the ellipsoid and the parameters of the continental Albers projection.
KELVIN = 273.15
SECONDS_PER_DAY = 86_400.0
METRES_TO_MM = 1000.0
PRESENT_YEAR = 1950
MODEL_YEAR_OFFSET = 23_051
Z95 = 1.96
SEMI_MAJOR = 6_378_137.0
FLATTENING = 1 / 298.257222101
PARALLELS = (29.5, 45.5)
ORIGIN = (23.0, -96.0)
MISSING_PACKED = -32_768


def kelvin_to_celsius(v: Column) -> Column:
    return v - KELVIN


def rate_to_mm_per_day(v: Column, *, metres: bool) -> Column:
    """m/s where ``metres``, else kg/m2/s."""
    return v * (SECONDS_PER_DAY * METRES_TO_MM if metres else SECONDS_PER_DAY)


def months_of_ka(t: Column) -> Column:
    """Months since year 0 of a time in thousands of years before 1950 (negative for the past)."""
    return F.rint((F.lit(float(PRESENT_YEAR)) + t * 1000.0) * 12.0).cast("long")


def year_of_months(m: Column) -> Column:
    return F.floor(m / 12).cast("int")


def month_of_months(m: Column) -> Column:
    return (F.pmod(m, F.lit(12)) + 1).cast("int")


def model_year_to_ce(y: Column) -> Column:
    return y - MODEL_YEAR_OFFSET


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def tenths_per_month_to_daily(v: Column, year: Column, month: Column) -> Column:
    """Tenths of mm a month as mm a day; negative values are missing."""
    return F.when(v >= 0, v / 10.0 / days_in_month(year, month))


def wrap_longitude(lon: Column) -> Column:
    """0..360 as -180..180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def log_link(v: Column, offset: Column) -> Column:
    return F.ln(v + offset)


def inverse_log_link(g: Column, offset: Column) -> Column:
    return F.exp(g) - offset


def normal_interval(v: Column, variance: Column) -> tuple[Column, Column]:
    half = F.lit(Z95) * F.sqrt(variance)
    return v - half, v + half


def lognormal_interval(v: Column, offset: Column, variance: Column) -> tuple[Column, Column]:
    """Bounds of a shifted log-normal value, not below zero."""
    base = F.greatest(v + offset, F.lit(1e-10))
    half = F.lit(Z95) * F.sqrt(variance)
    return tuple(F.greatest(base * F.exp(-variance / 2 + s * half) - offset, F.lit(0.0)) for s in (-1, 1))


def clip_zero(v: Column) -> Column:
    """Not below zero; null stays null."""
    return F.when(v < 0, F.lit(0.0)).otherwise(v)


def albers(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Equal-area conic coordinates in metres of geographic degrees (Snyder's ellipsoidal formulas)."""
    ecc2 = FLATTENING * (2 - FLATTENING)
    ecc = math.sqrt(ecc2)

    def q_of(s: float) -> float:
        return (1 - ecc2) * (s / (1 - ecc2 * s * s) - math.log((1 - ecc * s) / (1 + ecc * s)) / (2 * ecc))

    def scale_of(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - ecc2 * math.sin(phi) ** 2)

    phi1, phi2 = map(math.radians, PARALLELS)
    m1, m2, q1, q2 = scale_of(phi1), scale_of(phi2), q_of(math.sin(phi1)), q_of(math.sin(phi2))
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    rho0 = SEMI_MAJOR * math.sqrt(c - n * q_of(math.sin(math.radians(ORIGIN[0])))) / n
    s = F.sin(F.radians(lat))
    q = (1 - ecc2) * (s / (1 - ecc2 * s * s) - F.ln((1 - ecc * s) / (1 + ecc * s)) / (2 * ecc))
    rho = F.sqrt(c - n * q) * (SEMI_MAJOR / n)
    theta = F.radians(lon - ORIGIN[1]) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def half_even(v: Column, digits: int) -> Column:
    """Rounded to decimals, ties to the even digit; zero has no sign."""
    return F.rint(v * float(10**digits)) / float(10**digits) + F.lit(0.0)


def pack_hundredths(v: Column) -> Column:
    """A value as a 16-bit integer of hundredths, the fill value for null."""
    return F.coalesce(F.round(v * 100).cast("smallint"), F.lit(MISSING_PACKED).cast("smallint"))


def unpack_hundredths(p: Column) -> Column:
    return F.when(p != MISSING_PACKED, p * 0.01)
