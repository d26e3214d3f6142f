"""Positions of the sky in columns: low-precision published series, coordinates and moonlight.

The sun is good to about 0.01 degrees and the moon to about 0.3, which decides thresholds but not the last minute of a rise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The galactic pole and the longitude of the celestial pole (degrees), sidereal rate, synodic month (days).
POLE_RA, POLE_DEC, POLE_L = 192.85948, 27.12825, 122.93192
SIDEREAL, SYNODIC = 1.00273790935, 29.530589
OBLIQUITY = 23.4393


def days(ts: Column) -> Column:
    """Days since 2000-01-01 12:00 UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 8.64e10 - 10957.5


def turn(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def sin(x: Column | float) -> Column:
    return F.sin(F.radians(x))


def cos(x: Column | float) -> Column:
    return F.cos(F.radians(x))


def sun_longitude(d: Column) -> Column:
    g = 357.529 + 0.98560028 * d
    return turn(280.459 + 0.98564736 * d + 1.915 * sin(g) + 0.020 * sin(2 * g))


def moon_ecliptic(d: Column) -> tuple[Column, Column]:
    """Longitude and latitude with the main terms of the series."""
    m, mm, dd, f = 357.529 + 0.98560028 * d, 134.963 + 13.064993 * d, 297.850 + 12.190749 * d, 93.272 + 13.229350 * d
    lon = 218.316 + 13.176396 * d + 6.289 * sin(mm) + 1.274 * sin(2 * dd - mm) + 0.658 * sin(2 * dd) + 0.214 * sin(2 * mm) - 0.186 * sin(m) - 0.114 * sin(2 * f)
    lat = 5.128 * sin(f) + 0.281 * sin(mm + f) + 0.278 * sin(mm - f) + 0.173 * sin(2 * dd - f)
    return turn(lon), lat


def equatorial(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Right ascension and declination in degrees of ecliptic coordinates."""
    e = math.radians(OBLIQUITY)
    ra = F.degrees(F.atan2(sin(lon) * math.cos(e) - F.tan(F.radians(lat)) * math.sin(e), cos(lon)))
    return turn(ra), F.degrees(F.asin(sin(lat) * math.cos(e) + cos(lat) * math.sin(e) * sin(lon)))


def from_galactic(l: Column, b: Column) -> tuple[Column, Column]:  # noqa: E741
    p, x = math.radians(POLE_DEC), POLE_L - l
    dec = F.asin(sin(b) * math.sin(p) + cos(b) * math.cos(p) * cos(x))
    ra = POLE_RA + F.degrees(F.atan2(cos(b) * sin(x), sin(b) * math.cos(p) - cos(b) * math.sin(p) * cos(x)))
    return turn(ra), F.degrees(dec)


def hour_angle(d: Column, lon: Column, ra: Column) -> Column:
    """Degrees west of the meridian, 0 to 360."""
    return turn(280.46061837 + 360.98564736629 * d + lon - ra)


def horizontal(d: Column, lat: Column, lon: Column, ra: Column, dec: Column) -> tuple[Column, Column]:
    """Altitude and azimuth (from north to the east) in degrees."""
    h = hour_angle(d, lon, ra)
    alt = F.degrees(F.asin(sin(lat) * sin(dec) + cos(lat) * cos(dec) * cos(h)))
    az = turn(F.degrees(F.atan2(-sin(h) * cos(dec), sin(dec) * cos(lat) - cos(dec) * cos(h) * sin(lat))))
    return alt, az


def phase_angle(d: Column) -> Column:
    """0 at full moon, 180 at new moon."""
    lon, lat = moon_ecliptic(d)
    away = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos(lon - sun_longitude(d)) * cos(lat))))
    return 180.0 - F.degrees(away)


def illuminated(d: Column) -> Column:
    return (1 + cos(phase_angle(d))) / 2


def moon_age(d: Column) -> Column:
    return turn(moon_ecliptic(d)[0] - sun_longitude(d)) / 360.0 * SYNODIC


def transit_wait(d: Column, lon: Column, ra: Column) -> Column:
    """Hours until the next passage of the meridian."""
    return F.pmod(-hour_angle(d, lon, ra), F.lit(360.0)) / 15.0 / SIDEREAL


def rising_kind(lat: Column, dec: Column) -> Column:
    """circumpolar, never_rises or rises."""
    return F.when(F.abs(lat + dec) >= 90, "circumpolar").when(F.abs(lat - dec) >= 90, "never_rises").otherwise("rises")


def moon_negligible(alt: Column, phase: Column, least_phase: float = 150.0) -> Column:
    return (alt <= 0) | (phase >= least_phase)


def sexagesimal(a: Column, b: Column, c: Column) -> Column:
    """Degrees of three parts, negative if any of them is."""
    sign = F.when((a < 0) | (b < 0) | (c < 0), -1.0).otherwise(1.0)
    return sign * (F.abs(a) + F.abs(b) / 60.0 + F.abs(c) / 3600.0)


#: Fixed values of the published sky brightness model.
NL0, NL1, NL2 = 34.08, 20.7233, 0.92104
EXTINCTION = 0.172


def nanolamberts(mag: Column) -> Column:
    return NL0 * F.exp(NL1 - NL2 * mag)


def magnitudes(nl: Column) -> Column:
    return (NL1 - F.log(nl / NL0)) / NL2


def airmass(zenith: Column) -> Column:
    return F.pow(1 - 0.96 * F.pow(sin(zenith), 2), F.lit(-0.5))


def moon_illuminance(phase: Column) -> Column:
    a = F.abs(phase)
    return F.pow(F.lit(10.0), -0.4 * (3.84 + 0.026 * a + 4e-9 * F.pow(a, F.lit(4.0))))


def scattering(rho: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(5.36)) * (1.06 + F.pow(cos(rho), F.lit(2.0))) + F.pow(F.lit(10.0), 6.15 - rho / 40)


def moonlight(phase: Column, rho: Column, moon_zenith: Column, zenith: Column, k: float = EXTINCTION) -> Column:
    """Brightness in nanolamberts that the moon adds to the sky; none while it is down."""
    light = scattering(rho) * moon_illuminance(phase) * F.pow(F.lit(10.0), -0.4 * k * airmass(moon_zenith)) * (1 - F.pow(F.lit(10.0), -0.4 * k * airmass(zenith)))
    return F.when(moon_zenith >= 90, 0.0).otherwise(light)


def with_moonlight(dark_mag: Column, moon_nl: Column) -> Column:
    return magnitudes(nanolamberts(dark_mag) + moon_nl)
