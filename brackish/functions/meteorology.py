"""Humidity, radiation, wind and turbulence expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brackish.functions.energy import W2MM, available, clip

# Fixed physical constants.
GAMMA = 0.066
KARMAN = 0.4
GRAVITY = 9.81
CP_AIR = 1004.0
R_AIR = 287.05
ZERO_C = 273.15


def svp(t: Column) -> Column:
    """Saturation vapour pressure (Tetens), kPa."""
    return F.exp(t * 17.27 / (t + 237.3)) * 0.6108


def svp_slope(t: Column) -> Column:
    """Slope of the saturation curve, kPa per kelvin."""
    return svp(t) * 4098.0 / F.pow(t + 237.3, 2)


def daily_vapour(tmax: Column, tmin: Column, rhmax: Column, rhmin: Column) -> tuple[Column, Column]:
    """Saturation and actual vapour pressure from the day's extremes, kPa."""
    es = (svp(tmax) + svp(tmin)) / 2
    ea = (svp(tmin) * rhmax / 100 + svp(tmax) * rhmin / 100) / 2
    return es, ea


def vpd_daily(tmax: Column, tmin: Column, rhmax: Column, rhmin: Column) -> Column:
    es, ea = daily_vapour(tmax, tmin, rhmax, rhmin)
    return clip(es - ea, 0)


def rh_daily(tmax: Column, tmin: Column, rhmax: Column, rhmin: Column) -> Column:
    es, ea = daily_vapour(tmax, tmin, rhmax, rhmin)
    return clip(ea / es * 100, 0, 100)


def vpd_dew(t: Column, dew: Column) -> Column:
    return clip(svp(t) - svp(dew), 0)


def rh_dew(t: Column, dew: Column) -> Column:
    return clip(svp(dew) / svp(t) * 100, 0, 100)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def net_radiation(shortwave: Column, longwave: Column) -> Column:
    return shortwave + longwave


def kelvin_to_c(t: Column) -> Column:
    return t - ZERO_C


def joule_hour_to_watt(x: Column) -> Column:
    return x / 3600.0


def metre_to_mm(x: Column) -> Column:
    return x * 1000.0


def kpa_to_hpa(x: Column) -> Column:
    return x * 10.0


def pet_to_mm(x: Column) -> Column:
    """Potential evaporation comes as negative metres."""
    return F.abs(x) * 1000.0


def equilibrium_et(t: Column, rn: Column) -> Column:
    slope = svp_slope(t)
    return slope / (slope + GAMMA) * rn * W2MM


def priestley_taylor(et: Column, et_eq: Column) -> Column:
    return clip(F.try_divide(et, et_eq), 0, 2.0)


def evaporative_fraction(et: Column, et_available: Column) -> Column:
    return clip(F.try_divide(et, et_available), 0, 1.2)


def sensible_residual(rn: Column, g: Column, et: Column) -> Column:
    return available(rn, g) - et / W2MM


def reference_fraction(et: Column, eto: Column) -> Column:
    """ET over reference ET; a zero reference gives null."""
    return F.try_divide(et, F.nullif(eto, F.lit(0.0)))


def crop_coefficient(et: Column, eto: Column, floor: float = 0.3) -> Column:
    return et / clip(eto, floor)


def sar_db(power: Column, floor: float = 1e-6) -> Column:
    return F.log10(clip(power, floor)) * 10


def polarisation_gap(vv: Column, vh: Column) -> Column:
    return sar_db(vv) - sar_db(vh)


def solar_hour(utc_hour: Column, lon: Column) -> Column:
    return F.pmod(utc_hour + lon / 15.0, F.lit(24.0))


def air_density(pressure_pa: Column, t_kelvin: Column) -> Column:
    return F.try_divide(pressure_pa, t_kelvin * R_AIR)


def obukhov_length(ustar: Column, t_kelvin: Column, h: Column, rho: Column) -> Column:
    """Null where the heat flux is zero; clipped to ten kilometres either way."""
    buoyancy = F.lit(KARMAN * GRAVITY) / t_kelvin * (h / (rho * CP_AIR))
    return clip(F.try_divide(-F.pow(ustar, 3), buoyancy), -1e4, 1e4)


def sigma_v(ustar: Column) -> Column:
    return ustar * 1.9


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.floor((lon + 180.0) / 6.0).cast("int") + 1
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone


def day_features(date: Column) -> dict[str, Column]:
    """Day of year with its sine and cosine on a 365.25-day circle."""
    doy = F.dayofyear(date)
    angle = doy * (2 * 3.141592653589793 / 365.25)
    return {"DOY": doy, "DOY_sin": F.sin(angle), "DOY_cos": F.cos(angle)}
