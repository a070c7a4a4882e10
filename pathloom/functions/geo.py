"""Column functions for places."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.text import trimmed
from pathloom.sources import dims

RADIUS_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(a))


def wrapped(lon: Column) -> Column:
    """Longitude in [-180, 180); 0 for what isn't finite."""
    finite = lon.isNotNull() & ~F.isnan(lon) & (F.abs(lon) < math.inf)
    return F.when(finite, ((lon + 180) % 360 + 360) % 360 - 180).otherwise(F.lit(0.0))


def country_code(c: Column) -> Column:
    """One code for the known names of a country; other names in lower case; null for none."""
    t = F.nullif(trimmed(F.lower(c)), F.lit(""))
    known = F.create_map(*(F.lit(x) for code, names in dims.COUNTRY_NAMES.items() for name in names for x in (name, code)))
    # Bound to a name, so that the text is worked out once.
    return F.get(F.transform(F.array(t), lambda x: F.coalesce(F.try_element_at(known, x), x)), F.lit(0))


def same_country(a: Column, b: Column) -> Column:
    return F.coalesce(country_code(a) == country_code(b), F.lit(False))


def city_name(c: Column) -> Column:
    t = F.translate(F.lower(c), "._-", "   ")
    return F.nullif(trimmed(t), F.lit(""))


def centroid(country: Column) -> tuple[Column, Column]:
    """The centre of a country by code or part of the name, in table order."""
    lat, lon = F.when(F.lit(False), F.lit(0.0)), F.when(F.lit(False), F.lit(0.0))
    country = F.lower(F.coalesce(country, F.lit("")))
    for code, name, y, x in dims.CENTROIDS:
        hit = (country == code.lower()) | F.contains(country, F.lit(name))
        lat, lon = lat.when(hit, F.lit(y)), lon.when(hit, F.lit(x))
    return lat.otherwise(F.lit(dims.DEFAULT_CENTROID[0])), lon.otherwise(F.lit(dims.DEFAULT_CENTROID[1]))


def near_on_map(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Shown at the same place: less than 0.7 degrees apart on the plane."""
    return F.hypot(lat1 - lat2, lon1 - lon2) < 0.7


def metro_index(city: Column, country: Column, lat: Column, lon: Column) -> Column:
    """The number of the first metropolitan area of the country that lists the city or is near enough; null if none."""
    return metro_of(city, country_code(country), lat, lon)


def metro_of(city: Column, cc: Column, lat: Column, lon: Column) -> Column:
    """metro_index of a country's code as country_code gives it."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (key, _, cc_, y, x, radius, _) in enumerate(dims.METROS):
        listed = F.coalesce(city_name(city).isin(dims.METRO_CITIES[key]), F.lit(False))
        out = out.when((cc == cc_.lower()) & (listed | F.coalesce(haversine(lat, lon, F.lit(y), F.lit(x)) <= radius, F.lit(False))), F.lit(i))
    return out


def minimum_zoom(width: Column) -> Column:
    return F.greatest(F.lit(1.2), F.log2(F.greatest(width, F.lit(320.0)) / 256) - 0.025)


def country_label(country: Column) -> Column:
    """The short name that a country is shown by; other names stay as they are."""
    c = F.lower(F.coalesce(country, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for code, part, shown in (("kr", "korea", "KR"), ("jp", "japan", "JP"), ("us", "united states", "US"), ("gb", "united kingdom", "UK")):
        out = out.when((c == code) | F.contains(c, F.lit(part)), F.lit(shown))
    return out.when(c == "hong kong", "Hong Kong").when(c == "germany", "DE").when(c == "australia", "AU").otherwise(country)


def zoom_for(span: Column) -> Column:
    return F.when(span > 80, 3.75).when(span > 55, 4.15).when(span > 28, 4.85).otherwise(6.25)
