"""What a column's name suggests."""

from __future__ import annotations

import re

# Name patterns that suggest a time.
TEMPORAL_PATTERNS = (
    "date", "time", "timestamp", "datetime", "created", "updated", "modified", "start", "end", "begin", "expire", "valid",
    "year", "month", "day", "hour", "minute", "second", "period", "duration", "_at$", "_on$", "_dt$",
)

# Name patterns that suggest a place.
SPATIAL_PATTERNS = (
    "lat(?:itude)?", "lon(?:g(?:itude)?)?", "coord", "geo", "location", "position", "point", "polygon", "geometry", "geom", "wkt", "wkb",
    "x_?coord", "y_?coord", "easting", "northing", "spatial", "place", "address", "city", "state", "country", "zip", "postal",
    "region", "bbox", "bounds", "extent",
)

TEMPORAL = "|".join(TEMPORAL_PATTERNS)
SPATIAL = "|".join(SPATIAL_PATTERNS)
#: Parts of a name that make a column a possible date.
DATE_PARTS = ("date", "time", "created", "updated", "timestamp")


def suggests_time(name: str) -> bool:
    return re.search(TEMPORAL, name.lower()) is not None


def suggests_place(name: str) -> bool:
    return re.search(SPATIAL, name.lower()) is not None


def possible_id(name: str) -> bool:
    return name.lower().endswith("id")


def possible_date(name: str) -> bool:
    return any(part in name.lower() for part in DATE_PARTS)


def plain(name: str) -> str:
    """Lower case without underscores and hyphens."""
    return re.sub("[_-]", "", name.lower())


def names_match(a: str, b: str) -> bool:
    """Whether two column names may mean the same key: equal, equal but for a final id, or one within the other."""
    a, b = plain(a), plain(b)
    return a in b or b in a or (a.endswith("id") and b.endswith("id") and a[:-2] == b[:-2])
