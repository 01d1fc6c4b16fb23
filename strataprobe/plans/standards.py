"""Metadata standards: what a record must hold."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_RECORD = "title string, description string, subject string, spatial_coverage map<string,double>, spatial_resolution string, temporal_coverage string, temporal_resolution string, methods string, format string"

#: Schemas by name of standard.
SCHEMAS: dict[str, str] = {"spatial_ecological": _RECORD}
TEMPLATES: dict[str, dict[str, str]] = {
    "spatial_ecological": {
        "title": "Title of the dataset",
        "description": "What the dataset holds",
        "subject": "Its topic",
        "spatial_coverage": "Bounding box in WGS84 as numbers: min_lat, min_lon, max_lat, max_lon",
        "spatial_resolution": "How fine places are",
        "temporal_coverage": "Period covered",
        "temporal_resolution": "How fine times are",
        "methods": "How the data were gathered",
        "format": "Format of the data",
    }
}


def load_metadata_standard(name: str) -> str:
    """A standard by name, else the text of a file."""
    import json

    if name in TEMPLATES:
        return json.dumps(TEMPLATES[name], indent=2)
    if Path(name).is_file():
        return Path(name).read_text(encoding="utf-8")
    raise ValueError(f"{name!r} is neither a metadata standard nor a file; standards: {sorted(TEMPLATES)}")


def schema_for_standard(name: str) -> str | None:
    return SCHEMAS.get(name)


def fields_of(name: str) -> list[str]:
    return list(TEMPLATES.get(name, TEMPLATES["spatial_ecological"]))


def record_frame(spark: SparkSession, record: dict, name: str = "spatial_ecological") -> DataFrame:
    """The record as one row."""
    return spark.createDataFrame([tuple(record.get(f) for f in fields_of(name))], SCHEMAS[name])
