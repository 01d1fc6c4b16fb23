"""From profiles to a metadata record, by rule; and optional text generators."""

from __future__ import annotations

from typing import Protocol

from ..catalog import Context
from ..operators import spatial, temporal
from .standards import fields_of

_FORMATS = {"single_csv": "CSV", "multi_csv": "CSV", "sqlite": "SQLite", "parquet": "Parquet", "text": "text"}


class TextGenerator(Protocol):
    """An external model; none is needed."""

    def generate(self, prompt: str, temperature: float | None = None) -> str: ...


def extents(context: Context) -> dict:
    """Over all resources: the widest time span, its finest granularity, and the union of bounding boxes."""
    spans, boxes = [], []
    for name in context.resources:
        df = context.table(name)
        for row in temporal.detect_temporal_columns(df, 0).where("detected_type IN ('datetime64', 'datetime_string')").collect():
            got = temporal.analyze_temporal_column(df, row.field).first()
            if got.min_ts is not None:
                spans.append((got.min_ts, got.max_ts, got.apparent_granularity))
        pair = spatial.named_pair(df)
        if pair:
            got = spatial.spatial_extent(df, *pair).first()
            if got.valid_point_count:
                boxes.append(got)
    out: dict = {"temporal_coverage": None, "temporal_resolution": None, "spatial_coverage": None}
    if spans:
        low, high = min(s[0] for s in spans), max(s[1] for s in spans)
        out["temporal_coverage"] = f"{low:%Y-%m-%d} to {high:%Y-%m-%d}"
        out["temporal_resolution"] = max(spans, key=lambda s: s[1] - s[0])[2]
    if boxes:
        out["spatial_coverage"] = {"min_lat": min(b.min_lat for b in boxes), "min_lon": min(b.min_lon for b in boxes), "max_lat": max(b.max_lat for b in boxes), "max_lon": max(b.max_lon for b in boxes)}
    return out


def describe(context: Context) -> str:
    infos = context.get_all_resource_info()
    parts = [f"{n} ({i.item_count} rows, {i.field_count} fields)" for n, i in infos.items()]
    edges = context.get_relationships() if len(infos) > 1 else []
    links = "; ".join(f"{e.from_resource}.{e.from_field} -> {e.to_resource}.{e.to_field} ({e.relationship_type})" for e in edges)
    return f"{len(infos)} resource{'s' * (len(infos) != 1)}: {', '.join(parts)}." + (f" Relationships: {links}." if links else "")


def synthesise(context: Context, standard: str = "spatial_ecological", artifacts: dict | None = None, writer: TextGenerator | None = None) -> dict:
    """A record of the standard's fields; what nothing is known of is None."""
    known = {"title": context.name.replace("_", " ").strip().title(), "description": context.description or describe(context), "format": _FORMATS.get(context.context_type.value)} | extents(context)
    known |= {k: v for k, v in (artifacts or {}).items() if k in fields_of(standard)}
    record = {f: known.get(f) for f in fields_of(standard)}
    if writer is not None:
        import json

        try:
            told = json.loads(writer.generate(f"Fill this record; null where nothing is known.\n{json.dumps(record, default=str)}"))
            record |= {k: v for k, v in told.items() if k in record and v is not None}
        except (ValueError, AttributeError):
            return record
    return record
