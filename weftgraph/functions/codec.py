"""Text encodings: relationships as pipe-separated lines, events as JSON."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.schemas import EVENT


def encode_relationship(attributes: str = "attributes") -> Column:
    """entity|related|type|inference|confidence|created|expires|frequency|source|{k=v,...}; attributes by key, confidence in 6 digits."""
    pairs = F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    confidence = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", "confidence"), "0+$", ""), "[.]$", "")
    return F.concat_ws("|", "entity_id", "related_id", "rel_type", "inference_type", confidence, "created_at", "expires_at", "frequency", "source", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def decode_relationship(line: str | Column) -> Column:
    """The struct of an encoded relationship; null for lines of another shape."""
    parts = F.split(line, "[|]")
    inner = F.regexp_extract(parts[9], "^[{](.*)[}]$", 1)
    attributes = F.when(inner == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(inner, F.lit(","), F.lit("=")))
    kinds = (("entity_id", "string"), ("related_id", "string"), ("rel_type", "string"), ("inference_type", "string"), ("confidence", "double"), ("created_at", "long"), ("expires_at", "long"), ("frequency", "long"), ("source", "string"))
    return F.when(F.size(parts) == 10, F.struct(*(parts[i].try_cast(t).alias(n) for i, (n, t) in enumerate(kinds)), attributes.alias("attributes")))


def encode_event() -> Column:
    return F.to_json(F.struct("event_id", "entity_id", "event_type", "ts_ms", "payload", "features", "explicit"))


def decode_event(text: str | Column) -> Column:
    return F.from_json(text, EVENT)


def row_key(entity: str | Column = "entity_id", related: str | Column = "related_id") -> Column:
    return F.concat_ws(":", F.lit("rel"), entity, related)


def wide_row_key(entity: str | Column = "entity_id") -> Column:
    return F.concat(F.lit("rel_row:"), entity)
