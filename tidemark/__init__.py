"""Event timelines from Windows evidence of many hosts, built on DataFrames."""

from .schema import EVENT_SCHEMA, RECORD_SCHEMAS, TIMELINE_FIELDS, TIMELINE_SCHEMA
from .session import configure

__all__ = ["EVENT_SCHEMA", "RECORD_SCHEMAS", "TIMELINE_FIELDS", "TIMELINE_SCHEMA", "configure"]
