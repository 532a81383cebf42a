"""Schemas of the tables that are kept or exchanged."""

from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructType, TimestampType

_TYPES = {"string": StringType, "bigint": LongType, "int": IntegerType, "boolean": BooleanType, "binary": BinaryType, "timestamp": TimestampType}


def table(fields: str) -> StructType:
    """From "name type, ..."; StructType.fromDDL would need a session."""
    out = StructType()
    for field in fields.split(","):
        name, kind = field.split()
        out = out.add(name, _TYPES[kind]())
    return out


OP_LOG = table("batch_id string, timestamp timestamp, op_type string, old_path string, new_path string, undone boolean")
WARNING = table("timestamp timestamp, source_path string, category string, subcategory string, warning string")
LISTING = table("source_path string, size_bytes bigint, mtime_ns bigint")
EXTRACTED = table("source_path string, ok boolean, title string, author string, year string, subject string, error string")
COVER = table("source_path string, cover binary, content_type string")
PAGE_IMAGE = table("source_path string, page int, image binary, content_type string")
CACHE = table(
    "source_path string, mtime_ns bigint, size bigint, title string, author string, year string, category string, subcategory string,"
    " cover_path string, cover_overridden boolean, cover_version int, metadata_version int"
)
OVERRIDE = table("source_path string, type string, page int, image_path string")
