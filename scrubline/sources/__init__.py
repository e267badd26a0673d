"""Readers, writers and versioned snapshots."""

from .readers import (  # noqa: F401
    decode_messages,
    read_delimited,
    read_folder,
    read_jdbc,
    read_json_records,
    read_jsonl,
    read_parquet,
    read_stream,
)
from .versions import list_versions, read_version, rollback, save_version  # noqa: F401
from .writers import write, write_folder, write_stream  # noqa: F401
