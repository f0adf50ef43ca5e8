"""Reading and writing list files."""

from roster.sources.readers import (
    ORDER, SOURCE, probe, quality_report, read_id_text, read_key_list, read_lists, read_rejects, read_sources,
)
from roster.sources.writers import (
    convert_utf8, write_by_value, write_id_text, write_list, write_per_source, write_report,
)

__all__ = [name for name in dir() if not name.startswith("_")]
