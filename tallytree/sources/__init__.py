"""Reading records and writing results."""

from .tables import read_records, write_records

__all__ = ["read_records", "write_records"]
