"""Readers and writers for CSV, Parquet, JSON and ORC tables."""

from cohortlens.sources.io import (  # noqa: F401
    PANDAS_NA_TOKENS,
    convert,
    filter_and_save,
    format_of,
    normalise_missing,
    read_table,
    run_stamp,
    scratch_path,
    write_run,
    write_table,
)
