from panelforge.sources.csv import (
    NULL_TOKENS,
    read_csv,
    read_csv_named,
    read_csv_stray_header,
    write_csv,
)
from panelforge.sources.tables import Tables

__all__ = ["NULL_TOKENS", "Tables", "read_csv", "read_csv_named", "read_csv_stray_header", "write_csv"]
