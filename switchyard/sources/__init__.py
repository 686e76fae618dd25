"""Sources and sinks: parquet tables, ticket CSV exports, metric JSON, cross-tab CSV."""

from switchyard.sources.tables import (  # noqa: F401
    TICKET_COLUMNS, TICKET_SCHEMA, ROSTER_COLUMNS, convert_ticket_csv, load_table, read_audit, read_ticket_csv,
    read_roster_csv, rejected_cells, typed_tickets,
)
from switchyard.sources.sinks import (  # noqa: F401
    read_metrics_json, write_crosstab_csv, write_long_parquet, write_metrics_json,
)
