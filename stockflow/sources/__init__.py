"""Sources and sinks: typed raw scans, domain tables, ledger / notification sinks, event streams."""
