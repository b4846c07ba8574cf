"""Sources and sinks: driver tables, CSV/JSON review files, fixtures."""
