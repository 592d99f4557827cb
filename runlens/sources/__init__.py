"""Sources and sinks: landing JSON scans, the run table, derived fixtures, report/dataset sinks."""
