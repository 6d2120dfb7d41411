"""Sources and sinks of files: discovery, chunk scans, JSONL, manifests, tables."""
