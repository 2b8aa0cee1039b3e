"""Sources and sinks: packed binary sequences, text graphs, files by prefix."""
