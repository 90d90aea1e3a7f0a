"""Sources: fixture adapters, file readers and sinks."""
