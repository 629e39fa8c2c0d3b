"""Sources (label CSV, report folders, archived tables) and sinks."""
