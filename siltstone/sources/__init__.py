"""Sources of pages: saved tables, compressed and undecoded bodies."""
