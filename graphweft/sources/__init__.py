"""Where patterns find their rows: graphs of triples and mapped tables, and resources of series."""
