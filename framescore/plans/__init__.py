"""The original programs as pipelines (``jobs``), the command-line launcher
(``cli``), and the registered queries with their DuckDB oracles (``catalog``,
``oracle``)."""
