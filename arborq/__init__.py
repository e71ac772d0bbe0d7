"""arborq: typed-graph analytics over notes and tables, on PySpark."""
