"""Part of the urban-comfort analytics engine on PySpark."""
