"""Files of the domain as DataFrames, and DataFrames as such files."""
