"""hexloom: location analytics and table hygiene on PySpark DataFrames."""
