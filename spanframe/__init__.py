"""spanframe: annotation spans over PySpark DataFrames."""
