"""tarn: versioned Parquet tables and a small query layer on PySpark."""
