"""Sources and sinks: parquet/CSV files, the fixture views, Kafka and file streams, the catalog."""
