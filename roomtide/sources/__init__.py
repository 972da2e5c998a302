"""Where rows come from and go to: Parquet tables, raw CSV files, Kafka, scratch tables."""
