"""tidemark: market-risk forecasting, validation and data pipelines on Spark."""
