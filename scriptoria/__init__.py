"""scriptoria: document analytics expressed as Spark DataFrames."""
