"""paperloom: a Spark-first analytics engine for a research-paper corpus."""
