"""adit: a Spark-native engine for vulnerability-intelligence records, graphs and corpora."""
