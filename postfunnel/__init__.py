"""postfunnel: a Spark-native engine that funnels, prices and reports on postings."""
