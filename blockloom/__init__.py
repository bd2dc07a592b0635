"""blockloom: a PySpark-native analytics engine for block-partitioned ledger data."""
