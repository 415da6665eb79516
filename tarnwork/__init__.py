"""tarnwork: a Spark-native data-mining and analytics engine."""
