"""flowtide: network-flow analytics as composable Spark DataFrame operators."""
