"""netlens: network-behaviour analytics as Spark DataFrame operators."""
