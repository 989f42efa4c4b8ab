"""discloom: a Spark-native disclosure analytics engine."""

__version__ = "0.1.0"
