"""Spark-native oligo and assay analytics."""
