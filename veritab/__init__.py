"""Spark-native reconciliation of claim tables with evidence documents."""
