"""Packet operators: DataFrame in, DataFrame out."""
