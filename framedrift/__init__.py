"""Packet captures as Spark tables: read, perturb, write back, compare."""
