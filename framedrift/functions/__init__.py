"""Column functions: seeded draws, byte access, frame headers, checksums."""
