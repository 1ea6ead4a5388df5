"""The marts and reports (C1-C9) and the intermediate tables they are built from."""
