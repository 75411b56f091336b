"""Column functions: normalisation, extraction, scoring, spelling."""
