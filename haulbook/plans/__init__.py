"""Whole jobs composed from operators: intake, admission, folds, control, reports and copies."""
