"""Estimators, feature jobs and experiment runs built from the operators."""
