"""Whole plans: the fixture tables, the catalogue of queries and the evaluation pipelines."""
