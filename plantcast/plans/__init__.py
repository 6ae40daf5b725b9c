"""End-to-end jobs: demand and scrap feature tables, training, scoring, reports."""
