"""DataFrame operators: joins over time, windows, cohorts, features, evaluation."""
