"""pkgloom: DataFrame-first analytics over software-package knowledge graphs."""
