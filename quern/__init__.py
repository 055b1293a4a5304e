"""quern: prepare, audit and score tabular prediction data with PySpark."""
