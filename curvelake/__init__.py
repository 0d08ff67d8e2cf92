"""Light-curve reduction and posterior-sample analytics as Spark DataFrame operators."""
