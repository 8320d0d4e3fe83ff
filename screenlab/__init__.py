"""Analytics over entity-by-feature screening data, as Spark DataFrame operators."""
