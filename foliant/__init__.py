"""Analytics over document collections, as Spark DataFrame plans."""
