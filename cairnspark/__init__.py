"""Analytics over content-addressed data, declared as Spark plans."""
