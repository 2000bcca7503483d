"""Analytics over large panels of (entity, time, value) rows, written as Spark DataFrame plans."""
