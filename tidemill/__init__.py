"""Analytics over (date x entity) panels and text corpora, declared as Spark DataFrame plans."""
