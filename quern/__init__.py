"""quern: a corpus and training-data engine expressed as Spark DataFrame plans."""
