"""pagequarry: page text to graded-practice data, expressed as Spark DataFrame plans."""
