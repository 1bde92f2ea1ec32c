"""corpusloom: language-model training data as Spark dataflows."""
