"""quire: long-document and bilingual-text analytics as Spark DataFrames."""
