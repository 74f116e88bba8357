"""folioforge: document reduction over corpora of pages, as Spark DataFrame operators."""
