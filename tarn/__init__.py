"""Document retrieval, question answering and corpus processing as Spark DataFrame operators."""
