"""Clinical text extraction, linking and corpus preparation as Spark DataFrame operators."""
