"""Image-dataset curation as Spark DataFrame operators."""
