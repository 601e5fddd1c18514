"""Operations of a large training-data pipeline, as Spark jobs over a table of documents."""
