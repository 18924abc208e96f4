"""Filing text analytics on Spark: DataFrame-first operators over large filing collections."""
