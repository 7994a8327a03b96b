"""weftline: a Spark-first engine for evidence retrieval and consistency checks over long texts."""
