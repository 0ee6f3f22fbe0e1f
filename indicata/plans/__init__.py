"""Query plans over the stand-in tables: each registered query is a function
(spark, sf_dir) -> DataFrame, paired with DuckDB SQL in ``oracle``."""
