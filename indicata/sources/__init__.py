from indicata.sources.readers import (  # noqa: F401
    jdbc_options, read_codes, read_microdata, read_open_csv, read_period_files, read_polygons,
    read_register, read_table, select_variables, to_parquet, wkt_rings,
)
from indicata.sources.sinks import write_bucketed, write_extract, write_indicator  # noqa: F401
