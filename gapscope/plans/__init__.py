"""The steps of a run and the report queries, as plans over DataFrames."""
