"""skarn: preparing, describing, modelling and scoring example data with Spark DataFrames."""
