"""riskloom: credit-risk feature engineering and scoring on Spark DataFrames."""
