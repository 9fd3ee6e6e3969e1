"""tidegrid: a Spark-native engine for irregular time series and large text corpora."""
