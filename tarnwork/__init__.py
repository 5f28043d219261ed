"""tarnwork: Spark-first operators for irregular time series, camera imagery and tabular modelling."""
