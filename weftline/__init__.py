"""weftline: a PySpark-native engine for irregular multichannel time series and training-data pipelines."""
