"""Spark-native wavelet and bit-plane analytics on raster DataFrames."""
