"""parcelwise: geospatial feature analytics expressed as PySpark DataFrame operators."""
