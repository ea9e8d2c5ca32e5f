"""sparkfold: data reduction and corpus analytics on Apache Spark."""
