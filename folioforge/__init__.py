"""Corpus analytics on Spark: DataFrame-to-DataFrame operators for collections of long documents."""
