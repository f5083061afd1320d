"""graphmine: mining of layered item-feature graphs and preparation of text corpora as Spark jobs."""
