"""skein: a Spark-first engine for building and auditing text and speech corpora."""
