"""vecbank: labelled embedding banks on Spark.

``functions``  column expressions (names, vectors, admission rules)
``operators``  DataFrame -> DataFrame operators (kNN, voting, learning, quotas, ...)
``sources``    scans and sinks (bank versions, JSONL, ``.npy``, JDBC, archives, images)
``streaming``  Structured Streaming jobs
``plans``      whole jobs composed from the above (identify, teach, curate, train)
``queries``    the registered queries with their SQL twins
"""
