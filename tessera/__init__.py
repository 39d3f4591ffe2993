"""tessera: Spark jobs for lakehouse applications that mix tables, documents and chats.

Every public function takes and returns Spark DataFrames. Sub-packages:

* ``sources``    scans, sinks and table DDL helpers
* ``functions``  column-expression helpers (no Python per row)
* ``operators``  the jobs: billing, chunking, finance, moderation, messages,
                 chats, retrieval
* ``streaming``  Structured Streaming forms of the jobs
* ``plans``      inputs derived from the benchmark tables and the query catalog
"""

__version__ = "0.1.0"
