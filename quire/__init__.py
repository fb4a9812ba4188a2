"""quire: Spark-native analytics over corpora of paged documents.

A *book* is split into pages, a page into lines.  Every operator takes and returns DataFrames keyed by
``(book, page_num)``; nothing here loops over documents on the driver.
"""
