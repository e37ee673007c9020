"""tidewatch: network-traffic analytics on Spark DataFrames.

Packets -> one-way flows -> signature rules -> model scores -> one verdict per
capture, plus the table preparation, sampling and evaluation work around the
models. Every operator is a function from DataFrame(s) to DataFrame.
"""

__version__ = "0.1.0"
