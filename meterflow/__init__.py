"""meterflow: machine meter-reading analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function (chain them with
``DataFrame.transform``); column names are arguments so the readings shape is
not tied to one fixture.
"""

__version__ = "0.1.0"
