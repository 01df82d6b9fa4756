"""choicespark: survey-driven choice modelling as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function (or returns a
small statistic computed by one distributed aggregate).  Nothing here creates
a session except :func:`choicespark.session.get_session`, which tests and the
bench use.
"""

__version__ = "0.1.0"
