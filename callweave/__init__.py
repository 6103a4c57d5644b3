"""callweave: conversation analytics as Spark jobs.

Calls come in as utterances, leave as summaries, agent actions and topics. Every step is a function from
DataFrame to DataFrame (or Column to Column); jobs in ``callweave.plans`` put the steps together.
"""

__version__ = "0.1.0"
