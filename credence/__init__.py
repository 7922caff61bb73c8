"""Source-credibility corpora on Spark: score, clean, merge, profile, encode, judge.

Every operator is a function from DataFrame to DataFrame. Nothing runs until the
caller asks for an action, so whole pipelines reach Catalyst as one plan.
"""

__version__ = "0.1.0"
