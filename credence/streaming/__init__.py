"""Incremental runs. There is no windowed or stateful stream here: the one incremental
job is to take only articles that no earlier run has stored."""
