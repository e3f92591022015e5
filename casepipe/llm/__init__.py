"""Operators of a training-data pipeline: formatting, de-duplication,
decontamination, language identification and tokenisation.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when the folder is present.
"""
