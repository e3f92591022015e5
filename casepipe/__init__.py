"""casepipe: a Spark-native document-labelling engine.

Corpus -> paragraphs -> labels -> splits -> metrics, every step a function from
DataFrame to DataFrame built on the DataFrame / SQL API.
"""

__version__ = "0.1.0"
