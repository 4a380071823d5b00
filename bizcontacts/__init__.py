"""bizcontacts: business-contact data work on PySpark DataFrames.

Layers, each importing only from the ones above it:

* ``values``      fixed words, patterns and dimension rows
* ``functions``   Column -> Column expressions
* ``sources``     readers, writers and dimension tables
* ``operators``   DataFrame -> DataFrame building blocks
* ``plans``       the table jobs made from them
* ``streaming``   the incremental lead ingest
"""

__version__ = "0.1.0"
