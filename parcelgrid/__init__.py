"""parcelgrid: listing-crawl data work as Spark DataFrame operators.

Every public operator takes and returns DataFrames; nothing is collected to the
driver.  Sub-packages:

* ``functions`` - column expressions (URL codec, ids, page flags, geo).
* ``sources``   - scans of tile documents, record lists, files, ledgers, pages.
* ``operators`` - grid, paging, dedupe, ledger joins, inventories, reports, model.
* ``sinks``     - keyed writers and append-only ledgers.
* ``plans``     - query bindings over the driver test tables and their SQL oracles.
* ``streaming`` - incremental master list over a landing folder.
"""

__version__ = "0.1.0"
