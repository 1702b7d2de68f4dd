"""bazaar: an online shop's data work as Spark DataFrame jobs.

Start with ``bazaar.sources.tables.load_shop`` (or ``shop_from_tables``)
for the shop's tables, then call the operators in ``bazaar.operators``
(catalog, orders, users, nested, checkout, writes, audit) and
``bazaar.streaming``; every operator takes DataFrames and returns lazy
DataFrames.  ``bazaar.plans.registry`` lists the registered queries.
"""
