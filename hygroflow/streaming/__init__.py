"""Incremental loading.

The analyses run in batches; what they know of increments is "insert what is
not there yet".  These functions take any bounded DataFrame, so a micro-batch
handed over by ``foreachBatch`` works as well as a landed file.
"""
