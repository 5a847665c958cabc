"""Conversation data on Spark: exports, turns, pairs, splits, retrieval joins, evaluation, live state.

Every public function takes and returns DataFrames or Columns; nothing is collected on the driver.
"""
