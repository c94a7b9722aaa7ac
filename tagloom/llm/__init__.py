"""Training-data operators: fingerprints, language ID, exact search, chat formatting, dedup, toxicity, BPE, packing, licences.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns DataFrames.
"""
