"""Training-data operators: token counts, line dedup, decontamination, secret
scans, quality rules, language ID, LM scoring, n-gram Jaccard join, byte-level
BPE and WARC archives.

Nothing else in the library imports this subpackage.  Modules are imported one
by one by their users, so this file stays empty of imports.
"""
