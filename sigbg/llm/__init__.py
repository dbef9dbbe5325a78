"""Training-data operators: packing, token files, deduplication, extraction, scans, mixing, quality.

Nothing else in the package imports this folder.  ``queries`` holds the
registered ``opN_*`` queries; every operator keeps its own general interface
in its own module.
"""
