"""Training-data operators: scans, classifiers, deduplication, joins,
decontamination, language-model scores, token counts, mixing and URL filters.

Nothing else in the library imports this subpackage; its queries and their
SQL are registered by ``assetlens.llm.queries``.
"""
