"""Training-data operators: language, duplicates, decontamination, mixing, media, chat, URLs.

Each module holds one operator with a general interface; ``queries`` registers the
thin contract queries. Nothing outside this subpackage imports it.
"""
