"""Training-data operators: tokens, packing, de-duplication, personal data, media, decontamination, quality.

Nothing else in the library imports this subpackage. Every operator takes a documents DataFrame and the
names of its id and text columns, selects just those two, and therefore never meets the other columns.
"""
