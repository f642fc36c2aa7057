"""Training-data operators: de-duplication, decontamination, tokenising, quality and toxicity scoring.

Each module holds one operator with a general interface; ``queries`` registers one query per operator.
"""
