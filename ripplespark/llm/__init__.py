"""Training-data operators for corpora of documents, pages and benchmark items.

Nothing outside this folder imports it; ``queries`` lists what it registers.
"""
