"""An extension beyond the batch engine: the same transforms over arriving files."""
