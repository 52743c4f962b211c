"""DataFrame -> DataFrame operators shared by the batch and streaming plans."""
