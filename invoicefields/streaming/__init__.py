"""The inbox as a stream: land files, close batches, run what is closed."""
