"""The run statistics over a response log that is still being written."""
