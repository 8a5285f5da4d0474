"""What is read and written: the ledger, message topics and stored objects."""
