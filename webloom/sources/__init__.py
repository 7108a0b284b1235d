"""Table schemas, readers and storage layouts."""
