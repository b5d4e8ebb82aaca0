"""Writers: versioned tables, TSV and entity-operation JSON."""
