"""Set-level operators over register, table-of-contents, citation and hit tables."""
