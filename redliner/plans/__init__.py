"""Jobs: compositions of operators over domain frames."""
