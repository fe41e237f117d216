"""Writers: tables as JSON, one JSON document, an HTML report."""
