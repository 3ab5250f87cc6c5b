"""DataFrame to DataFrame operators over signals and results."""
