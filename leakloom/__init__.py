"""leakloom: code-security scanning and usage analytics as Spark DataFrame jobs."""
